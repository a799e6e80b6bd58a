"""Domains of a column - sorted ranges, value sets, null allowed or not - and their filters.

A domain is kept in normal form (disjoint ascending ranges), supports union, intersection and complement, and compiles
to a ``Column`` that Parquet can push down: equality lists become IN, holes become inequalities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import total_ordering
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@total_ordering
@dataclass(frozen=True)
class Edge:
    """A cut just below (``side`` 0) or just above (1) a value; ``value`` None with side -1 or 2: no bound."""

    value: Any
    side: int

    def __lt__(self, other: Edge) -> bool:
        if self.side == -1 or other.side == 2:
            return self != other and not (other.side == -1) and not (self.side == 2)
        if self.side == 2 or other.side == -1:
            return False
        return (self.value, self.side) < (other.value, other.side)


LOWEST, HIGHEST = Edge(None, -1), Edge(None, 2)


@dataclass(frozen=True)
class Range:
    low: Edge
    high: Edge

    @property
    def single(self) -> bool:
        return self.low.side == 0 and self.high.side == 1 and self.low.value == self.high.value

    def column(self, c: Column) -> Column:
        parts = []
        if self.low != LOWEST:
            parts.append(c >= F.lit(self.low.value) if self.low.side == 0 else c > F.lit(self.low.value))
        if self.high != HIGHEST:
            parts.append(c <= F.lit(self.high.value) if self.high.side == 1 else c < F.lit(self.high.value))
        if self.high == HIGHEST and isinstance(self.low.value, float):
            parts.append(~F.isnan(c))  # which Spark orders after all numbers
        out = parts[0] if parts else c.isNotNull()
        for p in parts[1:]:
            out = out & p
        return out


@dataclass(frozen=True)
class Domain:
    """The values that a column may have."""

    ranges: tuple[Range, ...] = ()
    nulls: bool = False

    @staticmethod
    def of(ranges: list[Range], nulls: bool = False) -> Domain:
        merged: list[Range] = []
        if any(isinstance(e.value, float) and math.isnan(e.value) for r in ranges for e in (r.low, r.high)):
            raise ValueError("NaN cannot bound a range")
        for r in sorted((r for r in ranges if r.low < r.high), key=lambda r: r.low):
            if merged and r.low <= merged[-1].high:
                merged[-1] = Range(merged[-1].low, max(merged[-1].high, r.high))
            else:
                merged.append(r)
        return Domain(tuple(merged), nulls)

    @staticmethod
    def all() -> Domain:
        return Domain((Range(LOWEST, HIGHEST),), True)

    @staticmethod
    def none() -> Domain:
        return Domain()

    @staticmethod
    def values(*values: Any, nulls: bool = False) -> Domain:
        return Domain.of([Range(Edge(v, 0), Edge(v, 1)) for v in values], nulls)

    @staticmethod
    def between(low: Any = None, high: Any = None, low_open: bool = False, high_open: bool = False, nulls: bool = False) -> Domain:
        a = LOWEST if low is None else Edge(low, 1 if low_open else 0)
        z = HIGHEST if high is None else Edge(high, 0 if high_open else 1)
        return Domain.of([Range(a, z)], nulls)

    @staticmethod
    def only_null() -> Domain:
        return Domain((), True)

    @staticmethod
    def not_null() -> Domain:
        return Domain((Range(LOWEST, HIGHEST),), False)

    def union(self, other: Domain) -> Domain:
        return Domain.of([*self.ranges, *other.ranges], self.nulls or other.nulls)

    def _common(self, other: Domain) -> Iterator[Range]:
        """What the ranges of both share, ascending: one walk over both sorted lists."""
        i = j = 0
        while i < len(self.ranges) and j < len(other.ranges):
            a, b = self.ranges[i], other.ranges[j]
            low, high = max(a.low, b.low), min(a.high, b.high)
            if low < high:
                yield Range(low, high)
            if a.high < b.high:
                i += 1
            else:
                j += 1

    def intersect(self, other: Domain) -> Domain:
        return Domain(tuple(self._common(other)), self.nulls and other.nulls)

    def complement(self) -> Domain:
        out, at = [], LOWEST
        for r in self.ranges:
            out.append(Range(at, r.low))
            at = r.high
        if at != HIGHEST:
            out.append(Range(at, HIGHEST))
        return Domain.of(out, not self.nulls)

    def overlaps(self, other: Domain) -> bool:
        return (self.nulls and other.nulls) or next(self._common(other), None) is not None

    def contains(self, value: Any) -> bool:
        if value is None:
            return self.nulls
        at = Edge(value, 0)
        return any(r.low <= at and at < r.high for r in self.ranges)

    def column(self, name: str | Column) -> Column:
        """The filter; true exactly for the domain's values."""
        c = F.col(name) if isinstance(name, str) else name
        if not self.ranges:
            return c.isNull() if self.nulls else F.lit(False)
        if self.ranges == (Range(LOWEST, HIGHEST),):
            return F.lit(True) if self.nulls else c.isNotNull()
        single = [r.low.value for r in self.ranges if r.single]
        rest = [r for r in self.ranges if not r.single]
        holes = self.complement().ranges
        if holes and all(r.single for r in holes):
            out = ~c.isin([r.low.value for r in holes]) if len(holes) > 1 else c != F.lit(holes[0].low.value)
        else:
            parts = ([c.isin(single) if len(single) > 1 else c == F.lit(single[0])] if single else []) + [r.column(c) for r in rest]
            out = parts[0]
            for p in parts[1:]:
                out = out | p
        return out | c.isNull() if self.nulls else out


def tuple_domain(domains: dict[str, Domain]) -> Column:
    """The conjunction of the domains of several columns."""
    out = F.lit(True)
    for name, domain in domains.items():
        out = out & domain.column(name)
    return out
