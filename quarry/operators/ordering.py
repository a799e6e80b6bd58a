"""Sorting, limits and top-n with explicit null placement (by default nulls come last in either direction)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Key:
    """A sort key: what is compared, the direction, and where nulls go."""

    column: Column
    descending: bool = False
    nulls_first: bool = False

    def order(self) -> Column:
        c = self.column
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()


def key(column: str | Column, descending: bool = False, nulls_first: bool = False) -> Key:
    return Key(F.col(column) if isinstance(column, str) else column, descending, nulls_first)


def order(column: str | Column, descending: bool = False, nulls_first: bool = False) -> Column:
    """One of the four orders of a sort key."""
    return key(column, descending, nulls_first).order()


def top_n(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    """The first ``n`` rows: each task keeps its own n before they are merged."""
    return df.orderBy(*keys).limit(n)


def limit_with_ties(df: DataFrame, n: int, *keys: Key) -> DataFrame:
    """The first ``n`` rows and all that tie with the last of them.

    The n-th key is found by a top-n, and the rows up to it by a filter, so no rank over all rows is needed.
    """
    orders = [k.order() for k in keys]
    own = F.struct(*[k.column.alias(f"_k{i}") for i, k in enumerate(keys)]).alias("_k")
    first = df.orderBy(*orders).limit(n).select(own)
    # the last of the n rows: at most n rows are ranked
    again = [key(f"_k._k{i}", k.descending, k.nulls_first).order() for i, k in enumerate(keys)]
    last = first.select("_k", F.rank().over(Window.orderBy(*again)).alias("_r")).groupBy().agg(F.max_by("_k", "_r").alias("_last"))
    before, same = F.lit(False), F.lit(True)
    for i, k in enumerate(keys):
        edge = F.col(f"_last._k{i}")
        less = (k.column > edge) if k.descending else (k.column < edge)
        nulls = (k.column.isNull() & edge.isNotNull()) if k.nulls_first else (k.column.isNotNull() & edge.isNull())
        before = before | (same & (F.coalesce(less, F.lit(False)) | nulls))
        same = same & k.column.eqNullSafe(edge)
    return df.crossJoin(last).where(before | same).drop("_last")


def distinct_limit(df: DataFrame, n: int) -> DataFrame:
    """``n`` distinct rows."""
    return df.distinct().limit(n)


def page(df: DataFrame, offset: int, n: int, *keys: Column) -> DataFrame:
    """Rows ``offset`` + 1 to ``offset`` + ``n`` in the order of ``keys``."""
    return df.orderBy(*keys).offset(offset).limit(n)
