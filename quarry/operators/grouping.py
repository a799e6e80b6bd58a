"""Grouping sets.  The empty set gives a row even over no rows, as the dialect asks."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], *aggregates: Column, group_id: str | None = None) -> DataFrame:
    """One row for each group of each set: keys absent from a set are null.

    ``group_id`` names a bigint with, from the left, a bit for each key (in the order of first mention) that is 1
    where the set lacks it.  Sets with keys share one expansion of the rows; the empty set is an aggregate of its own.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    full = [list(s) for s in sets if s]
    marks = [F.lit(0).cast("long").alias(group_id)] if group_id else []
    parts = []
    if full:
        grouped = df.groupingSets([[F.col(k) for k in s] for s in full], *[F.col(k) for k in keys])
        parts.append(grouped.agg(*([F.grouping_id().cast("long").alias(group_id)] if group_id else []), *aggregates))
    if len(full) < len(sets):
        types = {f.name: f.dataType for f in df.schema.fields}
        whole = df.groupBy().agg(*aggregates)
        head = [F.lit(None).cast(types[k]).alias(k) for k in keys]
        mark = [F.lit((1 << len(keys)) - 1).cast("long").alias(group_id)] if group_id else []
        parts.extend([whole.select(*head, *mark, *whole.columns)] * (len(sets) - len(full)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    assert not marks or group_id in out.columns
    return out


def rollup(df: DataFrame, keys: Sequence[str], *aggregates: Column, group_id: str | None = None) -> DataFrame:
    return grouping_sets(df, [keys[:n] for n in range(len(keys), -1, -1)], *aggregates, group_id=group_id)


def cube(df: DataFrame, keys: Sequence[str], *aggregates: Column, group_id: str | None = None) -> DataFrame:
    return grouping_sets(df, [list(c) for n in range(len(keys), -1, -1) for c in combinations(keys, n)], *aggregates, group_id=group_id)


def group_id_rows(df: DataFrame, sets: Sequence[Sequence[str]], arguments: Sequence[str], group_id: str) -> DataFrame:
    """The rows themselves, repeated for each set: its keys kept, others null, arguments as they are, and the set's
    number.  Argument columns that are also keys are named with ``_arg`` behind."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = F.array(*[F.struct(*[(F.col(k) if k in s else F.lit(None).cast(types[k])).alias(k) for k in keys], F.lit(i).cast("long").alias(group_id)) for i, s in enumerate(sets)])
    return df.select(*[F.col(a).alias(f"{a}_arg" if a in keys else a) for a in arguments], F.inline(rows))
