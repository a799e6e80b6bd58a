"""Window helpers: GROUPS frames, column-valued frame bounds, and top-n by each of the three rankings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, aggregate: Column, partition: Sequence[str], order: Sequence[Column], start: int, end: int, name: str) -> DataFrame:
    """``aggregate`` over the peers from ``start`` to ``end`` groups away: a RANGE frame over the rows' dense rank."""
    base = Window.partitionBy(*partition).orderBy(*order)
    ranked = df.withColumn("_group", F.dense_rank().over(base).cast("long"))
    frame = Window.partitionBy(*partition).orderBy("_group").rangeBetween(start, end)
    return ranked.withColumn(name, aggregate.over(frame)).drop("_group")


#: How the values of a frame become one, as the dialect's aggregates do: nulls are left out, and of none the result is null.
def fold_sum(values: Column) -> Column:
    kept = F.filter(values, lambda v: v.isNotNull())
    first = F.element_at(kept, 1) + F.lit(0).cast("tinyint")  # a sum starts from zero, so that of -0.0 alone is 0.0
    return F.when(F.size(kept) > 0, F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), first, lambda s, v: s + v))


def fold_avg(values: Column) -> Column:
    return fold_sum(F.transform(values, lambda v: v.cast("double"))) / F.size(F.filter(values, lambda v: v.isNotNull()))


def fold_count(values: Column) -> Column:
    return F.size(F.filter(values, lambda v: v.isNotNull())).cast("bigint")


def fold_max(values: Column) -> Column:
    return F.array_max(F.reverse(values))  # of zeros of both signs the last


def varying_rows(df: DataFrame, x: str | Column, fold: Callable[[Column], Column], partition: Sequence[str], order: Sequence[Column], before: str | Column, after: str | Column, name: str) -> DataFrame:
    """``fold`` of ``x`` over ROWS BETWEEN <before> PRECEDING AND <after> FOLLOWING, both columns of whole numbers.

    A negative bound lies on the other side of the row; a null one, and a frame without rows, give an empty frame.  The
    widest bounds of the data (one aggregate) frame one window, which collects its values; each row then takes its own
    part of them.  So nothing is subtracted, no join is made, and memory for a row is that of the widest frame.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    col = lambda c: F.col(c) if isinstance(c, str) else c
    placed = df.withColumn("_x", F.struct(col(x).alias("v"))).withColumn("_b", col(before).cast("long")).withColumn("_a", col(after).cast("long"))
    most = placed.agg(F.max("_b").alias("b"), F.max("_a").alias("a")).first()
    b, a = max(most.b or 0, 0), max(most.a or 0, 0)
    placed = placed.withColumn("_place", F.row_number().over(w).cast("long")).withColumn("_rows", F.collect_list("_x").over(w.rowsBetween(-b, a)))
    # the row itself stands at this place of what was collected
    here = F.least(F.col("_place"), F.lit(b + 1))
    start, stop = F.greatest(here - F.col("_b"), F.lit(1)), F.least(here + F.col("_a"), F.size("_rows"))
    own = F.transform(F.slice("_rows", start.cast("int"), F.greatest(stop - start + 1, F.lit(0)).cast("int")), lambda r: r["v"])
    none = F.transform(F.slice("_rows", 1, 0), lambda r: r["v"])
    own = F.when(F.col("_b").isNotNull() & F.col("_a").isNotNull(), own)
    return placed.withColumn(name, fold(F.coalesce(own, none))).drop("_x", "_a", "_b", "_place", "_rows")


def ignore_nulls(function: str, x: str, offset: int, partition: Sequence[str], order: Sequence[str]) -> Column:
    """lag, lead or nth_value (of the whole partition) over the rows whose ``x`` is not null.  ``x``, ``partition`` and
    ``order`` are SQL."""
    frame = " ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING" if function == "nth_value" else ""
    return F.expr(f"{function}({x}, {offset}) IGNORE NULLS OVER (PARTITION BY {', '.join(partition)} ORDER BY {', '.join(order)}{frame})")


def row_number(df: DataFrame, partition: Sequence[str], name: str, most: int | None = None) -> DataFrame:
    """Numbers the rows of each partition in no particular order; ``most``: and keeps so many."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(F.lit(1))).cast("long"))
    return out if most is None else out.where(F.col(name) <= most)


def top_n_ranking(df: DataFrame, ranking: str, partition: Sequence[str], order: Sequence[Column], n: int, name: str) -> DataFrame:
    """Rows whose ``ranking`` (row_number, rank, dense_rank) is at most ``n``.

    Stated as a filter on the rank, which the planner turns into a limit of each group before the shuffle.
    """
    rank = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[ranking]()
    return df.withColumn(name, rank.over(Window.partitionBy(*partition).orderBy(*order))).where(F.col(name) <= n)
