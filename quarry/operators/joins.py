"""Joins beyond the built-in ones: mark joins, null-aware anti joins, range and as-of joins, checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes, by the optimizer's estimate, up to which a side is sent to every executor.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its estimated size is at most ``most``; else, and where no estimate can be had (a
    remote client), the planner decides."""
    if not hasattr(df, "_jdf"):
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= most else df


def mark_join(source: DataFrame, filtering: DataFrame, key: str, filter_key: str, mark: str) -> DataFrame:
    """All rows of ``source`` with ``key IN (filter_key ...)`` as a value: true, false, or null.

    Null where nothing matches and the key is null or the filtering side holds a null, unless that side is empty.
    The filtering side is reduced to distinct keys and one row of facts; only that row is broadcast.
    """
    keys = filtering.select(F.col(filter_key).alias("_k")).where(F.col("_k").isNotNull()).distinct().withColumn("_hit", F.lit(True))
    facts = filtering.groupBy().agg(F.count(F.lit(1)).alias("_rows"), F.count_if(F.col(filter_key).isNull()).alias("_nulls"))
    joined = source.join(keys, source[key] == keys["_k"], "left").crossJoin(F.broadcast(facts))
    unknown = (F.col("_rows") > 0) & (source[key].isNull() | (F.col("_nulls") > 0))
    value = F.when(F.col("_hit"), True).when(unknown, F.lit(None).cast("boolean")).otherwise(False)
    return joined.withColumn(mark, value).drop("_k", "_hit", "_rows", "_nulls")


def semi_join(source: DataFrame, filtering: DataFrame, key: str, filter_key: str) -> DataFrame:
    """Rows whose key is in the filtering side."""
    return source.join(filtering.select(F.col(filter_key).alias("_k")), F.col(key) == F.col("_k"), "left_semi")


def null_aware_anti_join(source: DataFrame, filtering: DataFrame, key: str, filter_key: str) -> DataFrame:
    """``key NOT IN (filter_key ...)``: no row if the filtering side holds a null, no row with a null key unless that
    side is empty.  A plain anti join and one row of facts, so neither side must fit in memory."""
    facts = filtering.groupBy().agg(F.count(F.lit(1)).alias("_rows"), F.count_if(F.col(filter_key).isNull()).alias("_nulls"))
    left = source.join(filtering.select(F.col(filter_key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    return left.crossJoin(F.broadcast(facts)).where((F.col("_rows") == 0) | ((F.col("_nulls") == 0) & F.col(key).isNotNull())).drop("_rows", "_nulls")


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Pairs with ``low <= point < high`` (numbers): an equi-join on bins of ``width`` instead of a nested loop.

    A range is repeated for each bin that it touches, so ``width`` should be near the usual length of a range.
    """
    p = points.withColumn("_bin", F.floor(F.col(point) / width).cast("long"))
    r = ranges.where(F.col(low) < F.col(high)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))))
    return p.join(r, ["_bin", *(on or [])]).where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_bin")


#: Pairs of points that one task of a distance join compares, at most nearly so.
PAIRS = 20_000_000


def distance_join(left: DataFrame, right: DataFrame, at: tuple[str, str], right_at: tuple[str, str], radius: float, pairs: int = PAIRS) -> DataFrame:
    """Pairs of points at most ``radius`` apart in the plane: an equi-join on the cells of a grid of that width.

    Each row of ``right`` stands in its own cell and the eight around it, so a pair meets once.  ``right`` should be the
    smaller side; points without a coordinate are in no pair.  The cells are counted first.  A cell of more than ``pairs``
    pairs is cut into blocks: rows fall by their hash into parts of the left and of the right, and each two parts meet
    once.  There are as many tasks as the pairs need, so a task's work does not grow with the input (rows equal in every
    column stay together).
    """
    width = radius * (1 + 2**-30)  # differences are rounded: a pair just at the radius must not be two cells apart

    def cell(c: str) -> Column:
        return F.floor(F.col(c) / width).cast("long")

    def part(df: DataFrame, count: str) -> Column:
        return F.pmod(F.xxhash64(*df.columns), F.coalesce(F.col(count), F.lit(1)).cast("long"))

    def all_parts(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(count), F.lit(1)).cast("long") - 1))

    grid, steps = ["_cx", "_cy"], F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])

    def near(df: DataFrame) -> DataFrame:
        b = df.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
        return b.withColumn("_cx", F.col("_cx") + F.col("_dx")).withColumn("_cy", F.col("_cy") + F.col("_dy")).drop("_dx", "_dy")

    a = left.withColumn("_cx", cell(at[0])).withColumn("_cy", cell(at[1]))
    b = right.withColumn("_cx", cell(right_at[0])).withColumn("_cy", cell(right_at[1]))
    held = a.groupBy(*grid).agg(F.count(F.lit(1)).cast("double").alias("_m"))
    met = near(b.groupBy(*grid).agg(F.count(F.lit(1)).cast("double").alias("_n"))).groupBy(*grid).agg(F.sum("_n").alias("_n"))
    cells = held.join(met, grid)
    tasks = max(int((cells.agg(F.sum(F.col("_m") * F.col("_n"))).first()[0] or 0) / pairs), left.sparkSession.sparkContext.defaultParallelism)
    # no more large cells than tasks; parts in proportion to the rows of both sides, so that a block is near a square
    blocks = F.col("_m") * F.col("_n") / pairs
    large = cells.where(blocks > 1).select(*grid, F.greatest(F.lit(1.0), F.least(F.sqrt(blocks * F.col("_m") / F.col("_n")), blocks)).alias("_l"), blocks.alias("_k"))
    large = F.broadcast(large.select(*grid, F.ceil("_l").alias("_l"), F.ceil(F.col("_k") / F.col("_l")).alias("_r")))
    a = a.join(large, grid, "left").withColumn("_i", part(left, "_l")).withColumn("_j", all_parts("_r")).drop("_l", "_r")
    b = near(b).join(large, grid, "left").withColumn("_j", part(right, "_r")).withColumn("_i", all_parts("_l")).drop("_l", "_r")
    on = [*grid, "_i", "_j"]
    apart = [F.col(x) - F.col(y) for x, y in zip(at, right_at, strict=True)]
    met = a.repartition(tasks, *on).join(b.repartition(tasks, *on).hint("shuffle_hash"), on)
    return met.where(apart[0] * apart[0] + apart[1] * apart[1] <= radius * radius).drop(*on)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, right_time: str, take: list[str], tie: list[Column] | None = None, slice_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each row of ``left`` with ``take`` of the latest row of ``right`` of the same ``by`` and ``right_time <= time``
    (nulls if there is none, or no time).  One shuffle by key: both sides are merged and the last right row is carried on.

    A key of very many rows would be one task; ``slice_of``, a function of the time that never falls (such as its day),
    splits it: rows are merged within slices, and the last right row of each slice, one row for each key and slice, is
    carried to those after it.
    """
    own = [c for c in left.columns if c not in by]
    nothing = F.lit(None).cast(left.select(F.struct(*own)).schema[0].dataType)
    carried = right.select(F.struct(*take)).schema[0].dataType
    right = right.where(F.col(right_time).isNotNull())
    a = left.select(*by, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*own).alias("_l"), F.lit(None).cast(carried).alias("_r"), F.lit(0).alias("_tie"))
    rank = F.row_number().over(Window.partitionBy(*by, right_time).orderBy(*tie)) if tie else F.lit(0)
    b = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), nothing.alias("_l"), F.struct(*take).alias("_r"), rank.alias("_tie"))
    parts = [*by] if slice_of is None else [*by, "_slice"]
    rows = a.unionByName(b)
    if slice_of is not None:
        rows = rows.withColumn("_slice", slice_of(F.col("_t")))
    w = Window.partitionBy(*parts).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    merged = rows.withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    if slice_of is not None:
        end = F.max_by("_r", F.when(F.col("_side") == 0, F.struct("_t", "_tie")))
        before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        ends = rows.groupBy(*parts).agg(end.alias("_end")).withColumn("_before", F.last("_end", ignorenulls=True).over(before))
        ends = ends.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(parts)], "_before")
        on = F.lit(True)
        for i, c in enumerate(parts):
            on = on & merged[c].eqNullSafe(ends[f"_p{i}"])
        merged = merged.join(ends, on, "left").withColumn("_last", F.coalesce("_last", F.when(F.col("_t").isNotNull(), F.col("_before"))))
    return merged.select(*by, "_l.*", *[F.col(f"_last.{c}").alias(c) for c in take])
