"""Aggregates of the Presto dialect as expressions over built-in ones.

All return a ``Column`` for ``groupBy().agg()``; those that collect hold a group's values in one row, which is what
their result is made of anyway.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def typed_sum(x: str | Column, kind: str) -> Column:
    """The sum in the dialect's type: integers of any width give bigint, real gives real, double gives double."""
    if kind in ("tinyint", "smallint", "int", "integer", "bigint"):
        return F.sum(_c(x).cast("bigint"))
    if kind in ("real", "float"):
        return F.sum(_c(x).cast("double")).cast("float")
    return F.sum(_c(x))


def partial_sum(x: str | Column) -> Column:
    """The state (sum, count) of a partial sum or average."""
    return F.struct(F.sum(_c(x)).alias("sum"), F.count(_c(x)).alias("count"))


def merge_sum(state: str) -> Column:
    """The final sum of partial states; null if no value was counted."""
    return F.when(F.sum(f"{state}.count") > 0, F.sum(f"{state}.sum"))


def merge_avg(state: str) -> Column:
    return F.when(F.sum(f"{state}.count") > 0, F.sum(f"{state}.sum") / F.sum(f"{state}.count"))


def partial_variance(x: str | Column) -> Column:
    """The state (count, mean, sum of squared differences from it) of the variance family."""
    n, c = F.count(_c(x)), _c(x).cast("double")
    return F.struct(n.alias("count"), F.avg(c).alias("mean"), (F.var_pop(c) * n).alias("m2"))


def merge_variance(state: str, sample: bool = True) -> Column:
    """The variance of partial states; null for fewer values than it needs."""
    n = F.sum(f"{state}.count")
    total = F.sum(F.col(f"{state}.count") * F.col(f"{state}.mean"))
    square = F.sum(F.col(f"{state}.count") * F.col(f"{state}.mean") * F.col(f"{state}.mean"))
    m2 = F.sum(f"{state}.m2") + square - total * total / n
    return F.when(n > (1 if sample else 0), F.greatest(m2, F.lit(0.0)) / (n - 1 if sample else n))


def masked(aggregate: Callable[[Column], Column], x: str | Column, mask: Column) -> Column:
    """An aggregate over the values whose mask is true."""
    return aggregate(F.when(mask, _c(x)))


def decimal_avg(x: str | Column, precision: int, scale: int) -> Column:
    """The average of a decimal, in its own type, rounded half up."""
    return F.round(F.avg(_c(x)), scale).cast(f"decimal({precision},{scale})")


def array_agg(x: str | Column, *keys: Column) -> Column:
    """All values, nulls too; in the order of ``keys`` (ascending) if given."""
    item = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], _c(x).alias("v"))
    rows = F.collect_list(item)
    return F.transform(F.sort_array(rows) if keys else rows, lambda r: r["v"])


def set_agg(x: str | Column) -> Column:
    """Distinct values, a null among them if there is one."""
    return F.array_distinct(array_agg(x))


def set_union(x: str | Column) -> Column:
    return F.array_distinct(F.flatten(F.collect_list(_c(x))))


def map_agg(key: str | Column, value: str | Column) -> Column:
    """Key to value; of a repeated key one value is kept, null keys are left out."""
    pairs = F.collect_list(F.when(_c(key).isNotNull(), F.struct(_c(key).alias("k"), _c(value).alias("v"))))
    return F.aggregate(pairs, F.map_from_entries(F.slice(pairs, 1, 0)), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))


def map_union(x: str | Column) -> Column:
    """All entries of all maps; of a repeated key one value is kept."""
    maps = F.collect_list(_c(x))
    nothing = F.map_filter(F.element_at(maps, 1), lambda k, v: F.lit(False))
    return F.when(F.size(maps) > 0, F.aggregate(maps, nothing, lambda m, n: F.map_concat(F.map_filter(m, lambda k, _: ~F.map_contains_key(n, k)), n)))


def reduce_agg(x: str | Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """A fold over the non-null values; ``step`` must not depend on their order."""
    return F.aggregate(F.collect_list(_c(x)), zero, step)


def min_by(x: str | Column, by: str | Column, tie: Column) -> Column:
    """``x`` of the least ``by``; of equal ones that of the least ``tie``, so that reruns agree."""
    return F.min_by(_c(x), F.when(_c(by).isNotNull(), F.struct(_c(by), tie)))


def max_by(x: str | Column, by: str | Column, tie: Column) -> Column:
    """``x`` of the greatest ``by``; of equal ones that of the least ``tie`` (a number)."""
    return F.max_by(_c(x), F.when(_c(by).isNotNull(), F.struct(_c(by), -tie)))


def _extreme(df: DataFrame, groups: list[str], x: str | Column, by: str | Column, n: int, name: str, down: bool, tie: list[Column] | None = None, shown: list[Column] | None = None) -> DataFrame:
    """Rank first, then collect: each task keeps ``n`` rows of a group, so no group is gathered whole.

    ``tie`` orders rows of equal ``by`` (else ``x`` does, in the same direction), ``shown`` those that are kept.
    """
    far = lambda c: c.desc() if down else c.asc()
    ties = {f"_tie{i}": t for i, t in enumerate(tie or [])} | {f"_show{i}": t for i, t in enumerate(shown or [])}
    rows = df.select(*groups, _c(x).alias("_x"), _c(by).alias("_by"), *[t.alias(c) for c, t in ties.items()]).where(F.col("_by").isNotNull())
    w, last = Window.partitionBy(*groups), [c for c in ties if c.startswith("_tie")] or [far(F.col("_x"))]
    kept = rows.withColumn("_rank", F.row_number().over(w.orderBy(far(F.col("_by")), *last))).where(F.col("_rank") <= n)
    if shown:
        kept = kept.withColumn("_rank", F.row_number().over(w.orderBy(far(F.col("_by")), *[c for c in ties if c.startswith("_show")])))
    return kept.groupBy(*groups).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "_x"))), lambda r: r["_x"]).alias(name))


def least_n(df: DataFrame, groups: list[str], x: str | Column, n: int, name: str) -> DataFrame:
    """For each group its ``n`` least values, ascending; a group of nulls only has no row."""
    return _extreme(df, groups, x, x, n, name, False)


def greatest_n(df: DataFrame, groups: list[str], x: str | Column, n: int, name: str) -> DataFrame:
    """For each group its ``n`` greatest values, descending."""
    return _extreme(df, groups, x, x, n, name, True)


def min_by_n(df: DataFrame, groups: list[str], x: str | Column, by: str | Column, n: int, name: str, tie: list[Column] | None = None, shown: list[Column] | None = None) -> DataFrame:
    """For each group ``x`` of the ``n`` least ``by``, ascending; of equal ones the least ``x``, or as ``tie`` orders them."""
    return _extreme(df, groups, x, by, n, name, False, tie, shown)


def max_by_n(df: DataFrame, groups: list[str], x: str | Column, by: str | Column, n: int, name: str, tie: list[Column] | None = None, shown: list[Column] | None = None) -> DataFrame:
    """For each group ``x`` of the ``n`` greatest ``by``, descending; of equal ones the greatest ``x``, or as ``tie`` orders them."""
    return _extreme(df, groups, x, by, n, name, True, tie, shown)


def geometric_mean(x: str | Column) -> Column:
    return F.exp(F.avg(F.ln(_c(x))))


def sample_kurtosis(x: str | Column) -> Column:
    """Excess kurtosis with the sample correction; null for fewer than four values."""
    n, g = F.count(_c(x)).cast("double"), F.kurtosis(_c(x))
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))


def checksum(*x: str | Column) -> Column:
    """A value of the rows that their order does not change, and each row's repetition does: the sum of their hashes,
    wrapped to 64 bits (not the value of another engine)."""
    whole = F.lit(str(1 << 64)).cast("decimal(38,0)")
    total = F.pmod(F.sum(F.xxhash64(*[_c(c) for c in x]).cast("decimal(20,0)")).cast("decimal(38,0)"), whole)
    return F.when(total >= F.lit(str(1 << 63)).cast("decimal(38,0)"), total - whole).otherwise(total).cast("bigint")


def histogram(df: DataFrame, groups: list[str], x: str, name: str) -> DataFrame:
    """For each group a map of value to number of rows: counted first, so that only distinct values are collected."""
    counted = df.where(F.col(x).isNotNull()).groupBy(*groups, x).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*groups).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(x, "_n")))).alias(name))


def multimap_agg(df: DataFrame, groups: list[str], key: str, value: str, name: str) -> DataFrame:
    """For each group a map of key to the (sorted) values."""
    inner = df.where(F.col(key).isNotNull()).groupBy(*groups, key).agg(F.sort_array(F.collect_list(value)).alias("_v"))
    return inner.groupBy(*groups).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "_v")))).alias(name))


def map_union_sum(df: DataFrame, groups: list[str], x: str, name: str) -> DataFrame:
    """For each group the sums of the maps' values by key."""
    entry = df.select(*groups, F.explode(x).alias("_k", "_v"))
    summed = entry.groupBy(*groups, "_k").agg(F.sum("_v").alias("_v"))
    return summed.groupBy(*groups).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_v")))).alias(name))


def entropy(df: DataFrame, groups: list[str], count: str, name: str) -> DataFrame:
    """Binary entropy of the non-negative counts in each group."""
    totals = F.sum(count)
    c = F.col(count).cast("double")
    weighted = F.sum(F.when(c > 0, c * F.log2(c)).otherwise(0.0))
    return df.groupBy(*groups).agg(F.when(totals > 0, F.log2(totals.cast("double")) - weighted / totals).otherwise(0.0).alias(name))


def approx_most_frequent(df: DataFrame, groups: list[str], x: str, n: int, name: str) -> DataFrame:
    """For each group a map of its ``n`` most frequent values to their (exact) counts; of equal ones the least values.

    Counted, then ranked: each task keeps ``n`` of a group's values before they are collected.
    """
    counted = df.groupBy(*groups, F.col(x).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("_n"), "_k"))
    top = counted.withColumn("_rank", rank).where(F.col("_rank") <= n).groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("_rank", "_k", "_n"))).alias("_t"))
    return top.select(*groups, F.map_from_entries(F.transform("_t", lambda r: F.struct(r["_k"], r["_n"]))).alias(name))


def percentiles(df: DataFrame, groups: list[str], x: str, fractions: list[float], name: str) -> DataFrame:
    """For each group an array of its values at ``fractions`` of the rows in order, exactly; nulls of none.

    Counted first, so that only distinct values are put in order.
    """
    inner, total = df.groupBy(*groups, x).agg(F.count(x).alias("_n")), F.sum("_n").over(Window.partitionBy(*groups))
    upto = F.sum("_n").over(Window.partitionBy(*groups).orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    placed = inner.withColumn("_total", total.cast("double")).withColumn("_upto", upto)
    at = lambda f: F.greatest(F.col("_total") - F.floor(F.col("_total") - F.col("_total") * f), F.lit(1.0))
    return placed.groupBy(*groups).agg(F.array(*[F.min(F.when(F.col("_upto") >= at(f), F.col(x))) for f in fractions]).alias(name))


def beside(df: DataFrame, more: DataFrame, groups: list[str]) -> DataFrame:
    """The columns of ``more``, one row a group, beside those of ``df``; a null group is a group too."""
    keys = [f"_key{i}" for i in range(len(groups))]
    on = F.lit(True)
    for g, k in zip(groups, keys, strict=True):
        on = on & F.col(g).eqNullSafe(F.col(k))
    return df.join(more.withColumnsRenamed(dict(zip(groups, keys, strict=True))), on, "left").drop(*keys)


def approx_set(x: str | Column, size: int = 12) -> Column:
    """A sketch of the distinct values, which ``merge`` unites; that of no rows is the empty sketch."""
    return F.hll_sketch_agg(_c(x), F.lit(size))


def merge(sketch: str | Column) -> Column:
    return F.hll_union_agg(_c(sketch))


def cardinality(sketch: str | Column) -> Column:
    return F.hll_sketch_estimate(_c(sketch))


def listagg(x: str | Column, separator: str, *keys: Column) -> Column:
    """The values in the order of ``keys`` as one text; nulls are left out, and of none the result is null."""
    kept = F.filter(array_agg(x, *keys), lambda v: v.isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(kept, separator))
