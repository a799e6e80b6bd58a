"""Partitioning: gather, hash, round robin, merge, and the bucket functions of the generated and bucketed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gather(df: DataFrame) -> DataFrame:
    """One partition, without a shuffle."""
    return df.coalesce(1)


def hashed(df: DataFrame, keys: Sequence[str], n: int | None = None) -> DataFrame:
    """Rows of equal keys in one partition; without ``n`` the adaptive planner sizes the partitions."""
    return df.repartition(n, *keys) if n else df.repartition(*keys)


def round_robin(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def merged(df: DataFrame, *keys: Column) -> DataFrame:
    """A total order over all partitions (range exchange and local sorts)."""
    return df.orderBy(*keys)


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all inputs; columns are taken by name, in the order of the first."""
    for o in others:
        first = first.unionAll(o.select(*first.columns))
    return first


def tpch_row(key: str | Column) -> Column:
    """The row of an order key, which uses eight of every thirty-two numbers."""
    k = F.col(key) if isinstance(key, str) else key
    k = k.cast("long")
    return F.shiftright(k.bitwiseAND(F.lit(~31)), 2).bitwiseOR(k.bitwiseAND(F.lit(7))) - 1


def tpch_bucket(key: str | Column, rows_per_bucket: int, bucket_to_partition: Sequence[int]) -> Column:
    """The partition of an order key: null goes to partition 0, rows beyond the last bucket to the last."""
    k = F.col(key) if isinstance(key, str) else key
    row = tpch_row(k)
    quotient = F.call_function("div", row, F.lit(rows_per_bucket).cast("long")).cast("int")
    bucket = F.least(quotient, F.lit(len(bucket_to_partition) - 1))
    place = F.array(*[F.lit(int(p)) for p in bucket_to_partition])
    return F.when(k.isNull(), F.lit(0)).otherwise(F.element_at(place, bucket + 1))


def _hive_hash(k: Column, kind: str) -> Column:
    """The hash of a value in a Hive table, as 32 bits; of a null 0."""
    if kind in ("tinyint", "smallint", "int", "integer"):
        h = k.cast("long")
    elif kind == "date":
        h = F.unix_date(k).cast("long")
    elif kind == "bigint":
        h = k.bitwiseXOR(F.shiftrightunsigned(k, 32))
    elif kind == "boolean":
        h = k.cast("int").cast("long")
    elif kind == "timestamp":
        # whole seconds, and below them in 30 bits the nanoseconds
        micros = F.unix_micros(k.cast("timestamp"))
        second = F.floor(micros / 1_000_000).cast("long")
        both = F.shiftleft(second, 30).bitwiseOR((micros - second * 1_000_000) * 1000)
        h = F.shiftrightunsigned(both, 32).bitwiseXOR(both)
    elif kind in ("string", "varchar"):
        # the UTF-8 bytes, signed
        byte = F.transform(F.regexp_extract_all(F.hex(F.encode(k, "UTF-8")), F.lit("(..)")), lambda x: F.conv(x, 16, 10).cast("long"))
        h = F.aggregate(byte, F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + c - F.when(c > 127, 256).otherwise(0), F.lit(1 << 32)))
    else:
        raise ValueError(f"no Hive hash for {kind}")
    return F.coalesce(h, F.lit(0).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF))


def hive_bucket(key: str | Column | Sequence[str | Column], buckets: int, kind: str | Sequence[str]) -> Column:
    """The bucket of a Hive table clustered by one column or several, of the kinds that ``_hive_hash`` knows."""
    keys, kinds = ([key], [kind]) if isinstance(kind, str) else (list(key), list(kind))
    h = F.lit(0).cast("long")
    for k, t in zip(keys, kinds, strict=True):
        h = (h * 31 + _hive_hash(F.col(k) if isinstance(k, str) else k, t)).bitwiseAND(F.lit(0xFFFFFFFF))
    return (h.bitwiseAND(F.lit(0x7FFFFFFF)) % buckets).cast("int")


def by_handle(df: DataFrame, handle: str, keys: Sequence[str | Column] = (), n: int | None = None) -> DataFrame:
    """Partitions by the name of a partitioning: ``SINGLE``, ``FIXED_HASH`` (keys may be constants) or
    ``FIXED_ARBITRARY``; an error for others."""
    if handle == "SINGLE":
        return gather(df)
    if handle == "FIXED_HASH" and keys:
        return df.repartition(n, *keys) if n else df.repartition(*keys)
    if handle == "FIXED_ARBITRARY":
        return df.repartition(n) if n else df.repartition(F.spark_partition_id())
    raise ValueError(f"unsupported partitioning {handle}")
