"""Row-shape operators: inline values, single rows, unique ids, distinct markers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def values(spark: SparkSession, schema: str, rows: Sequence[Sequence]) -> DataFrame:
    """An inline table as a local relation (no job); also with no column, which keeps its number of rows."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def enforce_single_row(df: DataFrame) -> DataFrame:
    """The one row of ``df``; a row of nulls if there is none; an error if there are more.

    At most two rows are looked at.
    """
    names = df.columns
    held = df.limit(2).groupBy().agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[F.col(f"`{c}`") for c in names])).alias("_row"))
    checked = held.select(F.when(F.col("_n") <= 1, F.col("_row")).otherwise(F.raise_error(F.lit("the query returns more than one row"))).alias("_row"))
    return checked.select(*[F.col(f"_row.`{c}`").alias(c) for c in names])


def with_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """``df`` with the columns of a query of one row."""
    return df.crossJoin(F.broadcast(enforce_single_row(scalar)))


def assign_unique_id(df: DataFrame, name: str = "unique_id") -> DataFrame:
    """A bigint that no other row has; it says nothing about order."""
    return df.withColumn(name, F.monotonically_increasing_id())


def mark_distinct(df: DataFrame, keys: Sequence[str], marker: str, order_by: Sequence[Column] = ()) -> DataFrame:
    """Adds a boolean that is true for one row of each key tuple (nulls are equal): the first by ``order_by``."""
    w = Window.partitionBy(*keys).orderBy(*(order_by or [F.lit(1)]))
    return df.withColumn(marker, F.row_number().over(w) == 1)
