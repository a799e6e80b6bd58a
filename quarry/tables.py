"""The data set's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a lazy scan; columns and filters of the query reach the Parquet reader."""
    return spark.read.parquet(path(sf_dir, name))


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = NAMES) -> None:
    """Temporary views of the tables, for SQL."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
