"""Event-time windows over streams or tables: tumbling, sliding and session windows with a watermark for late rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, size: str, keys: Sequence[str], *aggregates: Column, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Aggregates by window (and keys); with ``slide`` windows overlap.  ``late`` bounds lateness, and so the state."""
    src = df.withWatermark(time, late) if late else df
    grouped = src.groupBy(F.window(time, size, slide) if slide else F.window(time, size), *keys).agg(*aggregates)
    names = [c for c in grouped.columns if c != "window"]
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *names)


def sessions(df: DataFrame, time: str, gap: str, keys: Sequence[str], *aggregates: Column, late: str | None = None) -> DataFrame:
    """Aggregates by session: rows of the same keys with less than ``gap`` between them."""
    src = df.withWatermark(time, late) if late else df
    grouped = src.groupBy(F.session_window(time, gap), *keys).agg(*aggregates)
    names = [c for c in grouped.columns if c != "session_window"]
    return grouped.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *names)


def events_stream(spark: SparkSession, folder: str, schema, max_files: int = 8) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def dedup(df: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """The first row of each key tuple within the lateness bound."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
