"""Bounded, repeatable samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Pieces into which the rows of a label are dealt before its sample is drawn from theirs.
PIECES = 64


def fold(of: int) -> Column:
    """crc32 of the doc_id as text, modulo ``of``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def _least(rows: DataFrame, per_label: int, *order: str) -> DataFrame:
    """Of each label the first ``per_label`` rows.  Each task keeps no more of a label, and neither does each of its
    ``PIECES``, so that a label that very many rows have is not gathered by one task."""
    own = W.partitionBy("label", "_piece").orderBy(*order)
    rows = rows.withColumn("_piece", F.spark_partition_id() % PIECES).withColumn("_rank", F.row_number().over(own)).where(F.col("_rank") <= per_label)
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy("label").orderBy(*order))).where(F.col("_rank") <= per_label).drop("_piece", "_rank")


def least_hashes(labelled: DataFrame, per_label: int) -> DataFrame:
    """For each value of ``label`` the ``per_label`` rows (doc_id, label) of the least hash of their doc_id, in one pass;
    equal rows are one."""
    return _least(labelled.select("doc_id", "label", F.xxhash64("doc_id").alias("_h")), per_label, "_h", "doc_id").select("doc_id", "label").distinct()


def texts_of(docs: DataFrame, chosen: DataFrame, per_label: int, on: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(text, label, h) of the chosen rows, which are at most ``per_label`` a label, so they are sent to every executor.
    Of an id that very many rows repeat no more than ``per_label`` texts are taken either; h orders the sample."""
    rows = docs.join(F.broadcast(chosen), list(on)).select("text", "label", F.xxhash64("doc_id", "text").alias("_h"), F.xxhash64("doc_id", F.lit(3)).alias("h"))
    return _least(rows, per_label, "_h").select("text", "label", "h")
