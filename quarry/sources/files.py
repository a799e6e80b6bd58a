"""File sources and sinks: Parquet, ORC, CSV, JSON, text; partitioned and bucketed tables; file columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .types import parse

FORMATS = ("parquet", "orc", "csv", "json", "text")
#: Hive input formats and the reader that serves them.
INPUT_FORMATS = {
    "org.apache.hadoop.hive.ql.io.parquet.MapredParquetInputFormat": "parquet",
    "org.apache.hadoop.hive.ql.io.orc.OrcInputFormat": "orc",
    "com.facebook.hive.orc.OrcInputFormat": "orc",
    "org.apache.hadoop.mapred.TextInputFormat": "csv",
}


def reader_of(input_format: str) -> str:
    """The reader for a Hive input format; an error for those without one."""
    if input_format not in INPUT_FORMATS:
        raise ValueError(f"no reader for {input_format}")
    return INPUT_FORMATS[input_format]


def schema_of(columns: dict[str, str]) -> StructType:
    """A schema from column names and type signatures."""
    out = StructType()
    for name, signature in columns.items():
        out = out.add(name, parse(signature))
    return out


def scan(spark: SparkSession, path: str, kind: str = "parquet", columns: Sequence[str] | None = None, where: Column | None = None, schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A scan that reads only ``columns`` and gives ``where`` to the reader.  Text formats need a ``schema``: none is
    guessed, as that would read the files twice."""
    if kind not in FORMATS:
        raise ValueError(f"no reader for {kind}")
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    r = spark.read.format(kind).options(**options)
    df = (r.schema(schema) if schema is not None else r).load(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def with_file_columns(df: DataFrame) -> DataFrame:
    """Adds the synthesized columns path, file size and modification time of each row's file."""
    return df.select("*", F.col("_metadata.file_path").alias("$path"), F.col("_metadata.file_size").alias("$file_size"), F.col("_metadata.file_modification_time").alias("$file_modified_time"))


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists", **options: str) -> None:
    """CREATE TABLE AS to files; rows of a partition value are brought together first, so each has few files."""
    if partition_by:
        df = df.repartition(*partition_by)
    w = df.write.mode(mode).format(kind).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def insert(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """INSERT INTO files."""
    write(df, path, kind, partition_by, mode="append")


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int) -> None:
    """A bucketed and sorted table: joins and aggregations on ``keys`` need no shuffle."""
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)


def partition_value(text: str | None, signature: str) -> Column:
    """A partition value as it is stored in a path: the default partition and an empty text are null."""
    c = F.lit(text)
    null = F.lit(None).cast(parse(signature))
    return null if text in (None, "", r"\N", "__HIVE_DEFAULT_PARTITION__") else c.cast(parse(signature))
