"""Splits, empty files and filters that reach the readers of text formats."""

import pytest
from pyspark.sql import functions as F

from quarry.sources.files import reader_of, scan


def test_large_files_are_split_and_empty_ones_read(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(200_000).withColumn("x", F.rand(3)).coalesce(1).write.option("parquet.block.size", str(64 << 10)).parquet(path)
    spark.range(0).withColumn("x", F.rand(3)).write.mode("append").parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 << 10))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = scan(spark, path)
        assert df.rdd.getNumPartitions() > 4 and df.count() == 200_000
        # row groups beyond the filter are not read: its range is in their statistics
        assert scan(spark, path, where=F.col("id") > 199_990).count() == 9
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_filters_and_columns_reach_text_readers(spark, tmp_path, kind):
    path = f"file://{tmp_path}/{kind}"
    spark.range(50).selectExpr("id", "id % 7 AS k", "'t' || id AS s").write.format(kind).save(path)
    df = scan(spark, path, kind, columns=["id"], where=F.col("k") == 3, schema="id bigint, k bigint, s string")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,3)" in plan.split("PushedFilters")[1] and "ReadSchema: struct<id:bigint,k:bigint>" in plan
    assert sorted(r.id for r in df.collect()) == list(range(3, 50, 7))


@pytest.mark.parametrize("name", ["org.apache.hadoop.hive.ql.io.avro.AvroContainerInputFormat", "org.apache.hadoop.hive.ql.io.RCFileInputFormat", "unknown"])
def test_formats_without_a_reader_are_refused(name):
    with pytest.raises(ValueError, match="no reader for"):
        reader_of(name)
