"""Queries of sources, sinks and event-time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.mathematics import rounded
from ..registry import query
from ..sources.files import insert, partition_value, scan, schema_of, write, write_bucketed
from ..sources.scratch import scratch
from ..streaming.windows import events_stream, sessions, tumbling
from ..tables import path, table

T = table
_SUPPLIER = "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0"
_COLUMNS = {"s_suppkey": "bigint", "s_name": "varchar(25)", "s_nationkey": "integer", "s_acctbal": "double"}


def _round_trip(spark, sf, kind, **options):
    where = scratch(spark, f"supplier-{kind}")
    write(T(spark, sf, "supplier").select(*_COLUMNS), where, kind, **options)
    schema = schema_of(_COLUMNS) if kind in ("csv", "json") else None
    return scan(spark, where, kind, ["s_suppkey", "s_name", "s_acctbal"], F.col("s_acctbal") > 0, schema, **options)


@query("source_parquet", _SUPPLIER)
def source_parquet(spark, sf):
    return scan(spark, path(sf, "supplier"), "parquet", ["s_suppkey", "s_name", "s_acctbal"], F.col("s_acctbal") > 0)


@query("source_orc", _SUPPLIER)
def source_orc(spark, sf):
    return _round_trip(spark, sf, "orc")


@query("source_csv", _SUPPLIER)
def source_csv(spark, sf):
    return _round_trip(spark, sf, "csv", header="true")


@query("source_json", _SUPPLIER)
def source_json(spark, sf):
    return _round_trip(spark, sf, "json")


@query("source_text", "SELECT n_name AS value FROM nation")
def source_text(spark, sf):
    where = scratch(spark, "nation-text")
    write(T(spark, sf, "nation").select("n_name"), where, "text")
    return scan(spark, where, "text")


@query("source_partitioned", "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def source_partitioned(spark, sf):
    where = scratch(spark, "orders-by-status")
    write(T(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), where, partition_by=["o_orderstatus"])
    return scan(spark, where, columns=["o_orderkey", "o_orderpriority", "o_orderstatus"], where=F.col("o_orderstatus") == "P")


@query("source_null_partition", "SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation WHERE n_regionkey IN (2, 3)")
def source_null_partition(spark, sf):
    where = scratch(spark, "nation-by-region")
    write(T(spark, sf, "nation").select("n_nationkey", F.nullif("n_regionkey", F.lit(2)).alias("r")), where, partition_by=["r"])
    return scan(spark, where, where=F.col("r").isNull() | (F.col("r") == 3))


@query("partition_values", "SELECT NULL::INTEGER AS a, NULL::INTEGER AS b, 7 AS c, DATE '2020-01-02' AS d")
def partition_values(spark, sf):
    v = partition_value
    return T(spark, sf, "region").limit(1).select(v("", "integer").alias("a"), v(r"\N", "integer").alias("b"), v("7", "integer").alias("c"), v("2020-01-02", "date").alias("d"))


@query("sink_ctas_insert", "SELECT n_regionkey, 2 * count(*) AS n FROM nation GROUP BY 1")
def sink_ctas_insert(spark, sf):
    where = scratch(spark, "nation-twice")
    write(T(spark, sf, "nation"), where)
    insert(T(spark, sf, "nation"), where)
    return scan(spark, where, columns=["n_regionkey"]).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))


@query("source_bucketed", "SELECT o_orderstatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def source_bucketed(spark, sf):
    # both tables are bucketed by the join key: the join itself moves no row
    write_bucketed(T(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "quarry_orders_bucketed", ["o_orderkey"], 11)
    write_bucketed(T(spark, sf, "lineitem").select("l_orderkey", "l_quantity"), "quarry_lineitem_bucketed", ["l_orderkey"], 11)
    o, line = spark.table("quarry_orders_bucketed"), spark.table("quarry_lineitem_bucketed")
    return line.join(o, line.l_orderkey == o.o_orderkey).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("l_quantity"), 2).alias("q"))


_TUMBLE = "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY ALL"


def _aggregates():
    return F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 2).alias("v")


@query("window_tumbling", _TUMBLE)
def window_tumbling(spark, sf):
    return tumbling(T(spark, sf, "events"), "ts", "1 hour", ["event_type"], *_aggregates())


@query("window_sliding", "SELECT s AS window_start, s + INTERVAL '2 hours' AS window_end, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS s FROM events) GROUP BY ALL")
def window_sliding(spark, sf):
    return tumbling(T(spark, sf, "events"), "ts", "2 hours", [], F.count(F.lit(1)).alias("n"), slide="1 hour")


@query(
    "window_session",
    """SELECT min(ts) AS session_start, max(ts) + INTERVAL '3 hours' AS session_end, user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '3 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g""",
)
def window_session(spark, sf):
    return sessions(T(spark, sf, "events"), "ts", "3 hours", ["user_id"], F.count(F.lit(1)).alias("n"))


@query("stream_tumbling", _TUMBLE)
def stream_tumbling(spark, sf):
    """The same windows as a stream that is drained once into a table."""
    schema = T(spark, sf, "events").schema
    landing = scratch(spark, "events-landing")
    # as it is read: dealt out anew, a task would sort its part first; nor are the windows coalesced, as a task would hold
    # the aggregations of all partitions that it takes
    T(spark, sf, "events").write.parquet(landing)
    # a stream's clock needs instants; the session's zone is UTC
    src = events_stream(spark, landing, schema, max_files=1000).withColumn("ts", F.col("ts").cast("timestamp"))
    out, marks = scratch(spark, "events-windows"), scratch(spark, "events-marks")
    agg = tumbling(src, "ts", "1 hour", ["event_type"], F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(out)

    agg.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", marks).foreachBatch(keep).start().awaitTermination()
    r = spark.read.parquet(out)
    return r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "n", rounded("v", 2).alias("v"))
