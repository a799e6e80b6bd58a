"""Plans are the ones wanted: pruned scans, group limits before shuffles, no nested loops where there is a key."""

import pytest

from quarry import registry

registry.load()


def plan(spark, sf, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned_and_filtered(spark, sf):
    p = plan(spark, sf, "tpch_q06")
    assert "PushedFilters: [" in p and "LessThan(l_quantity,24.0)" in p.split("PushedFilters")[1]
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in p


@pytest.mark.parametrize("name", ["topn_row_number", "topn_rank", "topn_dense_rank"])
def test_ranks_are_limited_before_the_shuffle(spark, sf, name):
    assert plan(spark, sf, name).count("WindowGroupLimit") == 2


def test_top_n_is_no_sort(spark, sf):
    p = plan(spark, sf, "topn")
    assert "TakeOrderedAndProject" in p and "Exchange range" not in p


@pytest.mark.parametrize("name", ["join_range", "join_spatial", "join_asof", "join_semi", "tpch_q21", "tpch_q17"])
def test_no_nested_loops(spark, sf, name):
    p = plan(spark, sf, name)
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_one_shuffle_for_a_hash_exchange_and_its_aggregation(spark, sf):
    assert plan(spark, sf, "exchange_hash").count("Exchange hashpartitioning") == 1


def test_bucketed_join_moves_nothing_before_the_aggregation(spark, sf):
    p = plan(spark, sf, "source_bucketed")
    assert "hashpartitioning(o_orderkey" not in p and "hashpartitioning(l_orderkey" not in p


def test_python_only_where_there_is_no_expression(spark, sf):
    slow = [n for n in registry.QUERIES if n.startswith(("fn_", "agg_", "win_", "pred_", "expr_", "join_", "tpch_")) and any(w in plan(spark, sf, n) for w in ("Python", "Pandas", "ArrowEval"))]
    assert sorted(slow) == ["fn_hash_exact", "fn_string_unicode", "fn_word_stem"]


def test_a_filter_reaches_the_facts_below_an_aggregate(spark, sf):
    """The parts that a query asks for thin out the deliveries before these are grouped."""
    p = plan(spark, sf, "tpch_q02")
    assert p.index("LeftSemi") > p.index("partial_min")  # further down in the tree


def test_dynamic_filters(spark, sf, tmp_path):
    """The keys that a filtered side is left with prune the partitions of the other side while it runs."""
    from pyspark.sql import functions as F

    from quarry.tables import table

    path = f"file://{tmp_path}/orders"
    table(spark, sf, "orders").withColumn("k", (F.col("o_custkey") % 10).cast("int")).write.partitionBy("k").parquet(path)
    few = table(spark, sf, "nation").where("n_name = 'NATION_3'").select(F.col("n_nationkey").alias("k"))
    joined = spark.read.parquet(path).join(few, "k")
    assert "dynamicpruningexpression" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.select("k").distinct().collect()[0].k == 3
