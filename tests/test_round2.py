"""Findings of round 2: each test fails on the code before it."""

import datetime
import inspect
import math

import duckdb
from pyspark.sql import functions as F

from quarry import registry
from quarry.operators import aggregates, joins

from .test_plans import plan

registry.load()


def test_no_sketch_is_kept_for_each_distinct_value(spark, sf):
    by_part = [line for line in plan(spark, sf, "agg_approx").splitlines() if "Aggregate(" in line and "l_partkey" in line.split("functions=")[0]]
    assert by_part and not any(w in line for line in by_part for w in ("approx", "hll", "percentile"))


def test_percentiles_are_exact(spark):
    rows = [("a", float(i * 7 % 50)) for i in range(1000)] + [("b", 1.0), ("b", None), (None, 2.0), (None, 3.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    fractions = [0.0, 0.25, 0.333, 0.5, 1.0]
    out = aggregates.beside(df.select("g").distinct(), aggregates.percentiles(df, ["g"], "x", fractions, "q"), ["g"])
    got = {r.g: r.q for r in out.collect()}
    for g in ("a", "b", "c", None):
        xs = sorted(x for h, x in rows if h == g and x is not None)
        assert got[g] == [xs[max(math.ceil(len(xs) * f), 1) - 1] if xs else None for f in fractions]


def test_equal_keys_take_the_first_rows(spark, tmp_path):
    """All balances stand twice or more: what one task reads first does not matter."""
    rows = [(k, f"c{k}", k % 2 if k < 40 else None, float(k % 40 // 10), "x") for k in range(80)]
    df = spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    df.orderBy(F.desc("c_custkey")).repartition(5).write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.c_nationkey: r for r in registry.QUERIES["agg_min_max_by"](spark, str(tmp_path)).collect()}
    assert (got[0].a, got[0].b, got[0].m, got[0].k, got[0].l) == (0, 30, [32, 30], [2, 0], [0, 2, 4])
    # customers without a nation are a group; 40 to 79 have each balance in ten rows
    assert (got[None].a, got[None].b, got[None].m, got[None].k, got[None].g) == (40, 70, [71, 70], [41, 40], [79, 78, 77])


def test_halves_are_cast_to_even(spark, tmp_path):
    rows = [(i, 1, p) for i, p in enumerate([0.5, 1001.0, 2.5, 1002.0, 1503.0, 3000.0])]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.n for r in registry.QUERIES["win_range"](spark, str(tmp_path)).collect()}
    keys = [round(p) for _, _, p in rows]  # Python rounds halves to even
    assert got == {i: sum(a - 1000 <= b <= a + 500 for b in keys) for i, a in enumerate(keys)}


def test_normalized_values_keep_the_sign_of_zero(spark, tmp_path):
    rows = [(0, [1e6, -1.0, 1.0, -0.0]), (1, [3.0, -4.0]), (2, [0.0, 0.0]), (3, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.n for r in registry.QUERIES["fn_array_normalize"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = dict(con.execute(registry.ORACLES["fn_array_normalize"]).fetchall())
    assert repr(sorted(got.items())) == repr(sorted(want.items())) and repr(got[0]) == "[1.0, -0.0, 0.0, -0.0]"


def test_a_hot_cell_is_cut_into_blocks(spark):
    """One crowded cell, one far away, points just at the radius: all pairs once, and more blocks than one."""
    points = [(i, (i * 37 % 101) / 100, (i * 53 % 97) / 100) for i in range(300)] + [(300, 1.9999999999999998, 50.0), (301, 90.0, -7.0), (302, None, 1.0)]
    others = [(i, (i * 29 % 103) / 100, (i * 41 % 89) / 100) for i in range(200)] + [(200, 4.0, 50.0), (201, 91.0, -7.5)]
    a, b = spark.createDataFrame(points, "k long, x double, y double"), spark.createDataFrame(others, "j long, u double, v double")
    out = joins.distance_join(a, b, ("x", "y"), ("u", "v"), 2.0, pairs=1000)
    got = sorted((r.k, r.j) for r in out.collect())
    assert got == sorted((k, j) for k, x, y in points for j, u, v in others if x is not None and (x - u) ** 2 + (y - v) ** 2 <= 4)
    assert {(300, 200), (301, 201)} <= set(got)
    spread = joins.distance_join(a, b, ("x", "y"), ("u", "v"), 2.0, pairs=1000).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert max(r["count"] for r in spread) < 10_000 and joins.distance_join(a.limit(0), b, ("x", "y"), ("u", "v"), 2.0).count() == 0


def test_a_stream_is_not_dealt_out_or_coalesced():
    source = inspect.getsource(registry.QUERIES["stream_tumbling"])
    assert "repartition(" not in source and "coalesce(" not in source


_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _both(spark, where, rows, *names):
    """What a query and its SQL give over these events, written out so that the sign of a zero shows."""
    spark.createDataFrame(rows, _EVENTS).write.parquet(f"{where}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{where}/events.parquet/*.parquet')")
    for name in names:
        got = registry.QUERIES[name](spark, str(where))
        rel = con.execute(registry.ORACLES[name])
        assert got.columns == [d[0] for d in rel.description]
        yield name, sorted(map(tuple, got.collect())), sorted(rel.fetchall())


def test_frames_round_as_their_sql(spark, tmp_path):
    """Halves that only the shortest digits show, sums that round to minus zero, minus zero alone and beside zero, infinities."""
    day, values = datetime.datetime(2024, 1, 1), [4.0001465, -1e-7, 1.0000295, 1e-7, -0.0, None, -0.5, 2.0000335, 0.0, 1e300]
    rows = [(i, day + datetime.timedelta(minutes=i), i % 2 + i // 40, "view", values[i * 3 % 10], "{}") for i in range(400)]
    for name, got, want in _both(spark, tmp_path, rows, "win_varying_frame", "win_rows"):
        assert repr(got) == repr(want), name


def test_null_times_come_last_in_frames(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, None if i % 5 == 2 else day + datetime.timedelta(minutes=i * 7 % 60), i % 3, "view" if i % 4 else "click", float(i), "{}") for i in range(60)]
    for name, got, want in _both(spark, tmp_path, rows, "win_varying_frame", "win_rows", "win_navigation", "win_ignore_nulls", "win_navigation_nulls"):
        assert repr(got) == repr(want), name


def test_rounding_is_that_of_the_product(spark):
    from quarry.functions.mathematics import rounded

    xs = [4.0001465, 1.005, -1.005, 0.285, 2.5, -2.5, 0.5, -0.5, 0.49999999999999994, 1e300, 1.5e308, 5e9 + 0.015, -0.0, 0.0, -1e-9, float("inf"), float("-inf"), float("nan"), None, 1250.0, -1250.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [r[1:] for r in df.select("i", *[rounded("x", d).alias(f"d{d}") for d in (0, 2, 6)], rounded("x", -2).alias("h")).orderBy("i").collect()]
    con = duckdb.connect()
    want = [con.execute("SELECT round(x), round(x, 2), round(x, 6), round(x, -2) FROM (SELECT ?::DOUBLE AS x)", [x]).fetchone() for x in xs]
    assert repr([tuple(map(str, r)) for r in got]) == repr([tuple(map(str, r)) for r in want])
