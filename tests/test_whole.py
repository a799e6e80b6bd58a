"""Queries over whole tables and values: nothing of the input is left out. Their rows have oracles in test_queries."""

from quarry import registry
from quarry.tables import table

registry.load()


def test_datetime_queries_take_all_orders(spark, sf):
    n = table(spark, sf, "orders").count()
    for name in ("fn_datetime_text", "fn_datetime_iso"):
        assert "WHERE" not in registry.ORACLES[name]
        assert registry.QUERIES[name](spark, sf).count() == n


def test_the_full_join_takes_both_tables(spark, sf):
    got = registry.QUERIES["join_full"](spark, sf).collect()
    for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        assert {r[key] for r in got} - {None} == {r[key] for r in table(spark, sf, name).select(key).collect()}
    assert {(r.c_custkey is None, r.s_suppkey is None) for r in got} == {(False, False), (False, True), (True, False)}


def test_texts_and_embeddings_are_taken_whole(spark, sf):
    size = {r.vec_id: r.n for r in table(spark, sf, "embeddings").selectExpr("vec_id", "size(embedding) AS n").collect()}
    run = lambda name: registry.QUERIES[name](spark, sf).collect()
    for name, column, less in (("basic", "s", 0), ("shims", "t", 2), ("shims", "g", 1), ("lambda", "t", 0), ("normalize", "n", 0)):
        assert {r.vec_id: len(r[column]) + less for r in run(f"fn_array_{name}")} == size
    assert len(run("unnest")) == sum(size.values())
    for name in ("fn_array_basic", "fn_array_shims", "fn_array_lambda", "fn_array_normalize", "unnest"):
        assert "embedding[" not in registry.ORACLES[name]
    assert "substr(text, 1" not in registry.ORACLES["fn_string_unicode"]
