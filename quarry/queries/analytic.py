"""Queries of aggregation, grouping sets, windows, sorting, limits and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.mathematics import rounded
from ..operators import aggregates as A
from ..operators import grouping, windows
from ..operators.ordering import distinct_limit, key, limit_with_ties, order, page, top_n
from ..operators.rows import mark_distinct as mark
from ..registry import query
from ..tables import table

T = table


def _q(x, n=4):
    return rounded(x, n)


@query("agg_group", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS s, round(avg(c_acctbal), 4) AS a, min(c_custkey) AS lo, max(c_custkey) AS hi FROM customer GROUP BY 1")
def agg_group(spark, sf):
    return T(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), _q(F.sum("c_acctbal"), 2).alias("s"), _q(F.avg("c_acctbal")).alias("a"), F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi"))


@query("agg_global", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders")
def agg_global(spark, sf):
    return T(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"), _q(F.sum("o_totalprice"), 2).alias("s"), F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))


@query("agg_null_keys", "SELECT nullif(n_regionkey, 1) AS k, count(*) AS n FROM nation GROUP BY 1")
def agg_null_keys(spark, sf):
    return T(spark, sf, "nation").groupBy(F.nullif("n_regionkey", F.lit(1)).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_partial_final", "SELECT l_returnflag, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 6) AS a, round(stddev_samp(l_quantity), 6) AS d, round(var_pop(l_quantity), 4) AS v FROM lineitem GROUP BY 1")
def agg_partial_final(spark, sf):
    part = T(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(A.partial_sum("l_quantity").alias("state"), A.partial_variance("l_quantity").alias("square"))
    out = part.groupBy("l_returnflag").agg(A.merge_sum("state").alias("s"), A.merge_avg("state").alias("a"), A.merge_variance("square").alias("d"), A.merge_variance("square", sample=False).alias("v"))
    return out.select("l_returnflag", _q("s", 2).alias("s"), _q("a", 6).alias("a"), _q(F.sqrt("d"), 6).alias("d"), _q("v").alias("v"))


@query("agg_pregrouped", "SELECT o_custkey, count(*) AS n, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS p FROM orders GROUP BY 1")
def agg_pregrouped(spark, sf):
    return T(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.array_join(A.array_agg("o_orderpriority", F.col("o_orderkey")), ",").alias("p"))


@query("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 200000), 2) AS s FROM orders GROUP BY 1")
def agg_filter(spark, sf):
    return T(spark, sf, "orders").groupBy("o_orderpriority").agg(A.masked(F.count, F.lit(1), F.col("o_orderstatus") == "F").alias("f"), _q(A.masked(F.sum, "o_totalprice", F.col("o_totalprice") > 200000), 2).alias("s"))


@query("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS d, count(DISTINCT l_partkey) AS p, sum(DISTINCT l_linenumber)::BIGINT AS s FROM lineitem GROUP BY 1")
def agg_distinct(spark, sf):
    return T(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("d"), F.countDistinct("l_partkey").alias("p"), F.sum_distinct("l_linenumber").alias("s"))


@query("mark_distinct", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS d FROM lineitem GROUP BY 1")
def mark_distinct(spark, sf):
    m = mark(T(spark, sf, "lineitem").select("l_returnflag", "l_suppkey"), ["l_returnflag", "l_suppkey"], "first")
    return m.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if("first").alias("d"))


@query("agg_ordered", "SELECT c_nationkey, list(c_custkey ORDER BY c_acctbal, c_custkey) AS a, string_agg(c_mktsegment, '|' ORDER BY c_custkey) AS s FROM customer GROUP BY 1")
def agg_ordered(spark, sf):
    return T(spark, sf, "customer").groupBy("c_nationkey").agg(A.array_agg("c_custkey", F.col("c_acctbal"), F.col("c_custkey")).alias("a"), F.array_join(A.array_agg("c_mktsegment", F.col("c_custkey")), "|").alias("s"))


@query("agg_array_nulls", "SELECT n_regionkey, list(nullif(n_nationkey, 7) ORDER BY n_nationkey) AS a FROM nation GROUP BY 1")
def agg_array_nulls(spark, sf):
    return T(spark, sf, "nation").groupBy("n_regionkey").agg(A.array_agg(F.nullif("n_nationkey", F.lit(7)), F.col("n_nationkey")).alias("a"))


_L = "l_returnflag, l_linestatus"


@query("agg_grouping_sets", f"SELECT {_L}, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY GROUPING SETS (({_L}), (l_returnflag), ())")
def agg_grouping_sets(spark, sf):
    return grouping.grouping_sets(T(spark, sf, "lineitem"), [["l_returnflag", "l_linestatus"], ["l_returnflag"], []], F.count(F.lit(1)).alias("n"), _q(F.sum("l_quantity"), 2).alias("q"))


@query("agg_rollup", f"SELECT {_L}, count(*) AS n FROM lineitem GROUP BY ROLLUP ({_L})")
def agg_rollup(spark, sf):
    return grouping.rollup(T(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], F.count(F.lit(1)).alias("n"))


@query("agg_cube", f"SELECT {_L}, count(*) AS n FROM lineitem GROUP BY CUBE ({_L})")
def agg_cube(spark, sf):
    return grouping.cube(T(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], F.count(F.lit(1)).alias("n"))


@query("agg_grouping_fn", f"SELECT {_L}, grouping({_L})::BIGINT AS g, count(*) AS n FROM lineitem GROUP BY CUBE ({_L})")
def agg_grouping_fn(spark, sf):
    return grouping.cube(T(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], F.count(F.lit(1)).alias("n"), group_id="g")


@query("agg_grouping_empty", "SELECT l_returnflag, count(*) AS n FROM (SELECT * FROM lineitem WHERE l_quantity < 0) GROUP BY GROUPING SETS ((l_returnflag), ())")
def agg_grouping_empty(spark, sf):
    return grouping.grouping_sets(T(spark, sf, "lineitem").where("l_quantity < 0"), [["l_returnflag"], []], F.count(F.lit(1)).alias("n"))


@query("group_id", "SELECT l_returnflag, NULL::VARCHAR AS l_linestatus, 0::BIGINT AS g, l_quantity FROM lineitem UNION ALL SELECT NULL, l_linestatus, 1, l_quantity FROM lineitem")
def group_id(spark, sf):
    return grouping.group_id_rows(T(spark, sf, "lineitem"), [["l_returnflag"], ["l_linestatus"]], ["l_quantity"], "g")


@query("select_distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def select_distinct(spark, sf):
    return T(spark, sf, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query("agg_sum_types", "SELECT n_regionkey, sum(n_nationkey::TINYINT)::BIGINT AS t, sum(n_nationkey::SMALLINT)::BIGINT AS s, sum(n_nationkey)::BIGINT AS i, sum(n_nationkey::BIGINT)::BIGINT AS b, sum(n_nationkey::DOUBLE / 2)::FLOAT AS r, sum(n_nationkey::DOUBLE / 2) AS d, sum(CAST(NULL AS INTEGER))::BIGINT AS z FROM nation GROUP BY 1")
def agg_sum_types(spark, sf):
    k = F.col("n_nationkey")
    return T(spark, sf, "nation").groupBy("n_regionkey").agg(
        A.typed_sum(k.cast("tinyint"), "tinyint").alias("t"),
        A.typed_sum(k.cast("smallint"), "smallint").alias("s"),
        A.typed_sum(k, "int").alias("i"),
        A.typed_sum(k.cast("bigint"), "bigint").alias("b"),
        A.typed_sum((k / 2).cast("float"), "real").alias("r"),
        A.typed_sum(k / 2, "double").alias("d"),
        A.typed_sum(F.lit(None).cast("int"), "int").alias("z"),
    )


@query("agg_decimal", "SELECT c_mktsegment, sum(c_acctbal::DECIMAL(12,2)) AS s, round(sum(c_acctbal::DECIMAL(12,2)) / count(*), 2)::DECIMAL(12,2) AS a FROM customer GROUP BY 1")
def agg_decimal(spark, sf):
    d = F.col("c_acctbal").cast("decimal(12,2)")
    return T(spark, sf, "customer").groupBy("c_mktsegment").agg(F.sum(d).cast("decimal(38,2)").alias("s"), A.decimal_avg(d, 12, 2).alias("a"))


@query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15 AND max(o_totalprice) > 400000")
def agg_having(spark, sf):
    g = T(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("m"))
    return g.where("n > 15 AND m > 400000").drop("m")


@query("agg_bool_bits", "SELECT p_brand, bool_and(p_size > 1) AS a, bool_or(p_size > 49) AS o, bit_and(p_size) AS ba, bit_or(p_size) AS bo, bit_xor(p_size) AS bx, count_if(p_size > 25)::BIGINT AS c FROM part GROUP BY 1")
def agg_bool_bits(spark, sf):
    s = F.col("p_size")
    return T(spark, sf, "part").groupBy("p_brand").agg(F.bool_and(s > 1).alias("a"), F.bool_or(s > 49).alias("o"), F.bit_and(s).alias("ba"), F.bit_or(s).alias("bo"), F.bit_xor(s).alias("bx"), F.count_if(s > 25).alias("c"))


@query("agg_min_max_by", "SELECT c_nationkey, min_by(c_custkey, c_acctbal) AS a, max_by(c_custkey, c_acctbal) AS b, min(c_custkey, 3) AS l, max(c_custkey, 3) AS g, max_by(c_custkey, c_acctbal, 2) AS m, min_by(c_custkey, c_acctbal, 2) AS k FROM customer GROUP BY 1")
def agg_min_max_by(spark, sf):
    c, by, k = T(spark, sf, "customer"), ["c_nationkey"], F.col("c_custkey")
    # of equal balances the first customers, as the SQL has it in one thread; of those its short lists name the later first
    out = c.groupBy(*by).agg(A.min_by("c_custkey", "c_acctbal", k).alias("a"), A.max_by("c_custkey", "c_acctbal", k).alias("b"))
    for part in (A.least_n(c, by, "c_custkey", 3, "l"), A.greatest_n(c, by, "c_custkey", 3, "g"), A.max_by_n(c, by, "c_custkey", "c_acctbal", 2, "m", [k], [-k]), A.min_by_n(c, by, "c_custkey", "c_acctbal", 2, "k", [k], [-k])):
        out = A.beside(out, part, by)
    return out


@query("agg_statistics", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS ss, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 4) AS vs, round(var_pop(l_quantity), 4) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS p, round(covar_samp(l_quantity, l_discount), 6) AS q FROM lineitem GROUP BY 1")
def agg_statistics(spark, sf):
    x = "l_quantity"
    return T(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        _q(F.stddev_samp(x), 6).alias("ss"), _q(F.stddev_pop(x), 6).alias("sp"), _q(F.var_samp(x)).alias("vs"), _q(F.var_pop(x)).alias("vp"), _q(F.corr(x, "l_extendedprice"), 6).alias("c"), _q(F.covar_pop(x, "l_discount"), 6).alias("p"), _q(F.covar_samp(x, "l_discount"), 6).alias("q")
    )


@query("agg_moments", "SELECT p_brand, round(kurtosis(p_retailprice), 5) AS k, round(geomean(p_retailprice), 4) AS g, round(skewness(p_retailprice) * (count(*) - 2) / sqrt(count(*)::DOUBLE * (count(*) - 1)), 5) AS s FROM part GROUP BY 1")
def agg_moments(spark, sf):
    return T(spark, sf, "part").groupBy("p_brand").agg(_q(A.sample_kurtosis("p_retailprice"), 5).alias("k"), _q(A.geometric_mean("p_retailprice")).alias("g"), _q(F.skewness("p_retailprice"), 5).alias("s"))


@query("agg_regression_sums", "SELECT l_returnflag, round(regr_sxx(l_discount, l_quantity), 3) AS xx, round(regr_syy(l_discount, l_quantity), 5) AS yy, round(regr_sxy(l_discount, l_quantity), 4) AS xy FROM lineitem GROUP BY 1")
def agg_regression_sums(spark, sf):
    y, x = "l_discount", "l_quantity"
    return T(spark, sf, "lineitem").groupBy("l_returnflag").agg(_q(F.regr_sxx(y, x), 3).alias("xx"), _q(F.regr_syy(y, x), 5).alias("yy"), _q(F.regr_sxy(y, x)).alias("xy"))


@query("agg_listagg", "SELECT c_nationkey, string_agg(nullif(c_mktsegment, 'BUILDING'), ';' ORDER BY c_acctbal DESC, c_custkey) AS s, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS d FROM customer GROUP BY 1")
def agg_listagg(spark, sf):
    return T(spark, sf, "customer").groupBy("c_nationkey").agg(A.listagg(F.nullif("c_mktsegment", F.lit("BUILDING")), ";", -F.col("c_acctbal"), F.col("c_custkey")).alias("s"), F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ",").alias("d"))


@query("agg_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 5) AS s, round(regr_intercept(l_extendedprice, l_quantity), 3) AS i, regr_count(l_extendedprice, l_quantity)::BIGINT AS n, round(regr_r2(l_extendedprice, l_quantity), 6) AS r, round(regr_avgx(l_extendedprice, l_quantity), 5) AS x, round(regr_avgy(l_extendedprice, l_quantity), 3) AS y FROM lineitem GROUP BY 1")
def agg_regression(spark, sf):
    y, x = "l_extendedprice", "l_quantity"
    return T(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        _q(F.regr_slope(y, x), 5).alias("s"), _q(F.regr_intercept(y, x), 3).alias("i"), F.regr_count(y, x).alias("n"), _q(F.regr_r2(y, x), 6).alias("r"), _q(F.regr_avgx(y, x), 5).alias("x"), _q(F.regr_avgy(y, x), 3).alias("y")
    )


@query("agg_entropy", "SELECT p_brand, round(log2(sum(p_size)) - sum(p_size * log2(p_size)) / sum(p_size), 6) AS e FROM part WHERE p_size > 0 GROUP BY 1")
def agg_entropy(spark, sf):
    return A.entropy(T(spark, sf, "part"), ["p_brand"], "p_size", "e").select("p_brand", _q("e", 6).alias("e"))


@query("agg_histogram", "SELECT c_mktsegment, map_from_entries(list((k, n) ORDER BY k)) AS h FROM (SELECT c_mktsegment, c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1")
def agg_histogram(spark, sf):
    return A.histogram(T(spark, sf, "customer"), ["c_mktsegment"], "c_nationkey", "h")


@query("agg_multimap", "SELECT n_regionkey, map_from_entries(list((k, v) ORDER BY k)) AS m FROM (SELECT n_regionkey, n_nationkey % 2 AS k, list(n_nationkey ORDER BY n_nationkey) AS v FROM nation GROUP BY 1, 2) GROUP BY 1")
def agg_multimap(spark, sf):
    return A.multimap_agg(T(spark, sf, "nation").withColumn("k", F.col("n_nationkey") % 2), ["n_regionkey"], "k", "n_nationkey", "m")


@query("agg_map_agg", "SELECT n_regionkey, list_sort(map_keys(m)) AS k, list_aggregate(map_values(m), 'max') AS v FROM (SELECT n_regionkey, map_from_entries(list((n_name, n_nationkey))) AS m FROM nation GROUP BY 1)")
def agg_map_agg(spark, sf):
    g = T(spark, sf, "nation").groupBy("n_regionkey").agg(A.map_agg("n_name", "n_nationkey").alias("m"))
    return g.select("n_regionkey", F.array_sort(F.map_keys("m")).alias("k"), F.array_max(F.map_values("m")).alias("v"))


@query("agg_map_union", "SELECT n_regionkey, list(DISTINCT n_nationkey % 3 ORDER BY n_nationkey % 3) AS k, list(DISTINCT 'v' || n_nationkey % 3 ORDER BY 'v' || n_nationkey % 3) AS v FROM nation GROUP BY 1")
def agg_map_union(spark, sf):
    k = F.col("n_nationkey") % 3
    m = T(spark, sf, "nation").withColumn("m", F.create_map(k, F.concat(F.lit("v"), k.cast("string"))))
    return m.groupBy("n_regionkey").agg(A.map_union("m").alias("u")).select("n_regionkey", F.array_sort(F.map_keys("u")).alias("k"), F.array_sort(F.map_values("u")).alias("v"))


@query("agg_map_union_sum", "SELECT n_regionkey, map_from_entries(list((k, s) ORDER BY k)) AS m FROM (SELECT n_regionkey, n_nationkey % 3 AS k, sum(n_nationkey)::BIGINT AS s FROM nation GROUP BY 1, 2) GROUP BY 1")
def agg_map_union_sum(spark, sf):
    m = T(spark, sf, "nation").withColumn("x", F.create_map(F.col("n_nationkey") % 3, F.col("n_nationkey")))
    return A.map_union_sum(m, ["n_regionkey"], "x", "m")


@query("agg_sets", "SELECT n_regionkey, list_sort(list(DISTINCT n_nationkey % 4)) AS s, list_sort(list_distinct(flatten(list([n_nationkey, n_nationkey % 4])))) AS u FROM nation GROUP BY 1")
def agg_sets(spark, sf):
    k = F.col("n_nationkey")
    return T(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(A.set_agg(k % 4)).alias("s"), F.array_sort(A.set_union(F.array(k, k % 4))).alias("u"))


@query("agg_reduce", "SELECT n_regionkey, sum(n_nationkey * n_nationkey)::BIGINT AS r FROM nation GROUP BY 1")
def agg_reduce(spark, sf):
    return T(spark, sf, "nation").groupBy("n_regionkey").agg(A.reduce_agg("n_nationkey", F.lit(0).cast("bigint"), lambda s, x: s + x * x).alias("r"))


@query("agg_approx", "SELECT l_returnflag, count(DISTINCT l_partkey) AS d, count(DISTINCT l_linenumber) AS few, [quantile_disc(l_quantity, 0.25), quantile_disc(l_quantity, 0.75)] AS q, true AS distinct_near, true AS sketch_near FROM lineitem GROUP BY 1")
def agg_approx(spark, sf):
    # few distinct values are counted exactly by either sketch; beside a distinct count in one aggregation there would be
    # sketches for each part, so the exact columns are aggregated apart
    line, by = T(spark, sf, "lineitem"), ["l_returnflag"]
    g = line.groupBy(*by).agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), A.cardinality(A.approx_set("l_partkey")).alias("h"), F.approx_count_distinct("l_linenumber", 0.02).alias("few"))
    exact = line.select(*by, "l_partkey").distinct().groupBy(*by).agg(F.count("l_partkey").alias("d"))
    g = A.beside(A.beside(g, exact, by), A.percentiles(line, by, "l_quantity", [0.25, 0.75], "q"), by)
    near = lambda x, y: F.abs(F.col(x) / F.col(y) - 1) < 0.1
    return g.select("l_returnflag", "d", "few", "q", near("a", "d").alias("distinct_near"), near("h", "d").alias("sketch_near"))


@query("agg_sketch_merge", "SELECT count(DISTINCT p_brand)::BIGINT AS n, count(DISTINCT p_type)::BIGINT AS t, 0::BIGINT AS none FROM part")
def agg_sketch_merge(spark, sf):
    parts = T(spark, sf, "part").groupBy("p_size").agg(A.approx_set("p_brand").alias("b"), A.approx_set("p_type").alias("t"))
    empty = T(spark, sf, "part").where("p_size < 0").agg(A.cardinality(A.approx_set("p_brand")).alias("none"))
    return parts.agg(A.cardinality(A.merge("b")).alias("n"), A.cardinality(A.merge("t")).alias("t")).crossJoin(empty)


@query("agg_most_frequent", "SELECT p_brand, map_from_entries(list((k, n) ORDER BY n DESC, k)) AS m FROM (SELECT p_brand, p_type AS k, count(*) AS n FROM part GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, k) <= 3) GROUP BY 1")
def agg_most_frequent(spark, sf):
    return A.approx_most_frequent(T(spark, sf, "part"), ["p_brand"], "p_type", 3, "m")


@query("agg_checksum", "SELECT n_regionkey, count(*) AS n, true AS same, count(*) = 0 AS doubled, n_regionkey = 0 AS changed FROM nation GROUP BY 1")
def agg_checksum(spark, sf):
    n = T(spark, sf, "nation")
    by = lambda df, name: df.groupBy("n_regionkey").agg(A.checksum("n_nationkey", "n_name").alias(name))
    out = n.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), A.checksum("n_nationkey", "n_name").alias("a"))
    # in another order, with every row twice, and with one row changed
    out = out.join(by(n.orderBy(F.desc("n_name")), "b"), "n_regionkey").join(by(n.unionAll(n), "c"), "n_regionkey")
    out = out.join(by(n.withColumn("n_name", F.when(F.col("n_nationkey") == n.where("n_regionkey = 0").agg(F.min("n_nationkey")).first()[0], "x").otherwise(F.col("n_name"))), "e"), "n_regionkey")
    return out.select("n_regionkey", "n", (F.col("a") == F.col("b")).alias("same"), (F.col("a") == F.col("c")).alias("doubled"), (F.col("a") != F.col("e")).alias("changed"))


@query("agg_data_size", "SELECT max(strlen(text))::BIGINT AS m, sum(strlen(text))::BIGINT AS s FROM documents")
def agg_data_size(spark, sf):
    n = F.octet_length("text").cast("bigint")
    return T(spark, sf, "documents").agg(F.max(n).alias("m"), F.sum(n).alias("s"))


@query("agg_any_value", "SELECT n_regionkey, count(*) AS n, true AS found FROM nation GROUP BY 1")
def agg_any_value(spark, sf):
    return T(spark, sf, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.any_value("n_name", ignoreNulls=True).isNotNull().alias("found"))


# Windows.

_E = "PARTITION BY user_id ORDER BY ts, event_id"


def _by_user():
    return W.partitionBy("user_id").orderBy(order("ts"), order("event_id"))


@query("win_ranking", "SELECT c_custkey, row_number() OVER w AS rn, rank() OVER w AS r, dense_rank() OVER w AS d, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_custkey) AS t FROM (SELECT c_custkey, c_mktsegment, c_nationkey, c_custkey // 10 AS k FROM customer) WINDOW w AS (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey)")
def win_ranking(spark, sf):
    w = W.partitionBy("c_mktsegment", "c_nationkey").orderBy(order("c_custkey"))
    t = W.partitionBy("c_mktsegment").orderBy(order("c_nationkey"), order("c_custkey"))
    one = lambda f: f.over(w).cast("bigint")
    out = T(spark, sf, "customer").select("c_custkey", one(F.row_number()).alias("rn"), one(F.rank()).alias("r"), one(F.dense_rank()).alias("d"), F.percent_rank().over(w).alias("p"), F.cume_dist().over(w).alias("c"), F.ntile(4).over(t).cast("bigint").alias("t"))
    return out.withColumns({"p": _q("p", 6), "c": _q("c", 6)})


@query("win_rows", f"SELECT event_id, round(sum(value) OVER ({_E} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS s, round(avg(value) OVER ({_E} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS a FROM events")
def win_rows(spark, sf):
    w = _by_user()
    out = T(spark, sf, "events").select("event_id", F.sum("value").over(w.rowsBetween(-2, 1)).alias("s"), F.avg("value").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("a"))
    return out.select("event_id", _q("s").alias("s"), _q("a", 9).alias("a"))


@query("win_range", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY k RANGE BETWEEN 1000 PRECEDING AND 500 FOLLOWING) AS n FROM (SELECT *, CAST(o_totalprice AS BIGINT) AS k FROM orders)")
def win_range(spark, sf):
    o = T(spark, sf, "orders").withColumn("k", F.rint("o_totalprice").cast("bigint"))  # the SQL's cast takes halves to even
    return o.select("o_orderkey", F.count(F.lit(1)).over(W.partitionBy("o_custkey").orderBy("k").rangeBetween(-1000, 500)).alias("n"))


@query("win_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events")
def win_range_interval(spark, sf):
    T(spark, sf, "events").createOrReplaceTempView("events")
    return spark.sql("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM events")


@query("win_groups", "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, round(sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS s FROM lineitem")
def win_groups(spark, sf):
    line = T(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return windows.groups_frame(line, F.sum("l_quantity"), ["l_suppkey"], [order("l_linenumber")], -1, 1, "s").withColumn("s", _q("s", 2)).drop("l_linenumber")


_V = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 97 = 0 THEN 'Infinity'::DOUBLE ELSE value END"


@query(
    "win_varying_frame",
    f"""SELECT event_id, round(sum(v) OVER ({_E} ROWS BETWEEN CAST(event_id % 3 AS INTEGER) PRECEDING AND CURRENT ROW), 6) AS s, count(v) OVER ({_E} ROWS BETWEEN CAST(event_id % 4 AS INTEGER) PRECEDING AND CAST(event_id % 5 AS INTEGER) FOLLOWING) AS n,
    max(v) OVER ({_E} ROWS BETWEEN CURRENT ROW AND CAST(event_id % 3 AS INTEGER) FOLLOWING) AS m FROM (SELECT *, {_V} AS v FROM events)""",
)
def win_varying_frame(spark, sf):
    k = F.col("event_id")
    v = F.when(k % 7 == 0, F.lit(None)).when(k % 97 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    e = T(spark, sf, "events").select("event_id", "user_id", "ts", v.alias("v"))
    by, order_ = ["user_id"], [order("ts"), order("event_id")]  # null times come last, as in the SQL
    for fold, before, after, name in ((windows.fold_sum, k % 3, F.lit(0), "s"), (windows.fold_count, k % 4, k % 5, "n"), (windows.fold_max, F.lit(0), k % 3, "m")):
        e = windows.varying_rows(e, "v", fold, by, order_, before, after, name)
    return e.select("event_id", _q("s", 6).alias("s"), "n", "m")


@query("win_navigation", f"SELECT event_id, lag(event_id) OVER ({_E}) AS a, lead(event_id, 2, -1) OVER ({_E}) AS b, first_value(event_id) OVER ({_E}) AS f, last_value(event_id) OVER ({_E} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(event_id, 3) OVER ({_E} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM events")
def win_navigation(spark, sf):
    w = _by_user()
    full = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return T(spark, sf, "events").select("event_id", F.lag("event_id").over(w).alias("a"), F.lead("event_id", 2, -1).over(w).alias("b"), F.first("event_id").over(w).alias("f"), F.last("event_id").over(full).alias("l"), F.nth_value("event_id", 3).over(full).alias("n"))


@query("win_ignore_nulls", f"SELECT event_id, last_value(nullif(event_type, 'view') IGNORE NULLS) OVER ({_E} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l, first_value(nullif(event_type, 'view') IGNORE NULLS) OVER ({_E} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM events")
def win_ignore_nulls(spark, sf):
    w, x = _by_user(), F.nullif("event_type", F.lit("view"))
    return T(spark, sf, "events").select("event_id", F.last(x, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("l"), F.first(x, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)).alias("f"))


_X = "nullif(event_type, 'view')"


@query("win_navigation_nulls", f"SELECT event_id, lag({_X}, 1 IGNORE NULLS) OVER ({_E}) AS a, lead({_X}, 2 IGNORE NULLS) OVER ({_E}) AS b, nth_value({_X}, 3 IGNORE NULLS) OVER ({_E} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM events")
def win_navigation_nulls(spark, sf):
    x = "nullif(event_type, 'view')"
    return T(spark, sf, "events").select("event_id", *[windows.ignore_nulls(f, x, n, ["user_id"], ["ts NULLS LAST", "event_id NULLS LAST"]).alias(c) for f, n, c in (("lag", 1, "a"), ("lead", 2, "b"), ("nth_value", 3, "n"))])


@query("win_row_number_unordered", "SELECT o_orderpriority, count(*) AS n, count(*) AS most, (count(*) * (count(*) + 1) // 2)::BIGINT AS total, least(count(*), 5) AS kept FROM orders GROUP BY 1")
def win_row_number_unordered(spark, sf):
    o = T(spark, sf, "orders").select("o_orderpriority")
    n = windows.row_number(o, ["o_orderpriority"], "r").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("most"), F.sum("r").alias("total"))
    return n.join(windows.row_number(o, ["o_orderpriority"], "r", 5).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("kept")), "o_orderpriority")


@query("win_agg", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS s, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey, o_orderstatus) AS m FROM orders")
def win_agg(spark, sf):
    w = W.partitionBy("o_custkey")
    out = T(spark, sf, "orders").select("o_orderkey", F.sum("o_totalprice").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("n"), F.max("o_totalprice").over(W.partitionBy("o_custkey", "o_orderstatus")).alias("m"))
    return out.withColumn("s", _q("s", 2))


def _topn(spark, sf, ranking):
    out = windows.top_n_ranking(T(spark, sf, "part").select("p_brand", "p_partkey", "p_size"), ranking, ["p_brand"], [order("p_size", descending=True), *([order("p_partkey")] if ranking == "row_number" else [])], 3, "r")
    return out.withColumn("r", F.col("r").cast("bigint"))


_TOP = "SELECT p_brand, p_partkey, p_size, {} OVER (PARTITION BY p_brand ORDER BY p_size DESC{}) AS r FROM part QUALIFY r <= 3"


@query("topn_row_number", _TOP.format("row_number()", ", p_partkey"))
def topn_row_number(spark, sf):
    return _topn(spark, sf, "row_number")


@query("topn_rank", _TOP.format("rank()", ""))
def topn_rank(spark, sf):
    return _topn(spark, sf, "rank")


@query("topn_dense_rank", _TOP.format("dense_rank()", ""))
def topn_dense_rank(spark, sf):
    return _topn(spark, sf, "dense_rank")


@query("sessionize", "SELECT user_id, count(*) AS events, CAST(sum(new) AS BIGINT) AS sessions FROM (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events) GROUP BY 1")
def sessionize(spark, sf):
    before = F.lag("ts").over(_by_user())
    new = F.when(F.col("ts") - before <= F.expr("interval '6' hour"), 0).otherwise(1)
    return T(spark, sf, "events").select("user_id", new.alias("new")).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.sum("new").alias("sessions"))


# Sorting and limits.


_SORTED = "SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS a, nullif(n_nationkey % 4, 1) AS b FROM nation"
_SORTS = (("ASC NULLS FIRST", "DESC NULLS LAST"), ("DESC NULLS FIRST", "ASC NULLS LAST"))


@query("sort_nulls", " UNION ALL ".join(f"SELECT {i} AS sort, k, a, b, row_number() OVER (ORDER BY a {x}, b {y}, k) AS place FROM ({_SORTED})" for i, (x, y) in enumerate(_SORTS)))
def sort_nulls(spark, sf):
    n = T(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.nullif("n_regionkey", F.lit(2)).alias("a"), F.nullif(F.col("n_nationkey") % 4, F.lit(1)).alias("b"))
    sorts = ([order("a", nulls_first=True), order("b", descending=True)], [order("a", descending=True, nulls_first=True), order("b")])
    out = None
    for i, keys in enumerate(sorts):
        # the sort itself; where its rows came out is read off the partitions' numbers and the places within them
        ordered = n.orderBy(*keys, order("k")).withColumn("_at", F.monotonically_increasing_id())
        part = F.shiftright("_at", 33)
        size = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
        before = size.withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n"))
        placed = ordered.withColumn("_part", part).join(before, "_part").select(F.lit(i).alias("sort"), "k", "a", "b", (F.col("_before") + F.col("_at") - F.shiftleft("_part", 33) + 1).alias("place"))
        out = placed if out is None else out.unionAll(placed)
    return out


@query("topn", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topn(spark, sf):
    return top_n(T(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 25, order("o_totalprice", descending=True), order("o_orderkey"))


@query("limit", "SELECT count(*) AS n, count(DISTINCT k) AS keys, bool_and(k IN (SELECT l_orderkey FROM lineitem)) AS own FROM (SELECT l_orderkey * 10 + 0 AS k0, l_orderkey AS k FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1 ORDER BY l_orderkey LIMIT 100)")
def limit(spark, sf):
    line = T(spark, sf, "lineitem").select("l_orderkey")
    kept = line.distinct().limit(100)
    return kept.join(line.distinct().withColumn("_in", F.lit(True)), "l_orderkey", "left").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("keys"), F.bool_and(F.coalesce("_in", F.lit(False))).alias("own"))


@query("offset_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 40")
def offset_limit(spark, sf):
    return page(T(spark, sf, "orders").select("o_orderkey"), 40, 10, order("o_orderkey"))


@query("limit_with_ties", "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC, p_type) <= 7")
def limit_ties(spark, sf):
    return limit_with_ties(T(spark, sf, "part").select("p_partkey", "p_size", "p_type"), 7, key("p_size", descending=True), key("p_type")).drop("p_type")


@query("distinct_limit", "SELECT count(*) AS n, count(DISTINCT k) AS keys, min(c) AS least FROM (SELECT c_nationkey AS k, 1 AS c FROM customer GROUP BY 1 LIMIT 10)")
def distinct_lim(spark, sf):
    c = T(spark, sf, "customer").select("c_nationkey")
    kept = distinct_limit(c, 10).join(c.distinct().withColumn("c", F.lit(1)), "c_nationkey", "left")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_nationkey").alias("keys"), F.min("c").alias("least"))


# Set operations.

_S = "SELECT c_nationkey AS k FROM customer {} SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000"


def _sides(spark, sf):
    return T(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), T(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))


@query("set_union_all", _S.format("UNION ALL"))
def set_union_all(spark, sf):
    a, b = _sides(spark, sf)
    return a.unionAll(b)


@query("set_union", _S.format("UNION"))
def set_union(spark, sf):
    a, b = _sides(spark, sf)
    return a.unionAll(b).distinct()


@query("set_intersect", _S.format("INTERSECT"))
def set_intersect(spark, sf):
    a, b = _sides(spark, sf)
    return a.intersect(b)


@query("set_except", _S.format("EXCEPT"))
def set_except(spark, sf):
    a, b = _sides(spark, sf)
    return a.subtract(b)


@query("set_intersect_all", _S.format("INTERSECT ALL"))
def set_intersect_all(spark, sf):
    a, b = _sides(spark, sf)
    return a.intersectAll(b)


@query("set_except_all", _S.format("EXCEPT ALL"))
def set_except_all(spark, sf):
    a, b = _sides(spark, sf)
    return a.exceptAll(b)


@query("pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def pivot(spark, sf):
    p = T(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return p.na.fill(0)
