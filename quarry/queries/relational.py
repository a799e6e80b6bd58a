"""Queries of scans, projections, predicates, rows, exchanges and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exchange, joins, rows
from ..operators.ordering import order
from ..operators.predicates import Domain, tuple_domain
from ..registry import query
from ..tables import register, table

T = table


@query("scan_table", "SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem")
def scan_table(spark, sf):
    return T(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate")


@query(
    "scan_domain_filter",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE (o_orderkey BETWEEN 10 AND 500 OR o_orderkey > 14000 OR o_orderkey = 700) AND o_orderstatus NOT IN ('P', 'X') AND o_totalprice < 300000""",
)
def scan_domain_filter(spark, sf):
    keys = Domain.between(10, 500).union(Domain.between(14000, None, low_open=True)).union(Domain.values(700))
    status = Domain.values("P", "X").complement().intersect(Domain.not_null())
    return T(spark, sf, "orders").where(tuple_domain({"o_orderkey": keys, "o_orderstatus": status, "o_totalprice": Domain.between(None, 300000.0, high_open=True)})).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("scan_domain_nulls", "SELECT o_orderkey, k FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS k FROM orders) WHERE k = 'F' OR k IS NULL")
def scan_domain_nulls(spark, sf):
    df = T(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("k"))
    return df.where(Domain.values("F", nulls=True).column("k"))


@query(
    "scan_domain_kinds",
    "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-03-01' AND DATE '1996-02-29' AND o_orderdate::DATE <> DATE '1995-07-04' AND o_totalprice::DECIMAL(38,2) > 1000.50 AND encode(o_orderpriority) >= '2'::BLOB AND (o_totalprice < 5000 OR o_totalprice > 20000.5)",
)
def scan_domain_kinds(spark, sf):
    from datetime import date
    from decimal import Decimal

    day = Domain.between(date(1995, 3, 1), date(1996, 2, 29)).intersect(Domain.values(date(1995, 7, 4)).complement())
    price = Domain.between(None, 5000.0, high_open=True).union(Domain.between(20000.5, None, low_open=True))
    wide, text = Domain.between(Decimal("1000.50"), None, low_open=True), Domain.between(bytearray(b"2"))
    o = T(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date")).withColumn("wide", F.col("o_totalprice").cast("decimal(38,2)")).withColumn("bytes", F.col("o_orderpriority").cast("binary"))
    return o.where(tuple_domain({"day": day, "o_totalprice": price, "wide": wide, "bytes": text})).select("o_orderkey")


@query("scan_file_columns", "SELECT 'nation.parquet' AS file, count(*) AS n FROM nation")
def scan_file_columns(spark, sf):
    from ..sources.files import with_file_columns

    files = with_file_columns(T(spark, sf, "nation"))
    return files.groupBy(F.element_at(F.split(F.col("`$path`"), "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("n"))


@query("values_inline", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c')) AS t(a, b)")
def values_inline(spark, sf):
    return rows.values(spark, "a int, b string", [(1, "a"), (2, "b"), (3, "c")])


@query("empty_split", "SELECT * FROM nation WHERE false")
def empty_split(spark, sf):
    return T(spark, sf, "nation").limit(0)


@query("output", "SELECT n_name AS name, n_nationkey AS key FROM nation")
def output(spark, sf):
    return T(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))


@query("exchange_gather", "SELECT s_suppkey, s_name FROM supplier")
def exchange_gather(spark, sf):
    return exchange.gather(T(spark, sf, "supplier").select("s_suppkey", "s_name"))


@query("exchange_hash", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def exchange_hash(spark, sf):
    # the aggregation reuses the partitioning: one shuffle in all
    return exchange.hashed(T(spark, sf, "customer").select("c_nationkey"), ["c_nationkey"]).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("exchange_round_robin", "SELECT p_partkey, p_brand FROM part")
def exchange_round_robin(spark, sf):
    return exchange.round_robin(T(spark, sf, "part").select("p_partkey", "p_brand"), 8)


@query("exchange_merge", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey DESC")
def exchange_merge(spark, sf):
    return exchange.merged(T(spark, sf, "orders").select("o_custkey", "o_orderkey"), order("o_custkey"), order("o_orderkey", descending=True))


_ROW = "(((l_orderkey & ~31) >> 2) | (l_orderkey & 7)) - 1"


@query("tpch_bucket", f"SELECT l_orderkey, CAST(least(CAST(trunc(({_ROW}) / 2000.0) AS BIGINT), 5) AS INTEGER) AS bucket FROM lineitem")
def tpch_bucket(spark, sf):
    return T(spark, sf, "lineitem").select("l_orderkey", exchange.tpch_bucket("l_orderkey", 2000, list(range(6))).alias("bucket"))


@query("hive_bucket", "SELECT o_orderkey, CAST((xor(o_orderkey, o_orderkey >> 32) & 2147483647) % 16 AS INTEGER) AS bucket FROM orders")
def hive_bucket(spark, sf):
    return T(spark, sf, "orders").select("o_orderkey", exchange.hive_bucket("o_orderkey", 16, "bigint").alias("bucket"))


#: The signed UTF-8 bytes of a text, and their hash, in SQL.
_BYTES = "list_transform(range(1, strlen(t) + 1), lambda i: ('0x' || substr(hex(t), 2 * i - 1, 2))::BIGINT - CASE WHEN substr(hex(t), 2 * i - 1, 1) >= '8' THEN 256 ELSE 0 END)"
_HASH = f"list_reduce(list_concat([0::BIGINT], {_BYTES}), lambda a, c: (a * 31 + c) & 4294967295)"


@query("hive_bucket_keys", f"SELECT n_nationkey, CAST(({_HASH} & 2147483647) % 16 AS INTEGER) AS s, CAST(((({_HASH} * 31 + n_nationkey) & 4294967295) & 2147483647) % 16 AS INTEGER) AS b FROM (SELECT *, 'é' || n_name || '漢' AS t FROM nation)")
def hive_bucket_keys(spark, sf):
    n = T(spark, sf, "nation").withColumn("t", F.concat(F.lit("é"), "n_name", F.lit("漢")))
    return n.select("n_nationkey", exchange.hive_bucket("t", 16, "string").alias("s"), exchange.hive_bucket(["t", "n_nationkey"], 16, ["string", "int"]).alias("b"))


@query("exchange_handles", "SELECT 'SINGLE' AS h, s_suppkey FROM supplier UNION ALL SELECT 'FIXED_HASH', s_suppkey FROM supplier UNION ALL SELECT 'FIXED_ARBITRARY', s_suppkey FROM supplier")
def exchange_handles(spark, sf):
    out = None
    for h in ("SINGLE", "FIXED_HASH", "FIXED_ARBITRARY"):
        # a constant may stand among the keys
        one = exchange.by_handle(T(spark, sf, "supplier").select(F.lit(h).alias("h"), "s_suppkey"), h, ["s_suppkey", F.lit(7)])
        out = one if out is None else out.unionAll(one)
    return out


@query("project_expr", "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS disc_price, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_quantity + 1 AS q1, -l_tax AS neg FROM lineitem")
def project_expr(spark, sf):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return T(spark, sf, "lineitem").select("l_orderkey", price.alias("disc_price"), (price * (1 + F.col("l_tax"))).alias("charge"), (F.col("l_quantity") + 1).alias("q1"), (-F.col("l_tax")).alias("neg"))


@query("filter_where", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 10 AND (l_discount > 0.05 OR l_returnflag = 'R') AND l_shipdate <= TIMESTAMP '1998-12-01' - INTERVAL '90' DAY")
def filter_where(spark, sf):
    line = T(spark, sf, "lineitem").where((F.col("l_quantity") < 10) & ((F.col("l_discount") > 0.05) | (F.col("l_returnflag") == "R")))
    return line.where(F.expr("l_shipdate <= timestamp_ntz'1998-12-01' - interval '90' day")).select("l_orderkey", "l_quantity")


@query("pred_comparison", "SELECT n_nationkey, n_nationkey = 3 AS eq, n_nationkey <> 3 AS ne, n_nationkey < 3 AS lt, n_nationkey <= 3 AS le, n_nationkey > 3 AS gt, n_nationkey >= 3 AS ge FROM nation")
def pred_comparison(spark, sf):
    k = F.col("n_nationkey")
    return T(spark, sf, "nation").select("n_nationkey", (k == 3).alias("eq"), (k != 3).alias("ne"), (k < 3).alias("lt"), (k <= 3).alias("le"), (k > 3).alias("gt"), (k >= 3).alias("ge"))


_A = "nullif(n_regionkey, 1)"


@query("pred_is_distinct", f"SELECT n_nationkey, {_A} IS DISTINCT FROM nullif(n_regionkey, 2) AS d, {_A} IS NOT DISTINCT FROM nullif(n_regionkey, 2) AS s FROM nation")
def pred_is_distinct(spark, sf):
    a, b = F.nullif("n_regionkey", F.lit(1)), F.nullif("n_regionkey", F.lit(2))
    return T(spark, sf, "nation").select("n_nationkey", (~a.eqNullSafe(b)).alias("d"), a.eqNullSafe(b).alias("s"))


@query("pred_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 9 AND p_retailprice NOT BETWEEN 1000 AND 1500")
def pred_between(spark, sf):
    return T(spark, sf, "part").where(F.col("p_size").between(5, 9) & ~F.col("p_retailprice").between(1000, 1500)).select("p_partkey", "p_size")


@query("pred_in_list", "SELECT p_partkey, p_type FROM part WHERE p_type IN ('PROMO', 'SMALL') AND p_size NOT IN (1, 2, 3)")
def pred_in_list(spark, sf):
    return T(spark, sf, "part").where(F.col("p_type").isin("PROMO", "SMALL") & ~F.col("p_size").isin(1, 2, 3)).select("p_partkey", "p_type")


@query("pred_null", f"SELECT n_nationkey, {_A} IS NULL AS a, {_A} IS NOT NULL AS b FROM nation")
def pred_null(spark, sf):
    a = F.nullif("n_regionkey", F.lit(1))
    return T(spark, sf, "nation").select("n_nationkey", a.isNull().alias("a"), a.isNotNull().alias("b"))


@query("pred_logic", f"SELECT n_nationkey, ({_A} > 2) AND (n_nationkey > 9) AS a, ({_A} > 2) OR (n_nationkey > 9) AS o, NOT ({_A} > 2) AS n FROM nation")
def pred_logic(spark, sf):
    a = F.nullif("n_regionkey", F.lit(1)) > 2
    return T(spark, sf, "nation").select("n_nationkey", (a & (F.col("n_nationkey") > 9)).alias("a"), (a | (F.col("n_nationkey") > 9)).alias("o"), (~a).alias("n"))


@query("pred_like", r"SELECT p_partkey, p_name LIKE '%e_%' AS a, p_brand LIKE 'Brand#1_' AS b, concat(p_type, '_x') LIKE '%O\_x' ESCAPE '\' AS c, p_brand LIKE 'Brand##_1' ESCAPE '#' AS d FROM part")
def pred_like(spark, sf):
    return T(spark, sf, "part").select(
        "p_partkey", F.col("p_name").like("%e_%").alias("a"), F.col("p_brand").like("Brand#1_").alias("b"), F.like(F.concat("p_type", F.lit("_x")), F.lit("%O\\_x")).alias("c"), F.like(F.col("p_brand"), F.lit("Brand##_1"), F.lit("#")).alias("d"),
    )


@query("cast_try_cast", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,1)) AS d, TRY_CAST(o_orderpriority AS INTEGER) AS i, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_orderdate AS DATE) AS t, TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS p FROM orders")
def cast_try_cast(spark, sf):
    return T(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").cast("decimal(12,1)").alias("d"),
        F.col("o_orderpriority").try_cast("int").alias("i"),
        F.col("o_orderkey").cast("string").alias("s"),
        F.col("o_orderdate").cast("date").alias("t"),
        F.substring("o_orderpriority", 1, 1).try_cast("bigint").alias("p"),
    )


@query("enforce_single_row", "SELECT n_nationkey, (SELECT max(n_nationkey) FROM nation) AS top, (SELECT n_name FROM nation WHERE n_nationkey = -1) AS none FROM nation")
def enforce_single_row(spark, sf):
    n = T(spark, sf, "nation")
    one = rows.with_scalar(n.select("n_nationkey"), n.agg(F.max("n_nationkey").alias("top")))
    return rows.with_scalar(one, n.where("n_nationkey = -1").select(F.col("n_name").alias("none")))


@query("assign_unique_id", "SELECT count(*) AS n, count(*) AS ids FROM lineitem")
def assign_unique_id(spark, sf):
    return rows.assign_unique_id(T(spark, sf, "lineitem").select("l_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("unique_id").alias("ids"))


@query("expr_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS a, CASE p_type WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 END AS b FROM part")
def expr_case(spark, sf):
    s, t = F.col("p_size"), F.col("p_type")
    return T(spark, sf, "part").select("p_partkey", F.when(s < 10, "small").when(s < 30, "medium").otherwise("large").alias("a"), F.when(t == "PROMO", 1).when(t == "SMALL", 2).alias("b"))


@query("expr_coalesce", f"SELECT n_nationkey, coalesce({_A}, nullif(n_nationkey, 6), -1) AS c FROM nation")
def expr_coalesce(spark, sf):
    return T(spark, sf, "nation").select("n_nationkey", F.coalesce(F.nullif("n_regionkey", F.lit(1)), F.nullif("n_nationkey", F.lit(6)), F.lit(-1)).alias("c"))


@query("expr_if", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'one' ELSE 'other' END AS a, CASE WHEN n_regionkey = 1 THEN 'one' END AS b FROM nation")
def expr_if(spark, sf):
    c = F.col("n_regionkey") == 1
    return T(spark, sf, "nation").select("n_nationkey", F.when(c, "one").otherwise("other").alias("a"), F.when(c, "one").alias("b"))


@query("expr_nullif", "SELECT n_nationkey, nullif(n_regionkey, 3) AS a, nullif(n_name, 'NATION_3') AS b FROM nation")
def expr_nullif(spark, sf):
    return T(spark, sf, "nation").select("n_nationkey", F.nullif("n_regionkey", F.lit(3)).alias("a"), F.nullif("n_name", F.lit("NATION_3")).alias("b"))


@query("expr_row", "SELECT n_nationkey, struct_pack(k := n_nationkey, name := n_name, deep := struct_pack(r := n_regionkey)) AS r FROM nation")
def expr_row(spark, sf):
    return T(spark, sf, "nation").select("n_nationkey", F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("r")).alias("deep")).alias("r"))


@query("expr_dereference", "SELECT n_nationkey, r.name AS name, r.deep.r AS region FROM (SELECT n_nationkey, struct_pack(name := n_name, deep := struct_pack(r := n_regionkey)) AS r FROM nation)")
def expr_dereference(spark, sf):
    n = T(spark, sf, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("r")).alias("deep")).alias("r"))
    return n.select("n_nationkey", F.col("r").getField("name").alias("name"), F.col("r.deep.r").alias("region"))


@query("expr_subscript", "SELECT vec_id, embedding[1] AS first, embedding[64] AS last, map([label], [vec_id])[label] AS m FROM embeddings")
def expr_subscript(spark, sf):
    from ..functions.collections import map_subscript, subscript

    return T(spark, sf, "embeddings").select("vec_id", subscript("embedding", 1).alias("first"), subscript("embedding", 64).alias("last"), map_subscript(F.create_map("label", "vec_id"), F.col("label")).alias("m"))


@query("expr_arith", "SELECT p_partkey, p_size + 3 AS a, p_size - 3 AS b, p_size * 3 AS c, p_size // 3 AS d, p_size % 3 AS e, -p_size AS f, p_retailprice / 3 AS g FROM part")
def expr_arith(spark, sf):
    s = F.col("p_size")
    return T(spark, sf, "part").select("p_partkey", (s + 3).alias("a"), (s - 3).alias("b"), (s * 3).alias("c"), F.expr("cast(p_size div 3 as int)").alias("d"), (s % 3).alias("e"), (-s).alias("f"), (F.col("p_retailprice") / 3).alias("g"))


@query("expr_arith_decimal", "SELECT p_partkey, CAST(CAST(p_size AS DECIMAL(10,2)) + CAST(1.25 AS DECIMAL(4,2)) AS DECIMAL(12,2)) AS a, CAST(CAST(p_size AS DECIMAL(10,2)) * CAST(1.5 AS DECIMAL(3,1)) AS DECIMAL(14,3)) AS m FROM part")
def expr_arith_decimal(spark, sf):
    s = F.col("p_size").cast("decimal(10,2)")
    return T(spark, sf, "part").select("p_partkey", (s + F.lit("1.25").cast("decimal(4,2)")).cast("decimal(12,2)").alias("a"), (s * F.lit("1.5").cast("decimal(3,1)")).cast("decimal(14,3)").alias("m"))


@query(
    "expr_coercion",
    "SELECT p_partkey, p_size + p_partkey AS a, p_size + p_retailprice AS b, p_size::DECIMAL(10,2) + 1.5::DECIMAL(4,1) AS c, p_size::DECIMAL(10,2) - p_partkey::DECIMAL(12,1) AS d, p_size > p_partkey / 50.0::DOUBLE AS e, coalesce(nullif(p_size, 7)::BIGINT, p_partkey) AS f, p_size::SMALLINT = 7 AS g FROM part",
)
def expr_coercion(spark, sf):
    s, k = F.col("p_size"), F.col("p_partkey")
    d = s.cast("decimal(10,2)")
    return T(spark, sf, "part").select(
        "p_partkey", (s + k).alias("a"), (s + F.col("p_retailprice")).alias("b"), (d + F.lit("1.5").cast("decimal(4,1)")).alias("c"), (d - k.cast("decimal(12,1)")).alias("d"), (s > k / 50.0).alias("e"), F.coalesce(F.nullif(s, F.lit(7)), k).alias("f"), (s.cast("smallint") == 7).alias("g"),
    )


@query(
    "expr_literals",
    "SELECT n_nationkey, n_nationkey + 12345678901234.5678::DECIMAL(18,4) AS d, n_name::BLOB || '\\x00\\xFF'::BLOB AS b, DATE '2019-10-31' + n_nationkey AS t, TIMESTAMP '2012-10-31 05:30:00' + INTERVAL 1 HOUR * n_nationkey AS s, CASE WHEN n_nationkey > 3 THEN NULL ELSE 1.5::FLOAT END AS r, NULL::BIGINT AS n, n_nationkey::TINYINT AS y FROM nation",
)
def expr_literals(spark, sf):
    from datetime import date, datetime
    from decimal import Decimal

    k = F.col("n_nationkey")
    return T(spark, sf, "nation").select(
        "n_nationkey", (k.cast("decimal(10,0)") + F.lit(Decimal("12345678901234.5678"))).cast("decimal(19,4)").alias("d"), F.concat(F.col("n_name").cast("binary"), F.lit(b"\x00\xff")).alias("b"), F.date_add(F.lit(date(2019, 10, 31)), k).alias("t"),
        (F.lit(datetime(2012, 10, 31, 5, 30)).cast("timestamp_ntz") + F.make_interval(hours=k)).alias("s"), F.when(k > 3, F.lit(None)).otherwise(F.lit(1.5)).cast("float").alias("r"), F.lit(None).cast("bigint").alias("n"), k.cast("tinyint").alias("y"),
    )


@query("expr_try", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN NULL ELSE n_nationkey / n_regionkey END AS q, [10, 20][n_regionkey] AS e, TRY_CAST('x' || n_regionkey AS INTEGER) AS c, CASE WHEN n_nationkey < 16 THEN n_nationkey::BIGINT * 600000000000000000 END AS o FROM nation")
def expr_try(spark, sf):
    from ..functions.collections import try_subscript

    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    return T(spark, sf, "nation").select(
        "n_nationkey", F.try_divide(k, r).alias("q"), try_subscript(F.array(F.lit(10), F.lit(20)), r).alias("e"), F.concat(F.lit("x"), r.cast("string")).try_cast("int").alias("c"), F.try_multiply(k.cast("bigint"), F.lit(600000000000000000)).alias("o"),
    )


@query("unnest", "SELECT vec_id, i::INTEGER AS i, x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def unnest(spark, sf):
    return T(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x")).select("vec_id", (F.col("p") + 1).alias("i"), "x")


@query("unnest_several", "SELECT n_nationkey, unnest(['k', 'r']) AS k, unnest([n_nationkey, n_regionkey]) AS v, unnest([n_name, NULL]) AS s FROM nation")
def unnest_several(spark, sf):
    # a map gives two columns; the shorter array is filled up with nulls
    m = F.map_entries(F.create_map(F.lit("k"), F.col("n_nationkey"), F.lit("r"), F.col("n_regionkey")))
    both = T(spark, sf, "nation").select("n_nationkey", F.inline(F.arrays_zip(m.alias("m"), F.array("n_name").alias("s"))))
    return both.select("n_nationkey", "m.key", "m.value", "s").toDF("n_nationkey", "k", "v", "s")


@query("sample_bernoulli", "SELECT l_returnflag, count(*) AS n, true AS subset, true AS within FROM lineitem GROUP BY 1")
def sample_bernoulli(spark, sf):
    line = T(spark, sf, "lineitem").select("l_returnflag")
    n, k = line.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")), line.sample(fraction=0.5, seed=7).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("k"))
    return n.join(k, "l_returnflag").select("l_returnflag", "n", (F.col("k") < F.col("n")).alias("subset"), (F.abs(F.col("k") / F.col("n") - 0.5) < 0.1).alias("within"))


# Joins.

_OC = "SELECT c_custkey, c_name, o_orderkey FROM customer {} JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000"


def _customer_orders(spark, sf, how):
    c = T(spark, sf, "customer").select("c_custkey", "c_name")
    o = T(spark, sf, "orders").where("o_totalprice > 400000").select("o_custkey", "o_orderkey")
    return c.join(o, c.c_custkey == o.o_custkey, how).select("c_custkey", "c_name", "o_orderkey")


@query("join_inner", _OC.format(""))
def join_inner(spark, sf):
    return _customer_orders(spark, sf, "inner")


@query("join_left", _OC.format("LEFT"))
def join_left(spark, sf):
    return _customer_orders(spark, sf, "left")


@query("join_right", "SELECT c_custkey, c_name, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) RIGHT JOIN orders ON c_custkey = o_custkey")
def join_right(spark, sf):
    c = T(spark, sf, "customer").where("c_acctbal > 5000").select("c_custkey", "c_name")
    o = T(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return c.join(o, c.c_custkey == o.o_custkey, "right").select("c_custkey", "c_name", "o_orderkey")


@query("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 20")
def join_full(spark, sf):
    c, s = T(spark, sf, "customer").select("c_custkey"), T(spark, sf, "supplier").select("s_suppkey")
    # there are fifteen customers to a supplier, so that both sides have rows without a match
    return c.join(s, c.c_custkey == s.s_suppkey * 20, "full")


@query("join_residual", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 50")
def join_residual(spark, sf):
    c = T(spark, sf, "customer").select("c_custkey", "c_acctbal")
    o = T(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return c.join(o, (c.c_custkey == o.o_custkey) & (o.o_totalprice > c.c_acctbal * 50), "left").select("c_custkey", "o_orderkey")


@query("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(spark, sf):
    return T(spark, sf, "nation").select("n_name").crossJoin(T(spark, sf, "region").select("r_name"))


@query("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey + b.n_regionkey > 6")
def join_theta(spark, sf):
    n = T(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return n.alias("a").join(n.alias("b"), F.expr("a.n_nationkey < b.n_nationkey AND a.n_regionkey + b.n_regionkey > 6")).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@query("join_broadcast_hint", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def join_broadcast_hint(spark, sf):
    n = joins.broadcast_if_small(T(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))
    return T(spark, sf, "customer").select("c_nationkey").join(n, "c_nationkey").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("join_shuffle_hash", "SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def join_shuffle_hash(spark, sf):
    o = T(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority").hint("shuffle_hash")
    return T(spark, sf, "lineitem").select("l_orderkey").join(o, "l_orderkey").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    "join_mark",
    """SELECT n_nationkey, k IN (SELECT nullif(r_regionkey, 2) FROM region WHERE r_regionkey < 3) AS m, k IN (SELECT r_regionkey FROM region WHERE r_regionkey < 3) AS p, k IN (SELECT r_regionkey FROM region WHERE false) AS e
    FROM (SELECT n_nationkey, nullif(n_regionkey, 4) AS k FROM nation)""",
)
def join_mark(spark, sf):
    n = T(spark, sf, "nation").select("n_nationkey", F.nullif("n_regionkey", F.lit(4)).alias("k"))
    r = T(spark, sf, "region").where("r_regionkey < 3").select("r_regionkey", F.nullif("r_regionkey", F.lit(2)).alias("some"))
    marked = joins.mark_join(n, r, "k", "some", "m")
    marked = joins.mark_join(marked, r, "k", "r_regionkey", "p")
    return joins.mark_join(marked, r.where("false"), "k", "r_regionkey", "e").drop("k")


@query("join_mark_within", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'large' WHEN c_acctbal < 0 THEN 'owing' ELSE 'other' END AS kind FROM customer WHERE c_acctbal > 9000 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) OR c_acctbal < 0")
def join_mark_within(spark, sf):
    large = T(spark, sf, "orders").where("o_totalprice > 400000").select("o_custkey")
    m = joins.mark_join(T(spark, sf, "customer").select("c_custkey", "c_acctbal"), large, "c_custkey", "o_custkey", "m")
    return m.where("c_acctbal > 9000 OR m OR c_acctbal < 0").select("c_custkey", F.when(F.col("m"), "large").when(F.col("c_acctbal") < 0, "owing").otherwise("other").alias("kind"))


@query("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def join_semi(spark, sf):
    return joins.semi_join(T(spark, sf, "customer").select("c_custkey"), T(spark, sf, "orders").where("o_totalprice > 450000"), "c_custkey", "o_custkey")


@query("join_anti_null_aware", "SELECT c_custkey, 1 AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 5) FROM orders)")
def join_anti_null_aware(spark, sf):
    c, o = T(spark, sf, "customer").select("c_custkey"), T(spark, sf, "orders").select("o_custkey", "o_totalprice", F.nullif("o_custkey", F.lit(5)).alias("n"))
    one = joins.null_aware_anti_join(c, o.where("o_totalprice > 300000"), "c_custkey", "o_custkey").withColumn("side", F.lit(1))
    return one.unionAll(joins.null_aware_anti_join(c, o, "c_custkey", "n").withColumn("side", F.lit(2)))


@query("join_exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
def join_exists(spark, sf):
    register(spark, sf, ("supplier", "lineitem"))
    return spark.sql("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")


@query("join_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1999-06-01')")
def join_not_exists(spark, sf):
    late = T(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("1999-06-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey"))
    return T(spark, sf, "customer").select("c_custkey").join(late, "c_custkey", "left_anti")


@query("join_spatial", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON pow(c_acctbal / 100 - s_acctbal / 100, 2) + pow(c_nationkey - s_nationkey, 2) <= 4")
def join_spatial(spark, sf):
    c = T(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    s = T(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("u"), F.col("s_nationkey").cast("double").alias("v"))
    return joins.distance_join(c, s, ("x", "y"), ("u", "v"), 2.0).select("c_custkey", "s_suppkey")


@query("table_function", "SELECT n_nationkey, i::BIGINT AS i, i * n_regionkey AS x FROM nation, range(0, 5) AS t(i)")
def table_function(spark, sf):
    T(spark, sf, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, id AS i, id * n_regionkey AS x FROM nation, LATERAL (SELECT id FROM range(0, 5))")


@query("join_range", "SELECT p_partkey, k FROM part JOIN (SELECT s_suppkey AS k, 900 + s_suppkey * 11 AS lo, 900 + s_suppkey * 11 + 25 AS hi FROM supplier) ON p_retailprice >= lo AND p_retailprice < hi")
def join_range(spark, sf):
    bands = T(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), (900 + F.col("s_suppkey") * 11).cast("double").alias("lo"), (925 + F.col("s_suppkey") * 11).cast("double").alias("hi"))
    return joins.range_join(T(spark, sf, "part").select("p_partkey", "p_retailprice"), bands, "p_retailprice", "lo", "hi", 25.0).select("p_partkey", "k")


_ASOF = """WITH v AS (SELECT user_id, ts, max(event_id) AS last_view FROM events WHERE event_type = 'view' GROUP BY 1, 2), p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
    SELECT p.event_id, p.user_id, v.last_view FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts"""


def _last_views(spark, sf, slice_of):
    e = T(spark, sf, "events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_view"))
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return joins.asof_join(bought, views, ["user_id"], "ts", "ts", ["last_view"], slice_of=slice_of).select("event_id", "user_id", "last_view")


@query("join_asof", _ASOF)
def join_asof(spark, sf):
    return _last_views(spark, sf, None)


@query("join_asof_sliced", _ASOF)
def join_asof_sliced(spark, sf):
    return _last_views(spark, sf, lambda t: F.date_trunc("day", t))


@query("join_decorrelated", "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def join_decorrelated(spark, sf):
    register(spark, sf, ("orders",))
    return spark.sql("SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
