"""The TPC-H queries on the tables at hand, as DataFrame plans.

There is no partsupp table: ``part_supply`` derives one from lineitem.  Where a column is missing another takes its
part (return flags for ship modes and late receipts, nation keys for phone prefixes).  Every plan names the columns it
reads and filters before it joins, so that scans are pruned; which side is broadcast is left to the optimizer's sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.mathematics import rounded
from ..operators.joins import null_aware_anti_join
from ..operators.ordering import order, top_n
from ..operators.rows import with_scalar
from ..registry import query
from ..tables import table


def _day(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _within(column: str, first: str, after: str) -> Column:
    return (F.col(column) >= _day(first)) & (F.col(column) < _day(after))


def _revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _money(x: Column | str) -> Column:
    return rounded(x, 2)


def _nations(spark: SparkSession, sf: str, key: str, name: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name))


def part_supply(spark: SparkSession, sf: str, parts: DataFrame | None = None) -> DataFrame:
    """Part, supplier, the least unit price and the number of deliveries.  ``parts``: of these (p_partkey) only, so that
    the other deliveries never reach the shuffle, as no join is pushed below an aggregate."""
    line = table(spark, sf, "lineitem")
    if parts is not None:
        line = line.join(parts.select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    return line.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("ps_supplycost"), F.count(F.lit(1)).alias("ps_availqty"))


#: The same table for the oracles.
PS = "ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice / l_quantity) AS ps_supplycost, count(*) AS ps_availqty FROM lineitem GROUP BY 1, 2)"


@query(
    "tpch_q01",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
    round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL ORDER BY 1, 2""",
)
def q01(spark, sf):
    kept = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= _day("2000-09-02"))
    grouped = kept.groupBy("l_returnflag", "l_linestatus").agg(
        _money(F.sum("l_quantity")).alias("sum_qty"),
        _money(F.sum("l_extendedprice")).alias("sum_base_price"),
        _money(F.sum(_revenue())).alias("sum_disc_price"),
        _money(F.sum(_revenue() * (1 + F.col("l_tax")))).alias("sum_charge"),
        rounded(F.avg("l_quantity"), 4).alias("avg_qty"),
        rounded(F.avg("l_extendedprice"), 4).alias("avg_price"),
        rounded(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count(F.lit(1)).alias("count_order"),
    )
    return grouped.orderBy(order("l_returnflag"), order("l_linestatus"))


@query(
    "tpch_q02",
    f"""WITH {PS}, eu AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'),
    offers AS (SELECT *, min(ps_supplycost) OVER (PARTITION BY ps_partkey) AS best FROM ps JOIN eu ON s_suppkey = ps_suppkey)
    SELECT round(s_acctbal, 2) AS s_acctbal, s_name, n_name, p_partkey, p_brand FROM offers JOIN part ON p_partkey = ps_partkey
    WHERE ps_supplycost = best AND p_size = 15 AND p_type LIKE '%PROMO' ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
)
def q02(spark, sf):
    part = table(spark, sf, "part").where((F.col("p_size") == 15) & F.col("p_type").endswith("PROMO")).select("p_partkey", "p_brand")
    europe = table(spark, sf, "region").where("r_name = 'EUROPE'").select(F.col("r_regionkey").alias("n_regionkey"))
    near = table(spark, sf, "nation").join(europe, "n_regionkey").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    sellers = table(spark, sf, "supplier").join(near, "s_nationkey").select(F.col("s_suppkey").alias("ps_suppkey"), "s_acctbal", "s_name", "n_name")
    offers = part_supply(spark, sf, part).join(part, F.col("ps_partkey") == F.col("p_partkey")).join(sellers, "ps_suppkey")
    cheapest = offers.withColumn("best", F.min("ps_supplycost").over(Window.partitionBy("p_partkey"))).where("ps_supplycost = best")
    out = cheapest.select(_money("s_acctbal").alias("s_acctbal"), "s_name", "n_name", "p_partkey", "p_brand")
    return top_n(out, 100, order("s_acctbal", descending=True), order("n_name"), order("s_name"), order("p_partkey"))


@query(
    "tpch_q03",
    """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey
    JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
    GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
)
def q03(spark, sf):
    buyers = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    placed = table(spark, sf, "orders").where(F.col("o_orderdate") < _day("1998-03-15")).select("o_orderkey", "o_custkey", "o_orderdate").join(buyers, "o_custkey")
    late = table(spark, sf, "lineitem").where(F.col("l_shipdate") > _day("1998-03-15")).select("l_orderkey", "l_extendedprice", "l_discount")
    joined = late.join(placed, late.l_orderkey == placed.o_orderkey)
    grouped = joined.groupBy("l_orderkey", "o_orderdate").agg(_money(F.sum(_revenue())).alias("revenue")).select("l_orderkey", "revenue", "o_orderdate")
    return top_n(grouped, 10, order("revenue", descending=True), order("o_orderdate"), order("l_orderkey"))


@query(
    "tpch_q04",
    """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate < TIMESTAMP '1997-10-01'
    AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1 ORDER BY 1""",
)
def q04(spark, sf):
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    placed = table(spark, sf, "orders").where(_within("o_orderdate", "1997-07-01", "1997-10-01")).join(returned, "o_orderkey", "left_semi")
    return placed.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("order_count")).orderBy(order("o_orderpriority"))


@query(
    "tpch_q05",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
    JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = n_nationkey
    WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1 ORDER BY 2 DESC, 1""",
)
def q05(spark, sf):
    asia = table(spark, sf, "nation").join(table(spark, sf, "region").where("r_name = 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey")), "n_regionkey").select("n_nationkey", "n_name")
    buyers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")).join(asia, "n_nationkey")
    placed = table(spark, sf, "orders").where(_within("o_orderdate", "1996-01-01", "1997-01-01")).select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(buyers, "o_custkey")
    sellers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    joined = line.join(placed, "l_orderkey").join(sellers, ["l_suppkey", "n_nationkey"])
    return joined.groupBy("n_name").agg(_money(F.sum(_revenue())).alias("revenue")).orderBy(order("revenue", descending=True), order("n_name"))


@query(
    "tpch_q06",
    """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
    AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
)
def q06(spark, sf):
    kept = table(spark, sf, "lineitem").where(_within("l_shipdate", "1996-01-01", "1997-01-01") & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return kept.agg(_money(F.sum(F.col("l_extendedprice") * F.col("l_discount"))).alias("revenue"))


@query(
    "tpch_q07",
    """SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, CAST(year(l_shipdate) AS INTEGER) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey
    WHERE (a.n_name, b.n_name) IN (('NATION_6', 'NATION_7'), ('NATION_7', 'NATION_6')) AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
    GROUP BY ALL ORDER BY 1, 2, 3""",
)
def q07(spark, sf):
    two = ["NATION_6", "NATION_7"]
    sellers = table(spark, sf, "supplier").join(_nations(spark, sf, "s_nationkey", "supp_nation").where(F.col("supp_nation").isin(two)), "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "supp_nation")
    buyers = table(spark, sf, "customer").join(_nations(spark, sf, "c_nationkey", "cust_nation").where(F.col("cust_nation").isin(two)), "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "cust_nation")
    placed = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(buyers, "o_custkey")
    line = table(spark, sf, "lineitem").where(_within("l_shipdate", "1995-01-01", "1997-01-01")).select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", F.year("l_shipdate").alias("l_year"))
    joined = line.join(sellers, "l_suppkey").join(placed, "l_orderkey").where("supp_nation <> cust_nation")
    return joined.groupBy("supp_nation", "cust_nation", "l_year").agg(_money(F.sum(_revenue())).alias("revenue")).orderBy(order("supp_nation"), order("cust_nation"), order("l_year"))


@query(
    "tpch_q08",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year,
    round(sum(CASE WHEN s.n_name = 'NATION_1' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS mkt_share
    FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN nation c ON c.n_nationkey = c_nationkey JOIN region ON r_regionkey = c.n_regionkey JOIN nation s ON s.n_nationkey = s_nationkey
    WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY' AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1 ORDER BY 1""",
)
def q08(spark, sf):
    part = table(spark, sf, "part").where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("l_partkey"))
    america = table(spark, sf, "nation").join(table(spark, sf, "region").where("r_name = 'AMERICA'").select(F.col("r_regionkey").alias("n_regionkey")), "n_regionkey").select(F.col("n_nationkey").alias("c_nationkey"))
    buyers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(america, "c_nationkey", "left_semi").select("o_custkey")
    placed = table(spark, sf, "orders").where(_within("o_orderdate", "1995-01-01", "1997-01-01")).join(buyers, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("o_year"))
    sellers = table(spark, sf, "supplier").join(_nations(spark, sf, "s_nationkey", "seller"), "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "seller")
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", _revenue().alias("volume"))
    joined = line.join(part, "l_partkey").join(placed, "l_orderkey").join(sellers, "l_suppkey")
    share = F.sum(F.when(F.col("seller") == "NATION_1", F.col("volume")).otherwise(0.0)) / F.sum("volume")
    return joined.groupBy("o_year").agg(rounded(share, 6).alias("mkt_share")).orderBy(order("o_year"))


@query(
    "tpch_q09",
    f"""WITH {PS} SELECT n_name AS nation, CAST(year(o_orderdate) AS INTEGER) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity), 2) AS sum_profit
    FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN ps ON ps_partkey = l_partkey AND ps_suppkey = l_suppkey
    JOIN orders ON o_orderkey = l_orderkey JOIN nation ON n_nationkey = s_nationkey WHERE p_name LIKE 'blue%' GROUP BY ALL ORDER BY 1, 2 DESC""",
)
def q09(spark, sf):
    part = table(spark, sf, "part").where(F.col("p_name").startswith("blue")).select(F.col("p_partkey").alias("l_partkey"))
    sellers = table(spark, sf, "supplier").join(_nations(spark, sf, "s_nationkey", "nation"), "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "nation")
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount").join(part, "l_partkey", "left_semi")
    # the cost of a part and seller is a window over the very rows that are joined: no second scan, one shuffle
    cost = F.min(F.col("l_extendedprice") / F.col("l_quantity")).over(Window.partitionBy("l_partkey", "l_suppkey"))
    priced = line.withColumn("cost", cost).withColumn("profit", _revenue() - F.col("cost") * F.col("l_quantity"))
    placed = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("o_year"))
    joined = priced.join(placed, "l_orderkey").join(sellers, "l_suppkey")
    return joined.groupBy("nation", "o_year").agg(_money(F.sum("profit")).alias("sum_profit")).orderBy(order("nation"), order("o_year", descending=True))


@query(
    "tpch_q10",
    """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(c_acctbal, 2) AS c_acctbal, n_name FROM customer JOIN orders ON o_custkey = c_custkey
    JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1997-10-01' AND o_orderdate < TIMESTAMP '1998-01-01'
    GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
def q10(spark, sf):
    placed = table(spark, sf, "orders").where(_within("o_orderdate", "1997-10-01", "1998-01-01")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_extendedprice", "l_discount")
    # summed by customer before the customer's columns are fetched
    spent = returned.join(placed, "l_orderkey").groupBy("c_custkey").agg(F.sum(_revenue()).alias("revenue"))
    out = spent.join(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey"), "c_custkey").join(_nations(spark, sf, "c_nationkey", "n_name"), "c_nationkey")
    out = out.select("c_custkey", "c_name", _money("revenue").alias("revenue"), _money("c_acctbal").alias("c_acctbal"), "n_name")
    return top_n(out, 20, order("revenue", descending=True), order("c_custkey"))


@query(
    "tpch_q11",
    f"""WITH {PS}, own AS (SELECT ps_partkey, sum(ps_supplycost * ps_availqty) AS v FROM ps JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_7' GROUP BY 1)
    SELECT ps_partkey, round(v, 1) AS value FROM own WHERE v > (SELECT sum(v) * 0.001 FROM own) ORDER BY value DESC, ps_partkey""",
)
def q11(spark, sf):
    sellers = table(spark, sf, "supplier").join(_nations(spark, sf, "s_nationkey", "n").where("n = 'NATION_7'"), "s_nationkey", "left_semi").select(F.col("s_suppkey").alias("ps_suppkey"))
    held = part_supply(spark, sf).join(sellers, "ps_suppkey", "left_semi").groupBy("ps_partkey").agg(F.sum(F.col("ps_supplycost") * F.col("ps_availqty")).alias("v"))
    limit = held.agg((F.sum("v") * 0.001).alias("least"))
    return with_scalar(held, limit).where("v > least").select("ps_partkey", rounded("v", 1).alias("value")).orderBy(order("value", descending=True), order("ps_partkey"))


@query(
    "tpch_q12",
    """SELECT l_returnflag, count_if(o_orderpriority IN ('1-URGENT', '2-HIGH'))::BIGINT AS high_line_count, count_if(o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))::BIGINT AS low_line_count
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1 ORDER BY 1""",
)
def q12(spark, sf):
    line = table(spark, sf, "lineitem").where(F.col("l_returnflag").isin("A", "R") & _within("l_shipdate", "1996-01-01", "1997-01-01")).select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    joined = line.join(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    return joined.groupBy("l_returnflag").agg(F.count_if(urgent).alias("high_line_count"), F.count_if(~urgent).alias("low_line_count")).orderBy(order("l_returnflag"))


@query(
    "tpch_q13",
    """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY 1)
    GROUP BY 1 ORDER BY 2 DESC, 1 DESC""",
)
def q13(spark, sf):
    # orders are counted by customer first: the outer join then meets one row for each
    placed = table(spark, sf, "orders").where(~F.col("o_orderpriority").contains("URGENT")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    held = table(spark, sf, "customer").select("c_custkey").join(placed, "c_custkey", "left").select(F.coalesce("n", F.lit(0)).alias("c_count"))
    return held.groupBy("c_count").agg(F.count(F.lit(1)).alias("custdist")).orderBy(order("custdist", descending=True), order("c_count", descending=True))


@query(
    "tpch_q14",
    """SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6)::DOUBLE AS promo_revenue
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1996-09-01' AND l_shipdate < TIMESTAMP '1996-10-01'""",
)
def q14(spark, sf):
    line = table(spark, sf, "lineitem").where(_within("l_shipdate", "1996-09-01", "1996-10-01")).select(F.col("l_partkey").alias("p_partkey"), _revenue().alias("v"))
    joined = line.join(table(spark, sf, "part").select("p_partkey", "p_type"), "p_partkey")
    promo = F.sum(F.when(F.col("p_type").startswith("PROMO"), F.col("v")).otherwise(0.0))
    return joined.agg(rounded(100.0 * promo / F.sum("v"), 6).alias("promo_revenue"))


@query(
    "tpch_q15",
    """WITH r AS (SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY 1)
    SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN r ON s_suppkey = l_suppkey WHERE total_revenue = (SELECT max(total_revenue) FROM r) ORDER BY 1""",
)
def q15(spark, sf):
    line = table(spark, sf, "lineitem").where(_within("l_shipdate", "1996-01-01", "1996-04-01"))
    sold = line.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(_money(F.sum(_revenue())).alias("total_revenue"))
    best = with_scalar(sold, sold.agg(F.max("total_revenue").alias("top"))).where("total_revenue = top")
    return best.join(table(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_suppkey").select("s_suppkey", "s_name", "total_revenue").orderBy(order("s_suppkey"))


@query(
    "tpch_q16",
    f"""WITH {PS} SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM ps JOIN part ON p_partkey = ps_partkey WHERE p_brand <> 'Brand#25' AND p_type NOT LIKE 'MEDIUM%'
    AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY ALL ORDER BY 4 DESC, 1, 2, 3""",
)
def q16(spark, sf):
    part = table(spark, sf, "part").where((F.col("p_brand") != "Brand#25") & ~F.col("p_type").startswith("MEDIUM") & F.col("p_size").isin(49, 14, 23, 45, 19, 3, 36, 9)).select("p_partkey", "p_brand", "p_type", "p_size")
    sold = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey").join(part, "p_partkey")
    trusted = null_aware_anti_join(sold, table(spark, sf, "supplier").where("s_acctbal < 0"), "l_suppkey", "s_suppkey")
    counted = trusted.groupBy("p_brand", "p_type", "p_size").agg(F.countDistinct("l_suppkey").alias("supplier_cnt"))
    return counted.orderBy(order("supplier_cnt", descending=True), order("p_brand"), order("p_type"), order("p_size"))


@query(
    "tpch_q17",
    """SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM (SELECT l_extendedprice, l_quantity, avg(l_quantity) OVER (PARTITION BY l_partkey) AS a FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE p_brand = 'Brand#23') WHERE l_quantity < 0.2 * a""",
)
def q17(spark, sf):
    part = table(spark, sf, "part").where("p_brand = 'Brand#23'").select(F.col("p_partkey").alias("l_partkey"))
    line = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice").join(part, "l_partkey", "left_semi")
    small = line.withColumn("usual", F.avg("l_quantity").over(Window.partitionBy("l_partkey"))).where("l_quantity < 0.2 * usual")
    return small.agg(_money(F.sum("l_extendedprice") / 7.0).alias("avg_yearly"))


@query(
    "tpch_q18",
    """WITH big AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 300)
    SELECT c_name, c_custkey, o_orderkey, o_orderdate, round(o_totalprice, 2) AS o_totalprice, round(q, 2) AS sum_qty FROM big JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
)
def q18(spark, sf):
    big = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q")).where("q > 300")
    placed = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_totalprice").join(big, "o_orderkey")
    out = placed.join(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey")
    out = out.select("c_name", "c_custkey", "o_orderkey", "o_orderdate", _money("o_totalprice").alias("o_totalprice"), _money("q").alias("sum_qty"))
    return top_n(out, 100, order("o_totalprice", descending=True), order("o_orderdate"), order("o_orderkey"))


#: Brand, least and greatest quantity, greatest size of the three branches.
BRANCHES = (("Brand#12", 1, 11, 5), ("Brand#23", 10, 20, 10), ("Brand#24", 20, 30, 15))


@query(
    "tpch_q19",
    "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE "
    + " OR ".join(f"(p_brand = '{b}' AND l_quantity BETWEEN {lo} AND {hi} AND p_size BETWEEN 1 AND {size})" for b, lo, hi, size in BRANCHES),
)
def q19(spark, sf):
    of_part, of_both = F.lit(False), F.lit(False)
    for brand, low, high, size in BRANCHES:
        part = (F.col("p_brand") == brand) & F.col("p_size").between(1, size)
        of_part, of_both = of_part | part, of_both | (part & F.col("l_quantity").between(low, high))
    part = table(spark, sf, "part").where(of_part).select("p_partkey", "p_brand", "p_size")
    line = table(spark, sf, "lineitem").where(F.col("l_quantity").between(1, 30)).select(F.col("l_partkey").alias("p_partkey"), "l_quantity", "l_extendedprice", "l_discount")
    return line.join(part, "p_partkey").where(of_both).agg(_money(F.sum(_revenue())).alias("revenue"))


@query(
    "tpch_q20",
    f"""WITH {PS} SELECT s_suppkey, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_7' AND s_suppkey IN (SELECT ps_suppkey FROM ps
    WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'blue%') AND ps_availqty * 20 > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey
    AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01')) ORDER BY 2, 1""",
)
def q20(spark, sf):
    part = table(spark, sf, "part").where(F.col("p_name").startswith("blue")).select(F.col("p_partkey").alias("l_partkey"))
    line = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_shipdate").join(part, "l_partkey", "left_semi")
    # stock and the year's sales of a part and seller come from one pass
    year = F.when(_within("l_shipdate", "1996-01-01", "1997-01-01"), F.col("l_quantity"))
    ample = line.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("held"), F.sum(year).alias("sold")).where("held * 20 > 0.5 * sold")
    sellers = table(spark, sf, "supplier").join(_nations(spark, sf, "s_nationkey", "n").where("n = 'NATION_7'"), "s_nationkey", "left_semi")
    return sellers.join(ample.select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi").select("s_suppkey", "s_name").orderBy(order("s_name"), order("s_suppkey"))


@query(
    "tpch_q21",
    """SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON n_nationkey = s_nationkey
    WHERE o_orderstatus = 'F' AND l_returnflag = 'R' AND n_name = 'NATION_7' AND EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_suppkey <> l.l_suppkey)
    AND NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_orderkey = l.l_orderkey AND y.l_suppkey <> l.l_suppkey AND y.l_returnflag = 'R') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""",
)
def q21(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    # "another seller" and "no other returning seller" are facts of an order: least and greatest seller tell them
    returning = F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))
    facts = line.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("z"), F.min(returning).alias("ra"), F.max(returning).alias("rz")).where("a < z AND ra = rz").select("l_orderkey")
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    sellers = table(spark, sf, "supplier").join(_nations(spark, sf, "s_nationkey", "n").where("n = 'NATION_7'"), "s_nationkey", "left_semi").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    kept = line.where("l_returnflag = 'R'").join(sellers, "l_suppkey").join(facts, "l_orderkey", "left_semi").join(done, "l_orderkey", "left_semi")
    return top_n(kept.groupBy("s_name").agg(F.count(F.lit(1)).alias("numwait")), 100, order("numwait", descending=True), order("s_name"))


@query(
    "tpch_q22",
    """WITH c AS (SELECT * FROM customer WHERE c_nationkey IN (13, 21, 23, 19, 20, 18, 17)) SELECT c_nationkey AS cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM c
    WHERE c_acctbal > (SELECT avg(c_acctbal) FROM c WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01') GROUP BY 1 ORDER BY 1""",
)
def q22(spark, sf):
    some = table(spark, sf, "customer").where(F.col("c_nationkey").isin(13, 21, 23, 19, 20, 18, 17)).select("c_custkey", "c_nationkey", "c_acctbal")
    rich = with_scalar(some, some.where("c_acctbal > 0").agg(F.avg("c_acctbal").alias("usual"))).where("c_acctbal > usual")
    recent = table(spark, sf, "orders").where(F.col("o_orderdate") >= _day("2000-01-01")).select(F.col("o_custkey").alias("c_custkey"))
    idle = rich.join(recent, "c_custkey", "left_anti")
    return idle.groupBy(F.col("c_nationkey").alias("cntrycode")).agg(F.count(F.lit(1)).alias("numcust"), _money(F.sum("c_acctbal")).alias("totacctbal")).orderBy(order("cntrycode"))
