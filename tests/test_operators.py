import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import collections, mathematics
from quarry.operators import aggregates, exchange, grouping, joins, rows, windows
from quarry.operators.ordering import key, limit_with_ties
from quarry.operators.predicates import Domain
from quarry.sources.files import reader_of, scan
from quarry.sources.types import BadType, parse


# Domains.

_VALUES = st.one_of(st.none(), st.integers(-6, 6))


@st.composite
def domains(draw):
    out = Domain.none()
    for _ in range(draw(st.integers(0, 3))):
        low, high = draw(_VALUES), draw(_VALUES)
        out = out.union(Domain.between(low, high, draw(st.booleans()), draw(st.booleans())) if draw(st.booleans()) else Domain.values(draw(st.integers(-6, 6))))
    return Domain(out.ranges, draw(st.booleans()))


@settings(max_examples=300, deadline=None)
@given(domains(), domains(), st.one_of(st.none(), st.integers(-8, 8)))
def test_domain_algebra(a, b, v):
    assert a.union(b).contains(v) == (a.contains(v) or b.contains(v))
    assert a.intersect(b).contains(v) == (a.contains(v) and b.contains(v))
    assert a.complement().contains(v) != a.contains(v)
    assert a.complement().complement() == a
    assert a.overlaps(b) == b.overlaps(a)


def test_domain_filters(spark):
    df = spark.createDataFrame([(i,) for i in [None, *range(-8, 9)]], "x int")
    cases = [
        Domain.all(), Domain.none(), Domain.only_null(), Domain.not_null(), Domain.values(1), Domain.values(1, 2, 5, nulls=True), Domain.values(1, 2).complement(), Domain.values(3).complement().intersect(Domain.not_null()),
        Domain.between(-2, 3), Domain.between(-2, 3, True, True, nulls=True), Domain.between(None, 0), Domain.between(4, None, True), Domain.between(-5, -2).union(Domain.between(2, 4)).union(Domain.values(7, 8)),
    ]
    for d in cases:
        assert sorted(r.x is None or r.x + 100 for r in df.where(d.column("x")).collect()) == sorted(v is None or v + 100 for v in [None, *range(-8, 9)] if d.contains(v)), d


def test_domain_reaches_the_scan(spark, sf):
    df = scan(spark, f"{sf}/orders.parquet", columns=["o_orderkey"], where=Domain.between(5, 9).union(Domain.values(20)).column("o_orderkey"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan


# Partitioning.


def sparse(i):
    return i >> 3 << 5 | i & 7


#: Keys and partitions that the bucket function must give (fixed values).
@pytest.mark.parametrize(
    ("buckets", "want"),
    [(1, [0] * 8), (2, [0, 0, 0, 0, 1, 0, 1, 1]), (3, [0, 0, 0, 1, 2, 1, 2, 1]), (4, [0, 0, 0, 1, 3, 1, 3, 2]), (5, [0, 0, 0, 1, 4, 2, 4, 3]), (6, [0, 0, 1, 2, 4, 2, 5, 3])],
)
def test_tpch_buckets(spark, buckets, want):
    keys = [None, *[sparse(i) for i in (11, 2346, 4391, 9877, 5688, 12345, 7813)]]
    df = spark.createDataFrame(list(enumerate(keys)), "i int, k long")
    got = df.select("i", exchange.tpch_bucket("k", 12345 // buckets, list(range(buckets))).alias("b")).orderBy("i").collect()
    assert [r.b for r in got] == want


def test_hive_buckets(spark):
    df = spark.createDataFrame([(5, "ab", True), (None, None, None), (-1, "", False)], "a long, s string, b boolean")
    got = df.select(exchange.hive_bucket("a", 8, "bigint").alias("a"), exchange.hive_bucket("s", 8, "string").alias("s"), exchange.hive_bucket("b", 8, "boolean").alias("b")).collect()
    assert [tuple(r) for r in got] == [(5, (97 * 31 + 98) % 8, 1), (0, 0, 0), (((-1 ^ 0xFFFFFFFF) & 0x7FFFFFFF) % 8, 0, 0)]
    with pytest.raises(ValueError):
        exchange.hive_bucket("a", 8, "double")
    # signed UTF-8 bytes; several columns; time and date
    df = spark.createDataFrame([("é", 3)], "s string, i int").withColumn("t", F.expr("timestamp '1970-01-01 00:00:01.5'")).withColumn("d", F.expr("date '1970-01-11'"))
    text = 31 * (0xC3 - 256) + (0xA9 - 256)
    second = 1 << 30 | 500_000_000
    want = (text & 0x7FFFFFFF) % 16, ((31 * text + 3) & 0x7FFFFFFF) % 16, (second >> 32 ^ second) & 0x7FFFFFFF, 10
    got = df.select(exchange.hive_bucket("s", 16, "string"), exchange.hive_bucket(["s", "i"], 16, ["string", "int"]), exchange.hive_bucket("t", 1 << 31, "timestamp"), exchange.hive_bucket("d", 16, "date")).first()
    assert tuple(got) == want == (6, *want[1:])


def test_other_partitionings_are_errors(spark):
    with pytest.raises(ValueError, match="unsupported partitioning"):
        exchange.by_handle(spark.range(3), "SOURCE_DISTRIBUTION")
    assert exchange.by_handle(spark.range(30), "FIXED_HASH", [F.lit(7)], 4).select(F.spark_partition_id()).distinct().count() == 1


# Rows.


def test_enforce_single_row(spark):
    df = spark.range(3).withColumn("x", F.col("id") * 2)
    assert [tuple(r) for r in rows.enforce_single_row(df.where("id = 1")).collect()] == [(1, 2)]
    assert [tuple(r) for r in rows.enforce_single_row(df.where("id > 9")).collect()] == [(None, None)]
    with pytest.raises(Exception, match="more than one row"):
        rows.enforce_single_row(df).collect()


def test_values_without_columns_keep_their_rows(spark):
    assert rows.values(spark, "a int, b string", [(1, "a"), (2, None)]).count() == 2


def test_limit_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,), (None,)], "x int")
    get = lambda n, *k: sorted(str(r[0]) for r in limit_with_ties(df, n, *k).collect())
    assert get(2, key("x")) == ["1", "2", "2"]
    assert get(5, key("x")) == ["1", "2", "2", "3", "None", "None"]
    assert get(1, key("x", nulls_first=True)) == ["None", "None"]
    assert get(2, key("x", descending=True)) == ["2", "2", "3"]
    # names and literals that look like orders, and expressions
    odd = df.withColumnRenamed("x", "a DESC b")
    got = limit_with_ties(odd, 2, key(F.col("`a DESC b`") * F.length(F.lit("x ASC NULLS FIRST")), descending=True))
    assert sorted(r[0] for r in got.collect()) == [2, 2, 3]


# Joins.


@pytest.mark.parametrize("build", [[1, None], [1], [], [None]])
def test_in_as_a_value_and_not_in(spark, build):
    probe = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(b,) for b in build], "v int")

    def inside(k):
        if not build:
            return False
        if k is None:
            return None
        return True if k in build else None if None in build else False

    got = {r.k: r.m for r in joins.mark_join(probe, right, "k", "v", "m").collect()}
    assert got == {k: inside(k) for k in (1, 2, None)}
    assert {r.k for r in joins.null_aware_anti_join(probe, right, "k", "v").collect()} == {k for k in (1, 2, None) if inside(k) is False}


def test_range_join_is_a_nested_loop(spark):
    p = spark.createDataFrame([(float(i) / 3,) for i in range(-30, 60)], "x double")
    r = spark.createDataFrame([(i, i * 2.5 - 12, i * 2.5 - 12 + i) for i in range(8)], "i int, lo double, hi double")
    got = {(a.x, a.i) for a in joins.range_join(p, r, "x", "lo", "hi", 4.0).collect()}
    assert got == {(a.x, b.i) for a in p.collect() for b in r.collect() if b.lo <= a.x < b.hi}


def test_as_of_joins(spark):
    """The latest row at or before, by a loop; whole keys and slices of them give the same."""
    left = [(k, t, i) for i, (k, t) in enumerate(itertools.product([1, 2, None], [None, 0, 3, 7, 10, 25, 99]))]
    right = [(1, 3, "a"), (1, 9, "b"), (1, 24, "c"), (2, 50, "d"), (None, 5, "e"), (None, None, "f"), (3, 1, "g"), (1, 9, "z")]
    a, b = spark.createDataFrame(left, "k int, t int, i int"), spark.createDataFrame(right, "k int, u int, x string")
    want = {}
    for k, t, i in left:
        found = [(u, x) for j, u, x in right if j == k and u is not None and t is not None and u <= t]
        want[i] = max(found)[1] if found else None
    for slice_of in (None, lambda t: F.floor(t / 10), lambda t: t):
        got = joins.asof_join(a, b, ["k"], "t", "u", ["x"], [F.col("x")], slice_of).collect()
        assert {r.i: r.x for r in got} == want and len(got) == len(left)


def test_broadcast_is_checked(spark):
    assert "ResolvedHint" in joins.broadcast_if_small(spark.range(10))._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in joins.broadcast_if_small(spark.range(10**9))._jdf.queryExecution().analyzed().toString()


# Aggregates.


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "bigint", "real", "double"])
@pytest.mark.parametrize("groups", [1, 2, 3, 4, 5])
def test_sums_by_type(spark, kind, groups):
    data = [(i % groups, v) for i, v in enumerate([1, 2, 3, 4, 5, None])]
    df = spark.createDataFrame(data, "g int, v int").select("g", F.col("v").cast(kind).alias("v"))
    out = df.groupBy("g").agg(aggregates.typed_sum("v", kind).alias("s"), F.count("v").alias("n"))
    assert dict(out.dtypes)["s"] == {"real": "float", "double": "double"}.get(kind, "bigint")
    want = {g: [v for k, v in data if k == g and v is not None] for g in range(groups)}
    assert {r.g: (r.s, r.n) for r in out.collect()} == {g: (sum(v) if v else None, len(v)) for g, v in want.items()}


def test_partial_sums_merge(spark):
    df = spark.createDataFrame([(0, 10.0), (0, 20.0), (1, None)], "g int, v double")
    part = df.groupBy("g", F.rand(1).alias("r")).agg(aggregates.partial_sum("v").alias("s"))
    assert {r.g: (r.t, r.a) for r in part.groupBy("g").agg(aggregates.merge_sum("s").alias("t"), aggregates.merge_avg("s").alias("a")).collect()} == {0: (30.0, 15.0), 1: (None, None)}


def test_group_id_of_no_rows(spark):
    df = spark.createDataFrame([], "a int, b int, v int")
    got = grouping.cube(df, ["a", "b"], F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), group_id="g").collect()
    assert [tuple(r) for r in got] == [(None, None, 3, 0, None)]


def test_overflow_and_casts_raise(spark):
    for text in ("SELECT sum(x) FROM VALUES (9223372036854775807), (1) AS t(x)", "SELECT cast('x' AS int)", "SELECT cast(99999.99D AS decimal(6,2))", "SELECT element_at(array(1, 2), 3)"):
        with pytest.raises(Exception, match="OVERFLOW|CAST_INVALID|OUT_OF_RANGE|INVALID_ARRAY_INDEX"):
            spark.sql(text).collect()


def test_checksum_counts_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, s string")
    get = lambda d: d.agg(aggregates.checksum("k", "s")).first()[0]
    assert get(df) == get(df.orderBy(F.desc("k"))) and len({get(df), get(df.distinct()), get(df.unionAll(df)), get(df.where("k = 1"))}) == 4
    assert get(df.limit(0)) is None


def test_first_values_of_groups(spark):
    rows = [(g, None if i % 5 == 0 else i * 7 % 11, i) for g in (1, 2, None) for i in range(20)]
    df = spark.createDataFrame(rows, "g int, x int, k int")
    for f, down in ((aggregates.min_by_n, False), (aggregates.max_by_n, True)):
        got = {r.g: r.v for r in f(df, ["g"], "k", "x", 4, "v").collect()}
        assert got == {g: [k for x, k in sorted(((x, k) for h, x, k in rows if h == g and x is not None), reverse=down)[:4]] for g in (1, 2, None)}


# Windows.


def test_varying_frames(spark):
    inf = float("inf")
    values = [None, None, inf, 1.0, 2.0, None, float("nan"), 4.0]
    rows = [(p, i, v, before, after) for p in (0, 1) for i, (v, before, after) in enumerate(zip(values, [0, 1, 0, 0, 3, None, 0, 9], [0, 0, 0, 0, -1, 0, -1, 1], strict=True))]
    df = spark.createDataFrame(rows, "p int, i int, v double, b int, a int")
    out = windows.varying_rows(df, "v", windows.fold_sum, ["p"], [F.col("i")], "b", "a", "s")
    out = windows.varying_rows(out, "v", windows.fold_count, ["p"], [F.col("i")], "b", "a", "n")
    got = {(r.p, r.i): (r.s, r.n) for r in out.collect()}
    for p, i, _, b, a in rows:
        frame = [v for q, j, v, *_ in rows if q == p and b is not None and i - b <= j <= i + a and v is not None]
        s, n = got[p, i]
        assert n == len(frame)
        assert s is None if not frame else (s != s if any(v != v for v in frame) else s == sum(frame))


# Functions.


def test_combinations_of_longer_arrays(spark):
    df = spark.createDataFrame([(list("abcdefgh"),), ([],), (None,), (["x"],)], "a array<string>")
    got = [r.c for r in df.select(collections.combinations("a", 3).alias("c")).collect()]
    want = sorted(itertools.combinations("abcdefgh", 3), key=lambda p: p[::-1])
    assert [tuple(p) for p in got[0]] == want and got[1:] == [[], None, []]
    with pytest.raises(ValueError):
        collections.combinations("a", 6)
    with pytest.raises(Exception, match="max size"):
        spark.range(1).select(collections.combinations(F.sequence(F.lit(1), F.lit(60)), 5)).collect()


def test_distributions_of_large_parameters(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    d = lambda v: F.lit(float(v))
    for a in (1e3, 1e5, 1e7):
        # the median of a gamma distribution lies near shape - 1/3
        assert abs(get(mathematics.gamma_cdf(d(a), d(1), d(a - 1 / 3))) - 0.5) < 1e-5
    assert abs(get(mathematics.gamma_cdf(d(1e5), d(1), d(1e5))) - 0.5) < 1e-3
    assert abs(get(mathematics.beta_cdf(d(1e5), d(1e5), d(0.5))) - 0.5) < 1e-6
    assert abs(get(mathematics.f_cdf(d(2e4), d(2e4), d(1))) - 0.5) < 1e-6
    # normal approximations
    assert abs(get(mathematics.poisson_cdf(d(1e6), F.lit(1_000_000))) - 0.5) < 1e-3
    assert abs(get(mathematics.binomial_cdf(100_000, d(0.5), F.lit(50_000))) - 0.5) < 2e-3


# Domains.


def test_domains_of_many_values_and_of_nan():
    a, b = Domain.values(*range(0, 20_000, 2)), Domain.values(*range(0, 20_000, 3))
    assert a.intersect(b) == Domain.values(*range(0, 20_000, 6))
    assert a.overlaps(b) and not a.overlaps(Domain.values(1, 3, 20_001)) and a.overlaps(Domain.between(5, 7))
    with pytest.raises(ValueError):
        Domain.between(float("nan"))
    with pytest.raises(ValueError):
        Domain.values(1.0, float("nan"))


def test_open_ranges_leave_out_nan(spark):
    df = spark.createDataFrame([(1.0,), (9.0,), (float("nan"),), (None,)], "x double")
    assert [r.x for r in df.where(Domain.between(2.0).column("x")).collect()] == [9.0]


# Types and sources.


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("boolean", T.BooleanType()), ("int", T.IntegerType()), ("INTEGER", T.IntegerType()), ("double precision", T.DoubleType()), ("varchar(25)", T.StringType()), ("char(3)", T.StringType()), ("decimal(10,5)", T.DecimalType(10, 5)), ("timestamp", T.TimestampNTZType()),
        ("timestamp(3) with time zone", T.TimestampType()), ("interval day to second", T.DayTimeIntervalType()), ("array(array(bigint))", T.ArrayType(T.ArrayType(T.LongType()))),
        ("map(bigint,map(bigint,map(varchar,bigint)))", T.MapType(T.LongType(), T.MapType(T.LongType(), T.MapType(T.StringType(), T.LongType())))),
        ("row(a bigint,b array(bigint),c row(a bigint))", T.StructType().add("a", "long").add("b", T.ArrayType(T.LongType())).add("c", T.StructType().add("a", "long"))),
        ("row(bigint, varchar)", T.StructType().add("col0", "long").add("col1", "string")), ('row("x y" double precision)', T.StructType().add("x y", "double")), ("unknown", T.NullType()),
    ],
)
def test_types(text, want):
    assert parse(text) == want


@pytest.mark.parametrize("text", ["blah()", "array()", "map()", "x", "time with time zone", "interval year to month", "decimal", "decimal(20)", "decimal(40,2)", "array(bigint", "map(bigint)", "bigint)", "", "varchar(a)"])
def test_wrong_types(text):
    with pytest.raises(BadType):
        parse(text)


def test_readers():
    assert reader_of("com.facebook.hive.orc.OrcInputFormat") == "orc"
    with pytest.raises(ValueError):
        reader_of("org.apache.hadoop.hive.ql.io.RCFileInputFormat")


def test_text_formats_need_a_schema(spark):
    with pytest.raises(ValueError):
        scan(spark, "/nowhere", "csv")


def test_nothing_else_imports_the_corpus_operators():
    import pathlib

    import quarry

    root = pathlib.Path(quarry.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p


# Functions without an oracle.


@pytest.mark.parametrize("kind", ["md5", "sha1", "sha256", "sha512"])
@pytest.mark.parametrize("key", [b"k", b"x" * 200])
def test_hmac(spark, kind, key):
    import hmac

    from quarry.functions.strings import hmac as keyed

    got = spark.range(1).select(keyed(F.lit(b"text"), key, kind).alias("h")).first().h
    assert bytes(got) == hmac.new(key, b"text", kind).digest()


def test_wilson_interval(spark):
    from quarry.functions import mathematics as M

    low, high = spark.range(1).select(M.wilson_interval_lower(F.lit(1250), F.lit(1310), F.lit(1.96)), M.wilson_interval_upper(F.lit(1250), F.lit(1310), F.lit(1.96))).first()
    assert abs(low - 0.9414883725395894) < 1e-9 and abs(high - 0.9642524717143908) < 1e-9
