"""Queries of the scalar function library, by category, on columns of the tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import collections as C
from ..functions import datetimes as D
from ..functions import documents as J
from ..functions import mathematics as M
from ..functions import strings as S
from ..functions import user as U
from ..registry import query
from ..tables import table

T = table


def _r(x, n=6):
    return M.rounded(x, n)


@query(
    "fn_math_basic",
    """SELECT c_custkey, abs(c_acctbal) AS a, round(cbrt(c_acctbal), 6) AS b, CAST(ceil(c_acctbal) AS DOUBLE) AS c, CAST(floor(c_acctbal) AS DOUBLE) AS d, round(exp(c_nationkey / 10.0)::DOUBLE, 6) AS e, round(ln(c_custkey + 1), 6) AS f,
    round(log2(c_custkey + 1), 6) AS g, round(log10(c_custkey + 1), 6) AS h, round(pow(c_nationkey, 2), 6) AS i, round(sqrt(c_custkey), 6) AS j, CAST(sign(c_acctbal) AS DOUBLE) AS k, c_custkey % 7 AS l, round(c_acctbal, 1) AS m, trunc(c_acctbal) AS n FROM customer""",
)
def fn_math_basic(spark, sf):
    x, k = F.col("c_acctbal"), F.col("c_custkey")
    return T(spark, sf, "customer").select(
        "c_custkey", F.abs(x).alias("a"), _r(F.cbrt(x)).alias("b"), M.ceiling(x).alias("c"), M.floor(x).alias("d"), _r(F.exp(F.col("c_nationkey") / 10.0)).alias("e"), _r(M.ln(k + 1)).alias("f"), _r(F.log2(k + 1)).alias("g"),
        _r(F.log10(k + 1)).alias("h"), _r(F.pow("c_nationkey", F.lit(2))).alias("i"), _r(F.sqrt(k)).alias("j"), M.sign(x, "double").alias("k"), (k % 7).alias("l"), _r(x, 1).alias("m"), M.truncate(x).alias("n"),
    )


@query(
    "fn_math_trig",
    """SELECT n_nationkey, round(sin(n_nationkey), 6) AS a, round(cos(n_nationkey), 6) AS b, round(tan(n_nationkey), 6) AS c, round(asin(n_nationkey / 25.0::DOUBLE), 6) AS d, round(acos(n_nationkey / 25.0::DOUBLE), 6) AS e, round(atan(n_nationkey), 6) AS f,
    round(atan2(n_nationkey, 3), 6) AS g, round(sinh(n_nationkey / 5.0::DOUBLE), 6) AS h, round(cosh(n_nationkey / 5.0::DOUBLE), 6) AS i, round(tanh(n_nationkey), 6) AS j, round(degrees(n_nationkey), 6) AS k, round(radians(n_nationkey), 6) AS l, round(pi() + exp(1), 6) AS m FROM nation""",
)
def fn_math_trig(spark, sf):
    k = F.col("n_nationkey")
    return T(spark, sf, "nation").select(
        "n_nationkey", _r(F.sin(k)).alias("a"), _r(F.cos(k)).alias("b"), _r(F.tan(k)).alias("c"), _r(F.asin(k / 25.0)).alias("d"), _r(F.acos(k / 25.0)).alias("e"), _r(F.atan(k)).alias("f"), _r(F.atan2(k, F.lit(3))).alias("g"),
        _r(F.sinh(k / 5.0)).alias("h"), _r(F.cosh(k / 5.0)).alias("i"), _r(F.tanh(k)).alias("j"), _r(F.degrees(k)).alias("k"), _r(F.radians(k)).alias("l"), _r(F.pi() + F.e()).alias("m"),
    )


@query(
    "fn_math_shims",
    """SELECT p_partkey, CASE WHEN p_size = 5 THEN NULL ELSE greatest(p_size, 10) END AS g, CASE WHEN p_size = 5 THEN NULL ELSE least(p_size, 10) END AS l, greatest(10, least(p_size, 20)) AS c, trunc(p_retailprice * 10) / 10 AS t,
    len(list_filter([0.0, 10.0, 20.0], lambda b: b <= p_size))::INTEGER AS w, CASE WHEN p_size < 5 THEN 0 WHEN p_size >= 45 THEN 5 ELSE floor((p_size - 5) / 10.0)::BIGINT + 1 END AS v, printf('%x', p_size) AS x, p_size::BIGINT AS f FROM part""",
)
def fn_math_shims(spark, sf):
    s = F.col("p_size")
    odd = F.nullif(s, F.lit(5))
    return T(spark, sf, "part").select(
        "p_partkey", M.greatest(odd, F.lit(10)).alias("g"), M.least(odd, F.lit(10)).alias("l"), M.clamp(s, F.lit(10), F.lit(20)).alias("c"), M.truncate("p_retailprice", 1).alias("t"), M.width_bucket(s.cast("double"), F.array(F.lit(0.0), F.lit(10.0), F.lit(20.0))).alias("w"),
        F.width_bucket(s.cast("double"), F.lit(5.0), F.lit(45.0), F.lit(4)).alias("v"), M.to_base(s, 16).alias("x"), M.from_base(M.to_base(s, 2), 2).alias("f"),
    )


@query("fn_math_ieee", "SELECT n_nationkey, isnan(x) AS a, isinf(x) AS b, isfinite(x) AS c FROM (SELECT n_nationkey, CASE n_nationkey WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE ELSE n_nationkey END AS x FROM nation)")
def fn_math_ieee(spark, sf):
    k = F.col("n_nationkey")
    n = T(spark, sf, "nation").select("n_nationkey", F.when(k == 0, float("nan")).when(k == 1, float("inf")).otherwise(k.cast("double")).alias("x"))
    inf = F.abs("x") == float("inf")
    return n.select("n_nationkey", F.isnan("x").alias("a"), inf.alias("b"), (~F.isnan("x") & ~inf).alias("c"))


@query("fn_math_vectors", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 5) AS c, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS n FROM embeddings")
def fn_math_vectors(spark, sf):
    d = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return T(spark, sf, "embeddings").select("vec_id", _r(M.cosine_similarity("embedding", F.reverse("embedding")), 5).alias("c"), _r(norm, 5).alias("n"))


@query(
    "fn_math_distributions",
    """SELECT n_nationkey, round(0.5 + atan((n_nationkey - 10) / 3.0::DOUBLE) / pi(), 6) AS c, round(CASE WHEN n_nationkey < 10 THEN exp((n_nationkey - 10) / 3.0::DOUBLE) / 2 ELSE 1 - exp(-(n_nationkey - 10) / 3.0::DOUBLE) / 2 END, 6) AS l,
    round(CASE WHEN n_nationkey <= 0 THEN 0 ELSE 1 - exp(-pow(n_nationkey / 8.0::DOUBLE, 1.5)) END, 6) AS w FROM nation""",
)
def fn_math_distributions(spark, sf):
    k = F.col("n_nationkey").cast("double")
    return T(spark, sf, "nation").select("n_nationkey", _r(M.cauchy_cdf(F.lit(10.0), F.lit(3.0), k)).alias("c"), _r(M.laplace_cdf(F.lit(10.0), F.lit(3.0), k)).alias("l"), _r(M.weibull_cdf(F.lit(1.5), F.lit(8.0), k)).alias("w"))


@query("fn_bitwise", "SELECT p_partkey, p_size & 6 AS a, p_size | 6 AS o, xor(p_size, 6) AS x, ~p_size AS n, p_size::BIGINT << 3 AS l, p_size::BIGINT >> 1 AS r, bit_count(p_size)::BIGINT AS c, (p_size::BIGINT << 2) & 15 AS m FROM part")
def fn_bitwise(spark, sf):
    s = F.col("p_size")
    return T(spark, sf, "part").select("p_partkey", s.bitwiseAND(6).alias("a"), s.bitwiseOR(6).alias("o"), s.bitwiseXOR(6).alias("x"), F.bitwise_not(s).alias("n"), M.shift_left(s, 3).alias("l"), M.shift_right(s, 1).alias("r"), M.bit_count(s, 64).alias("c"), M.shift_left(s, 2, 4).alias("m"))


@query("fn_random", "SELECT true AS unit, true AS uuid FROM (SELECT 1)")
def fn_random(spark, sf):
    n = T(spark, sf, "nation").select(F.rand(1).alias("r"), F.length(F.uuid()).alias("u"))
    return n.agg(F.bool_and((F.col("r") >= 0) & (F.col("r") < 1)).alias("unit"), F.bool_and(F.col("u") == 36).alias("uuid"))


@query(
    "fn_string_basic",
    """SELECT p_partkey, concat(p_brand, '-', p_type) AS a, concat_ws('/', p_brand, NULL, p_type) AS b, length(p_name)::INTEGER AS c, lower(p_type) AS d, upper(p_name) AS e, lpad(p_type, 10, '*-') AS f, rpad(p_type, 4, '.') AS g, replace(p_name, 'e', '') AS h,
    reverse(p_name) AS i, split_part(p_name, ' ', 2) AS j, starts_with(p_name, 'blue') AS k, ends_with(p_name, 'n') AS l, strpos(p_name, 'e')::INTEGER AS m, substr(p_name, 2, 3) AS n, substr(p_name, -3) AS o, translate(p_name, 'aei', '123') AS p, trim('  x ' || p_type || ' ') AS q,
    ltrim('  x') AS r, rtrim('x  ') AS s, trim(p_type, 'PO') AS t, repeat(p_type, 2) AS u, p_brand || p_name AS v FROM part""",
)
def fn_string_basic(spark, sf):
    n, t, b = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    return T(spark, sf, "part").select(
        "p_partkey", F.concat(b, F.lit("-"), t).alias("a"), F.concat_ws("/", b, F.lit(None), t).alias("b"), F.char_length(n).alias("c"), F.lower(t).alias("d"), F.upper(n).alias("e"), F.lpad(t, 10, "*-").alias("f"), F.rpad(t, 4, ".").alias("g"), F.replace(n, F.lit("e"), F.lit("")).alias("h"),
        F.reverse(n).alias("i"), S.split_part(n, " ", 2).alias("j"), F.startswith(n, F.lit("blue")).alias("k"), F.endswith(n, F.lit("n")).alias("l"), S.strpos(n, "e").alias("m"), F.substr(n, F.lit(2), F.lit(3)).alias("n"), F.substr(n, F.lit(-3)).alias("o"), F.translate(n, "aei", "123").alias("p"),
        F.trim(F.concat(F.lit("  x "), t, F.lit(" "))).alias("q"), F.ltrim(F.lit("  x")).alias("r"), F.rtrim(F.lit("x  ")).alias("s"), S.trim_of(t, "PO").alias("t"), F.repeat(t, 2).alias("u"), F.concat(b, n).alias("v"),
    )


@query(
    "fn_string_shims",
    """SELECT p_partkey, chr(8364) AS a, unicode(substr(p_name, 1, 1))::INTEGER AS b, string_split(p_name, ' ') AS c, nullif(split_part(p_name, ' ', 3), '') AS d, levenshtein(p_type, 'SMALL')::INTEGER AS e, CASE WHEN length(p_type) = 5 THEN hamming(p_type, 'SMALL')::BIGINT END AS f,
    CASE WHEN strpos(reverse(p_name), 'e') = 0 THEN 0 ELSE length(p_name) - strpos(reverse(p_name), 'e') + 1 END::INTEGER AS g FROM part""",
)
def fn_string_shims(spark, sf):
    n, t = F.col("p_name"), F.col("p_type")
    return T(spark, sf, "part").select(
        "p_partkey", S.chr_(F.lit(8364)).alias("a"), S.codepoint(n).alias("b"), S.split(n, " ").alias("c"), S.split_part(n, " ", 3).alias("d"), F.levenshtein(t, F.lit("SMALL")).alias("e"), F.when(F.char_length(t) == 5, S.hamming_distance(t, F.lit("SMALL"))).alias("f"), S.strrpos(n, "e").alias("g"),
    )


@query("fn_string_unicode", "SELECT doc_id, length(text)::INTEGER AS n, strlen(text)::INTEGER AS b, md5(lower(text)) AS u, md5(nfc_normalize(text)) AS f, md5(substr(text, 3)) AS s FROM documents")
def fn_string_unicode(spark, sf):
    x = F.col("text")
    return T(spark, sf, "documents").select("doc_id", F.char_length(x).alias("n"), F.octet_length(x).alias("b"), F.md5(F.lower(x)).alias("u"), F.md5(S.normalize(x)).alias("f"), F.md5(F.substr(x, F.lit(3))).alias("s"))


@query(
    "fn_string_more",
    """SELECT p_partkey, string_split(p_name, ' ')[1:1] || CASE WHEN strpos(p_name, ' ') > 0 THEN [substr(p_name, strpos(p_name, ' ') + 1)] ELSE [] END AS l, CASE WHEN len(string_split(p_name, 'e')) > 2 THEN (strlen(string_split(p_name, 'e')[1]) + strlen(string_split(p_name, 'e')[2]) + 2)::INTEGER ELSE 0 END AS i,
    (p_name || '_' || p_type) LIKE '%#_' || p_type ESCAPE '#' AS k, 'x' || p_type LIKE '%$%%' ESCAPE '$' AS q, CASE left(p_type, 1) WHEN 'S' THEN 'S540' WHEN 'P' THEN 'P650' WHEN 'M' THEN 'M350' WHEN 'L' THEN 'L620' WHEN 'E' THEN 'E255' END AS x FROM (SELECT *, replace(p_name, p_name, p_name) AS z FROM part WHERE p_type IN ('SMALL', 'PROMO'))""",
)
def fn_string_more(spark, sf):
    n, t = F.col("p_name"), F.col("p_type")
    both = F.concat(n, F.lit("_"), t)
    return T(spark, sf, "part").where("p_type IN ('SMALL', 'PROMO')").select(
        "p_partkey", S.split(n, " ", 2).alias("l"), S.strpos(n, "e", 2).alias("i"), F.like(both, F.concat(F.lit("%#_"), t), F.lit("#")).alias("k"), F.like(F.concat(F.lit("x"), t), F.lit("%$%%"), F.lit("$")).alias("q"), F.soundex(t).alias("x"),
    )


@query(
    "fn_word_stem",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'run' WHEN 1 THEN 'happi' WHEN 2 THEN 'relat' WHEN 3 THEN 'hope' WHEN 4 THEN 'generous' ELSE 'sky' END AS s FROM part""",
)
def fn_word_stem(spark, sf):
    words = F.array(*[F.lit(w) for w in ("running", "happiness", "relational", "hoping", "generously", "sky")])
    return T(spark, sf, "part").select("p_partkey", S.word_stem(F.element_at(words, (F.col("p_partkey") % 6 + 1).cast("int"))).alias("s"))


@query(
    "fn_regexp",
    r"""SELECT page_id, CASE WHEN regexp_matches(url, '([a-z]+)://') THEN regexp_extract(url, '([a-z]+)://', 1) END AS a, CASE WHEN regexp_matches(url, 'page=(\d+)') THEN regexp_extract(url, 'page=(\d+)', 1) END AS b, regexp_extract_all(url, '[0-9]+') AS c, regexp_matches(url, 'example\.(com|net)') AS d,
    regexp_replace(url, '[0-9]', '#', 'g') AS e, string_split_regex(url, '[/.]') AS f, len(regexp_extract_all(url, '[a-z]'))::INTEGER AS g FROM pages""",
)
def fn_regexp(spark, sf):
    u = F.col("url")
    return T(spark, sf, "pages").select(
        "page_id", S.regexp_extract(u, "([a-z]+)://", 1).alias("a"), S.regexp_extract(u, r"page=(\d+)", 1).alias("b"), S.regexp_extract_all(u, "[0-9]+").alias("c"), F.regexp_like(u, F.lit(r"example\.(com|net)")).alias("d"), S.regexp_replace(u, "[0-9]", "#").alias("e"), F.split(u, "[/.]").alias("f"),
        F.regexp_count(u, F.lit("[a-z]")).alias("g"),
    )


@query("fn_regexp_position", "SELECT page_id, CASE WHEN regexp_matches(url, '[0-9]') THEN strpos(url, regexp_extract(url, '[0-9]'))::INTEGER ELSE -1 END AS p, -1 AS q FROM pages")
def fn_regexp_position(spark, sf):
    return T(spark, sf, "pages").select("page_id", S.regexp_position("url", "[0-9]").alias("p"), S.regexp_position("url", "[€]").alias("q"))


@query("fn_format", "SELECT p_partkey, printf('%03d|%s|%.2f', p_size, p_type, p_retailprice) AS f FROM part")
def fn_format(spark, sf):
    return T(spark, sf, "part").select("p_partkey", F.format_string("%03d|%s|%.2f", "p_size", "p_type", "p_retailprice").alias("f"))


@query("fn_split_to_map", "SELECT n_nationkey, n_name AS a, n_regionkey::VARCHAR AS b FROM nation")
def fn_split_to_map(spark, sf):
    m = S.split_to_map(F.concat(F.lit("name="), "n_name", F.lit(",region="), F.col("n_regionkey").cast("string")), ",", "=")
    return T(spark, sf, "nation").select("n_nationkey", m["name"].alias("a"), m["region"].alias("b"))


@query(
    "fn_binary",
    "SELECT n_nationkey, base64(n_name::BLOB) AS a, from_base64(base64(n_name::BLOB))::VARCHAR AS b, hex(n_name) AS c, md5(n_name) AS d, sha1(n_name) AS e, sha256(n_name) AS f, lpad(printf('%X', n_nationkey), 16, '0') AS g, n_nationkey::BIGINT AS h, n_name AS i FROM nation",
)
def fn_binary(spark, sf):
    b = S.to_utf8("n_name")
    low = lambda x: F.lower(F.hex(x))
    return T(spark, sf, "nation").select(
        "n_nationkey", F.base64(b).alias("a"), S.from_utf8(F.unbase64(F.base64(b))).alias("b"), F.hex(b).alias("c"), low(S.digest(b, "md5")).alias("d"), low(S.digest(b, "sha1")).alias("e"), low(S.digest(b, "sha256")).alias("f"), F.hex(S.to_big_endian_64("n_nationkey")).alias("g"),
        S.from_big_endian_64(S.to_big_endian_64("n_nationkey")).alias("h"), S.from_utf8(b).alias("i"),
    )


@query("fn_hash_properties", "SELECT count(*) AS n, count(*) AS x, count(*) AS m FROM nation")
def fn_hash_properties(spark, sf):
    return T(spark, sf, "nation").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.xxhash64("n_name")).alias("x"), F.countDistinct(F.hash("n_name")).alias("m"))


#: Published digests of fixed inputs (fixed values): XXH64 and MurmurHash3 (x64, 128 bits), seed 0.
_DIGESTS = {"": ("ef46db3751d8e999", "0" * 32), "The quick brown fox jumps over the lazy dog": ("0b242d361fda71bc", "6c1b07bc7bbc4be347939ac4a93c437a")}


@query("fn_hash_exact", " UNION ALL ".join(f"SELECT '{t}' AS t, '{x}' AS x, '{m}' AS m" for t, (x, m) in _DIGESTS.items()))
def fn_hash_exact(spark, sf):
    texts = T(spark, sf, "region").limit(1).select(F.explode(F.array(*[F.lit(t) for t in _DIGESTS])).alias("t"))
    return texts.select("t", F.lower(F.hex(S.xxhash64(S.to_utf8("t")))).alias("x"), F.lower(F.hex(S.murmur3(S.to_utf8("t")))).alias("m"))


_PADDED = {"ipad": "36", "opad": "5c"}


def _hmac_sql(key: bytes) -> str:
    """HMAC-SHA-256 spelled out with a plain digest."""
    k = key.ljust(64, b"\0")
    pad = {n: bytes(x ^ int(v, 16) for x in k).hex() for n, v in _PADDED.items()}
    return f"sha256(from_hex('{pad['opad']}') || from_hex(sha256(from_hex('{pad['ipad']}') || n_name::BLOB)))"


@query("fn_binary_more", f"SELECT n_nationkey, from_hex(hex(n_name))::VARCHAR AS a, {_hmac_sql(b'key')} AS m, CASE WHEN n_nationkey < 0 THEN NULL ELSE 128 END AS l, 3421780262 AS c FROM nation")
def fn_binary_more(spark, sf):
    b = S.to_utf8("n_name")
    return T(spark, sf, "nation").select(
        "n_nationkey", S.from_utf8(F.unhex(F.hex(b))).alias("a"), F.lower(F.hex(S.hmac(b, b"key", "sha256"))).alias("m"), F.length(F.hex(S.digest(b, "sha512"))).alias("l"), F.crc32(F.lit("123456789").cast("binary")).alias("c"),
    )


@query(
    "fn_datetime_parts",
    """SELECT o_orderkey, year(o_orderdate)::INTEGER AS a, quarter(o_orderdate)::INTEGER AS b, month(o_orderdate)::INTEGER AS c, day(o_orderdate)::INTEGER AS d, isodow(o_orderdate)::INTEGER AS e, dayofyear(o_orderdate)::INTEGER AS f, weekofyear(o_orderdate)::INTEGER AS g,
    isoyear(o_orderdate)::INTEGER AS h, last_day(o_orderdate) AS i, o_orderdate::DATE AS j FROM orders""",
)
def fn_datetime_parts(spark, sf):
    d = F.col("o_orderdate")
    return T(spark, sf, "orders").select(
        "o_orderkey", F.year(d).alias("a"), F.quarter(d).alias("b"), F.month(d).alias("c"), F.dayofmonth(d).alias("d"), D.day_of_week(d).alias("e"), F.dayofyear(d).alias("f"), F.weekofyear(d).alias("g"), D.year_of_week(d).cast("int").alias("h"), D.last_day_of_month(d).alias("i"), d.cast("date").alias("j")
    )


@query("fn_datetime_clock", "SELECT event_id, hour(ts)::INTEGER AS h, minute(ts)::INTEGER AS m, second(ts)::INTEGER AS s, (millisecond(ts) % 1000)::BIGINT AS ms, round(epoch(ts), 3) AS u, date_trunc('hour', ts) AS t, strftime(ts, '%Y-%m-%d %H:%M') AS f FROM events")
def fn_datetime_clock(spark, sf):
    t = F.col("ts")
    return T(spark, sf, "events").select("event_id", F.hour(t).alias("h"), F.minute(t).alias("m"), F.second(t).alias("s"), D.millisecond(t).alias("ms"), _r(D.to_unixtime(t), 3).alias("u"), D.date_trunc("hour", t).alias("t"), D.date_format(t, "%Y-%m-%d %H:%i").alias("f"))


@query(
    "fn_datetime_arith",
    """SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS a, o_orderdate + INTERVAL 1 MONTH AS b, o_orderdate - INTERVAL 90 DAY AS c, o_orderdate + INTERVAL 6 MONTH AS d, datesub('day', TIMESTAMP '1995-01-01', o_orderdate)::BIGINT AS e,
    datesub('month', TIMESTAMP '1995-01-01', o_orderdate)::BIGINT AS f, o_orderdate + INTERVAL 2 YEAR AS g FROM orders""",
)
def fn_datetime_arith(spark, sf):
    d, zero = F.col("o_orderdate"), F.lit("1995-01-01").cast("timestamp_ntz")
    return T(spark, sf, "orders").select(
        "o_orderkey", D.date_trunc("month", d).alias("a"), D.date_add("month", 1, d).alias("b"), D.date_add("day", -90, d).alias("c"), D.date_add("quarter", 2, d).alias("d"), D.date_diff("day", zero, d).alias("e"), D.date_diff("month", zero, d).alias("f"), D.date_add("year", 2, d).alias("g")
    )


@query("fn_datetime_text", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS a, o_orderdate::DATE::TIMESTAMP AS b, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000' AS c, o_orderdate + INTERVAL 9 HOUR AS d FROM orders")
def fn_datetime_text(spark, sf):
    d = F.col("o_orderdate")
    return T(spark, sf, "orders").select("o_orderkey", D.date_format(d, "%d/%m/%Y").alias("a"), D.date_parse(D.date_format(d, "%d/%m/%Y"), "%d/%m/%Y").alias("b"), D.to_iso8601(d).alias("c"), D.at_timezone(d, "Asia/Tokyo").alias("d"))


@query(
    "fn_datetime_instants",
    """SELECT event_id, ts AS a, CASE WHEN day(ts) % 2 = 0 THEN ts - INTERVAL 4 HOUR ELSE ts - INTERVAL 5 HOUR END AS z, datesub('month', TIMESTAMP '2023-12-15 12:00:00', ts)::BIGINT AS m, datesub('week', TIMESTAMP '2023-12-15 12:00:00', ts)::BIGINT AS w, datesub('hour', ts, TIMESTAMP '2024-02-01 00:30:00')::BIGINT AS h
    FROM events""",
)
def fn_datetime_instants(spark, sf):
    t, zero = F.col("ts"), F.lit("2023-12-15 12:00:00").cast("timestamp_ntz")
    # in summer and in winter New York is four and five hours behind
    moved = F.when(F.dayofmonth(t) % 2 == 0, t + F.expr("interval '182' day")).otherwise(t)
    local = D.at_timezone(moved, "America/New_York")
    local = F.when(F.dayofmonth(t) % 2 == 0, local - F.expr("interval '182' day")).otherwise(local)
    return T(spark, sf, "events").select(
        "event_id", D.from_iso8601_timestamp(F.concat(D.format_datetime(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))).cast("timestamp_ntz").alias("a"), local.alias("z"), D.date_diff("month", zero, t).alias("m"), D.date_diff("week", zero, t).alias("w"), D.date_diff("hour", t, F.lit("2024-02-01 00:30:00").cast("timestamp_ntz")).alias("h"),
    )


@query("fn_datetime_now", "SELECT n_nationkey, true AS a, true AS b, TIMESTAMP '1970-01-01' + INTERVAL 1 DAY * n_nationkey AS c FROM nation")
def fn_datetime_now(spark, sf):
    return T(spark, sf, "nation").select("n_nationkey", (F.current_date() > F.lit("2020-01-01").cast("date")).alias("a"), (F.current_timestamp() == F.now()).alias("b"), D.from_unixtime(F.col("n_nationkey") * 86400).cast("timestamp_ntz").alias("c"))


_WHOLE = "list_transform(embedding, lambda x: CAST(round(x * 3) AS INTEGER))"


def _integers(a):
    return F.transform(a, lambda x: F.round(x * 3).cast("int"))


def _embeddings(spark, sf, a):
    return T(spark, sf, "embeddings").select("vec_id", a.alias("a"))


@query(
    "fn_array_basic",
    f"""SELECT vec_id, len(a)::INTEGER AS n, list_contains(a, 1) AS c, list_sort(list_distinct(a)) AS d, list_sort(list_intersect(a, [0, 1])) AS i, list_max(a) AS mx, list_min(a) AS mn, coalesce(list_position(a, 1), 0)::BIGINT AS p, list_filter(a, lambda x: x <> 1) AS r, list_sort(a) AS s, list_reverse_sort(a) AS t,
    array_to_string(a, '-') AS j, list_reverse(a) AS v, a[2:4] AS l, list_has_any(a, [2, 3]) AS o, list_concat(a, [9]) AS k, a[-1] AS e FROM (SELECT vec_id, {_WHOLE} AS a FROM embeddings)""",
)
def fn_array_basic(spark, sf):
    one, two = F.array(F.lit(0), F.lit(1)), F.array(F.lit(2), F.lit(3))
    return _embeddings(spark, sf, _integers("embedding")).select(
        "vec_id", F.cardinality("a").alias("n"), F.array_contains("a", 1).alias("c"), F.array_sort(F.array_distinct("a")).alias("d"), F.array_sort(F.array_intersect("a", one)).alias("i"), C.array_max("a").alias("mx"), C.array_min("a").alias("mn"), F.array_position("a", 1).alias("p"), F.array_remove("a", 1).alias("r"), F.array_sort("a").alias("s"),
        C.array_sort_desc("a").alias("t"), F.array_join("a", "-").alias("j"), F.reverse("a").alias("v"), F.slice("a", 2, 3).alias("l"), F.arrays_overlap("a", two).alias("o"), F.concat("a", F.array(F.lit(9))).alias("k"), C.element_at("a", -1).alias("e"),
    )


@query(
    "fn_array_shims",
    f"""SELECT vec_id, list_sort(list_filter(list_distinct(a), lambda x: len(list_filter(a, lambda y: y = x)) > 1)) AS d, len(a) <> len(list_distinct(a)) AS h, len(list_filter(a, lambda y: y = 0))::INTEGER AS f, list_sum(a)::BIGINT AS s, round(list_avg(a), 6) AS v, a[1:len(a) - 2] AS t, list_filter(a, lambda x: x > 0)[1] AS w,
    list_transform(range(1, len(a)), lambda i: [a[i], a[i + 1]]) AS g, (len(a) * (len(a) - 1) // 2)::INTEGER AS c, list_sum(list_transform(flatten(list_transform(range(2, len(a) + 1), lambda j: list_transform(range(1, j), lambda i: [a[i], a[j]]))), lambda p, k: k * (p[1] * 10 + p[2])))::BIGINT AS x
    FROM (SELECT vec_id, {_WHOLE} AS a FROM embeddings)""",
)
def fn_array_shims(spark, sf):
    pairs = C.combinations("a", 2)
    # all pairs in their order, as one number
    weighed = F.aggregate(F.transform(pairs, lambda p, k: (k + 1).cast("bigint") * (p[0] * 10 + p[1])), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return _embeddings(spark, sf, _integers("embedding")).select(
        "vec_id", C.array_duplicates("a").alias("d"), C.array_has_duplicates("a").alias("h"), F.coalesce(C.array_frequency("a")[0], F.lit(0)).alias("f"), C.array_sum("a", F.lit(0).cast("bigint")).alias("s"), _r(C.array_average("a")).alias("v"), C.trim_array("a", 2).alias("t"), C.find_first("a", lambda x: x > 0).alias("w"),
        C.ngrams("a", 2).alias("g"), F.size(pairs).alias("c"), weighed.alias("x"),
    )


@query(
    "fn_array_sets",
    f"""SELECT vec_id, list_sort(list_distinct(list_concat(a, [7, 8, 7]))) AS u, list_sort(list_filter(list_distinct(a), lambda x: x NOT IN (0, 1))) AS x, flatten([a, [1], a]) AS f, list_transform(list_zip(a, list_reverse(a)), lambda z: struct_pack(x := z[1], y := z[2])) AS z, list_sort(a) AS s FROM (SELECT vec_id, {_WHOLE} AS a FROM embeddings)""",
)
def fn_array_sets(spark, sf):
    e = _embeddings(spark, sf, _integers("embedding")).withColumn("b", F.reverse("a"))
    two = F.array(F.lit(0), F.lit(1))
    return e.select(
        "vec_id", F.array_sort(F.array_union("a", F.array(F.lit(7), F.lit(8), F.lit(7)))).alias("u"), F.array_sort(F.array_except("a", two)).alias("x"), F.flatten(F.array(F.col("a"), F.array(F.lit(1)), F.col("a"))).alias("f"),
        F.arrays_zip(F.col("a").alias("x"), F.col("b").alias("y")).alias("z"), F.array_sort(F.shuffle("a")).alias("s"),
    )


@query(
    "fn_array_lambda",
    f"""SELECT vec_id, list_transform(a, lambda x: x * 2) AS t, list_filter(a, lambda x: x > 0) AS f, list_sum(a)::INTEGER AS r, list_bool_and(list_transform(a, lambda x: x < 100)) AS al, list_bool_or(list_transform(a, lambda x: x > 1)) AS an, NOT list_bool_or(list_transform(a, lambda x: x > 1)) AS no,
    list_transform(list_zip(a, list_reverse(a)), lambda z: z[1] + z[2]) AS z, range(1, 6, 2) AS q, ['x', 'x'] AS p FROM (SELECT vec_id, {_WHOLE} AS a FROM embeddings)""",
)
def fn_array_lambda(spark, sf):
    return _embeddings(spark, sf, _integers("embedding")).select(
        "vec_id", F.transform("a", lambda x: x * 2).alias("t"), F.filter("a", lambda x: x > 0).alias("f"), F.reduce("a", F.lit(0), lambda s, x: s + x).alias("r"), F.forall("a", lambda x: x < 100).alias("al"), F.exists("a", lambda x: x > 1).alias("an"), C.none_match("a", lambda x: x > 1).alias("no"),
        F.zip_with("a", F.reverse("a"), lambda x, y: x + y).alias("z"), F.sequence(F.lit(1).cast("bigint"), F.lit(5).cast("bigint"), F.lit(2).cast("bigint")).alias("q"), F.array_repeat(F.lit("x"), 2).alias("p"),
    )


@query("fn_array_normalize", "SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 5)) AS n FROM embeddings")
def fn_array_normalize(spark, sf):
    return T(spark, sf, "embeddings").select("vec_id", F.transform(C.array_normalize("embedding"), lambda x: M.rounded(x, 5)).alias("n"))


@query(
    "fn_map_build",
    """SELECT n_nationkey, map([n_name, 'r'], [n_nationkey, n_regionkey]) AS m, [struct_pack(key := n_name, value := n_nationkey), struct_pack(key := 'r', value := n_regionkey)] AS e, CASE WHEN n_nationkey > 9 THEN [n_name] ELSE []::VARCHAR[] END AS f, ['x' || n_name, 'xr'] AS t,
    n_name = 'NATION_3' AS a, n_name <> 'NATION_3' AS n, CASE WHEN n_nationkey + n_regionkey > 0 THEN round(n_nationkey / sqrt(n_nationkey * n_nationkey + n_regionkey * n_regionkey), 6) END AS c FROM nation""",
)
def fn_map_build(spark, sf):
    k, r, name = F.col("n_nationkey"), F.col("n_regionkey"), F.col("n_name")
    m = F.map_from_arrays(F.array(name, F.lit("r")), F.array(k, r))
    d = F.transform_values(m, lambda _, v: v.cast("double"))
    cosine = M.map_cosine_similarity(d, F.create_map(name, F.lit(2.0)))
    return T(spark, sf, "nation").select(
        "n_nationkey", m.alias("m"), F.map_entries(m).alias("e"), F.map_keys(F.map_filter(m, lambda q, v: (v > 9) & (q != "r"))).alias("f"), F.map_keys(F.transform_keys(m, lambda q, v: F.concat(F.lit("x"), q))).alias("t"),
        C.any_keys_match(m, lambda q: q == "NATION_3").alias("a"), C.no_keys_match(m, lambda q: q == "NATION_3").alias("n"), F.when(k + r > 0, _r(cosine)).alias("c"),
    )


@query(
    "fn_map",
    """SELECT n_nationkey, n_nationkey AS a, NULL::INTEGER AS b, ['k', 'r'] AS ks, [n_nationkey, n_regionkey] AS vs, 2 AS n, n_nationkey + 1 AS t, ['k'] AS f, n_regionkey + 100 AS c, n_nationkey + n_regionkey AS z, CASE WHEN n_regionkey > n_nationkey THEN 'r' ELSE 'k' END AS top, true AS al FROM nation WHERE n_nationkey <> n_regionkey""",
)
def fn_map(spark, sf):
    n = T(spark, sf, "nation").where("n_nationkey <> n_regionkey")
    m = F.create_map(F.lit("k"), F.col("n_nationkey"), F.lit("r"), F.col("n_regionkey"))
    more = F.create_map(F.lit("r"), F.col("n_regionkey") + 100)
    both = F.map_zip_with(F.create_map(F.lit("k"), F.col("n_nationkey")), F.create_map(F.lit("k"), F.col("n_regionkey")), lambda k, x, y: x + y)
    return n.select(
        "n_nationkey", C.element_at(m, F.lit("k")).alias("a"), C.element_at(m, F.lit("q")).alias("b"), F.map_keys(m).alias("ks"), F.map_values(m).alias("vs"), F.cardinality(m).alias("n"), F.transform_values(m, lambda k, v: v + 1)["k"].alias("t"), F.map_keys(C.map_subset(m, F.array(F.lit("k")))).alias("f"),
        C.map_concat(m, more)["r"].alias("c"), both["k"].alias("z"), F.element_at(F.map_keys(C.map_top_n(m, 1)), 1).alias("top"), C.all_keys_match(m, lambda k: F.length(k) == 1).alias("al"),
    )


@query(
    "fn_json",
    """SELECT event_id, json_extract_string(props, '$.k') AS a, json_extract_string(props, '$.k')::BIGINT AS b, NULL::VARCHAR AS c, len(json_keys(props))::BIGINT AS n, json_type(props) NOT IN ('OBJECT', 'ARRAY') AS s, json_array_length(j)::INTEGER AS l, k IN (4, event_id % 7) AS h, json_extract_string(j, '$[1]') AS g,
    json_extract_string(j, '$[2]') AS z, json_extract_string(j, '$[2].q') AS x, '{"q":' || k || '}' AS o, '[4,' || event_id % 7 || ',{"q":' || k || '}]' AS p FROM (SELECT *, '[4, ' || event_id % 7 || ', {"q": ' || json_extract_string(props, '$.k') || '}]' AS j, json_extract_string(props, '$.k')::BIGINT AS k FROM events)""",
)
def fn_json(spark, sf):
    k = J.json_extract_scalar("props", "$.k")
    j = F.concat(F.lit("[4, "), (F.col("event_id") % 7).cast("string"), F.lit(', {"q": '), k, F.lit("}]"))
    two = F.concat(F.lit("[4, "), (F.col("event_id") % 7).cast("string"), F.lit("]"))
    return T(spark, sf, "events").withColumn("j", j).select(
        "event_id", k.alias("a"), F.from_json("props", "k bigint")["k"].alias("b"), J.json_extract_scalar("props", "$").alias("c"), J.json_size("props").alias("n"), J.is_json_scalar("props").alias("s"), F.json_array_length("j").alias("l"),
        J.json_array_contains(two, k.cast("bigint"), "bigint").alias("h"), J.json_array_get("j", 1).alias("g"), J.json_array_get("j", -1).alias("z"), J.json_extract_scalar("j", "$[2].q").alias("x"), J.json_extract("j", "$[2]").alias("o"), J.json_parse("j").alias("p"),
    )


@query("fn_json_format", "SELECT n_nationkey, '{\"k\":' || n_nationkey || ',\"r\":' || n_regionkey || '}' AS j FROM nation")
def fn_json_format(spark, sf):
    return T(spark, sf, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))).alias("j"))


@query(
    "fn_url",
    r"""SELECT page_id, regexp_extract(url, '^(\w+)://', 1) AS protocol, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, CASE WHEN url LIKE '%?%' THEN regexp_extract(url, '\?([^#]*)', 1) END AS query, CASE WHEN url LIKE '%#%' THEN regexp_extract(url, '#(.*)$', 1) END AS fragment,
    CASE WHEN url LIKE '%page=%' THEN regexp_extract(url, 'page=([^&#]*)', 1) END AS page FROM pages""",
)
def fn_url(spark, sf):
    return T(spark, sf, "pages").select("page_id", *[J.url_part("url", p).alias(p) for p in ("protocol", "host", "path", "query", "fragment")], J.url_parameter("url", "page").alias("page"))


@query("fn_url_port", r"SELECT page_id, CASE WHEN page_id % 3 > 0 THEN 8000 + page_id END AS p, page_id % 3 = 0 AS n FROM pages")
def fn_url_port(spark, sf):
    i = F.col("page_id")
    u = F.concat(F.lit("http://h.example"), F.when(i % 3 > 0, F.concat(F.lit(":"), (i + 8000).cast("string"))).otherwise(""), F.lit("/a?b=1:2#c:3"))
    return T(spark, sf, "pages").select("page_id", J.url_part(u, "port").alias("p"), J.url_part(u, "port").isNull().alias("n"))


@query("fn_url_code", "SELECT page_id, url AS back, replace(replace('a b/' || page_id, ' ', '+'), '/', '%2F') AS enc FROM pages")
def fn_url_code(spark, sf):
    return T(spark, sf, "pages").select("page_id", F.url_decode(F.url_encode("url")).alias("back"), F.url_encode(F.concat(F.lit("a b/"), F.col("page_id").cast("string"))).alias("enc"))


@query("fn_misc", "SELECT n_nationkey, coalesce(nullif(n_nationkey, 0), -1) AS a, CASE WHEN n_regionkey = 0 THEN NULL ELSE n_nationkey / n_regionkey END AS b, 'int' AS t FROM nation")
def fn_misc(spark, sf):
    return T(spark, sf, "nation").select("n_nationkey", F.coalesce(F.nullif("n_nationkey", F.lit(0)), F.lit(-1)).alias("a"), F.try_divide("n_nationkey", "n_regionkey").alias("b"), F.typeof("n_nationkey").alias("t"))


@query(
    "fn_math_special",
    """SELECT n_nationkey, round(1 - exp(-y) * (1 + y), 6) AS g, round(1 - exp(-x / 2), 6) AS c, round(3 * u * u - 2 * u * u * u, 6) AS b, round(x / (1 + x), 6) AS f, round(ln(gamma(x + 1)), 6) AS l, round(1 - pow(1 - u, 5), 6) AS h, 0.5::DOUBLE AS m,
    round(exp(-1.5) * (1 + 1.5 + 1.125)::DOUBLE, 6) AS p, round((pow(1 - 0.3::DOUBLE, 3) + 3 * 0.3::DOUBLE * pow(1 - 0.3::DOUBLE, 2)), 6) AS i FROM (SELECT n_nationkey, n_nationkey::DOUBLE AS x, n_nationkey / 3.0::DOUBLE AS y, n_nationkey / 24.0::DOUBLE AS u FROM nation)""",
)
def fn_math_special(spark, sf):
    x = F.col("n_nationkey").cast("double")
    two = F.lit(2)
    return T(spark, sf, "nation").select(
        "n_nationkey", _r(M.gamma_cdf(two, F.lit(3.0), x)).alias("g"), _r(M.chi_squared_cdf(two, x)).alias("c"), _r(M.beta_cdf(two, two, x / 24.0)).alias("b"), _r(M.f_cdf(two, two, x)).alias("f"), _r(M.log_gamma(x + 1)).alias("l"), _r(M.beta_cdf(F.lit(1), F.lit(5), x / 24.0)).alias("h"),
        _r(M.normal_cdf(x, F.lit(2.0), x)).alias("m"), _r(M.poisson_cdf(F.lit(1.5), F.lit(2))).alias("p"), _r(M.binomial_cdf(3, F.lit(0.3), F.lit(1))).alias("i"),
    )


@query("fn_math_quantile", "SELECT n_nationkey, round((n_nationkey + 0.5) / 25.0, 5)::DOUBLE AS back, CASE WHEN n_nationkey = 12 THEN 3.0 END::DOUBLE AS middle FROM nation")
def fn_math_quantile(spark, sf):
    k = F.col("n_nationkey")
    z = M.inverse_normal_cdf(F.lit(3.0), F.lit(2.0), (k + 0.5) / 25)
    return T(spark, sf, "nation").select("n_nationkey", _r(M.normal_cdf(F.lit(3.0), F.lit(2.0), z), 5).alias("back"), F.when(k == 12, _r(z)).alias("middle"))


@query(
    "fn_math_large",
    """SELECT n_nationkey, 0.5::DOUBLE AS g, round(1 - exp(-x) * (1 + x + x * x / 2), 6) AS p, round(1 - pow(1 - (x + 1) / 30, 3), 6) AS b, round((w + z * z / (2 * n) - z * sqrt(w * (1 - w) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS lo, round((w + z * z / (2 * n) + z * sqrt(w * (1 - w) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS hi,
    round(ln(x + 2) / ln(3), 6) AS l, true AS r, (-(n_nationkey // 4) - CASE WHEN n_nationkey % 4 > 0 THEN 1 ELSE 0 END)::BIGINT AS s FROM (SELECT *, n_nationkey::DOUBLE AS x, (n_nationkey / 25.0)::DOUBLE AS w, 25.0::DOUBLE AS n, 1.96::DOUBLE AS z FROM nation)""",
)
def fn_math_large(spark, sf):
    k = F.col("n_nationkey")
    x = k.cast("double")
    big = F.pow(F.lit(10.0), 4 + k % 3)  # shapes of 10,000 to a million
    near = F.abs(M.gamma_cdf(big, F.lit(1.0), big) - 0.5) < 0.01
    n, z = F.lit(25), F.lit(1.96)
    return T(spark, sf, "nation").select(
        "n_nationkey", F.when(near, F.lit(0.5)).alias("g"), _r(1 - M.poisson_cdf(x, F.lit(2)) + F.when(k == 0, 0.0).otherwise(0.0)).alias("p"), _r(1 - M.binomial_cdf(3, (x + 1) / 30, F.lit(0))).alias("b"), _r(M.wilson_interval_lower(k, n, z)).alias("lo"), _r(M.wilson_interval_upper(k, n, z)).alias("hi"),
        _r(M.log(F.lit(3.0), x + 2)).alias("l"), M.random_below(10, 1).between(0, 9).alias("r"), M.shift_right_arithmetic(-k, 2).alias("s"),
    )


@query(
    "fn_datetime_iso",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H') AS a, o_orderdate::DATE AS b, o_orderdate::DATE AS c, o_orderdate - INTERVAL 9 HOUR AS d, 9::BIGINT AS e, 5::BIGINT AS f, 30::BIGINT AS g FROM orders""",
)
def fn_datetime_iso(spark, sf):
    d = F.col("o_orderdate")
    return T(spark, sf, "orders").select(
        "o_orderkey", D.format_datetime(d, "YYYY/MM/dd HH").alias("a"), D.from_iso8601_date(F.date_format(d, "yyyy-MM-dd")).alias("b"), D.parse_datetime(D.format_datetime(d, "dd.MM.YYYY"), "dd.MM.YYYY").cast("date").alias("c"), D.with_timezone(d, "Asia/Tokyo").cast("timestamp_ntz").alias("d"),
        D.timezone_hour(d, "Asia/Tokyo").alias("e"), D.timezone_hour(d, "Asia/Kolkata").alias("f"), D.timezone_minute(d, "Asia/Kolkata").alias("g"),
    )


@query("fn_map_more", "SELECT n_nationkey, ['r', 'k'] AS t, [n_nationkey, n_regionkey] AS m, CASE WHEN n_nationkey + n_regionkey > 0 THEN round(n_nationkey / (n_nationkey + n_regionkey), 6) END AS w, n_nationkey > 3 OR n_regionkey > 3 AS v FROM nation WHERE n_nationkey > 0")
def fn_map_more(spark, sf):
    n = T(spark, sf, "nation").where("n_nationkey > 0")
    m = F.create_map(F.lit("k"), F.col("n_nationkey"), F.lit("r"), F.col("n_regionkey"))
    pair = lambda v: F.struct(F.lit("x").alias("key"), F.col(v).alias("value"))
    return n.select("n_nationkey", C.map_top_n_keys(m, 2).alias("t"), C.multimap_from_entries(F.array(pair("n_nationkey"), pair("n_regionkey")))["x"].alias("m"), _r(C.map_normalize(m)["k"]).alias("w"), C.any_values_match(m, lambda v: v > 3).alias("v"))


@query("user_scalar", "SELECT c_custkey, round(c_acctbal * 2 + c_nationkey, 4) AS x FROM customer")
def user_scalar(spark, sf):
    def weigh(a: pd.Series, b: pd.Series) -> pd.Series:
        return a * 2 + b

    U.scalar(spark, "weigh", weigh, "double")
    T(spark, sf, "customer").createOrReplaceTempView("customer")
    return spark.sql("SELECT c_custkey, round(weigh(c_acctbal, c_nationkey), 4) AS x FROM customer")


class _Span:
    """Greatest less least."""

    def zero(self):
        return None

    def step(self, state, value):
        return (value, value) if state is None else (min(state[0], value), max(state[1], value))

    def merge(self, a, b):
        return b if a is None else a if b is None else (min(a[0], b[0]), max(a[1], b[1]))

    def finish(self, state):
        return None if state is None else float(state[1] - state[0])


@query("user_aggregate", "SELECT nullif(c_nationkey, 3) AS k, round(max(c_acctbal) - min(c_acctbal), 4) AS s FROM customer GROUP BY 1")
def user_aggregate(spark, sf):
    c = T(spark, sf, "customer").select(F.nullif("c_nationkey", F.lit(3)).alias("k"), "c_acctbal")
    return U.aggregate(c, ["k"], "c_acctbal", _Span(), "double", "s").select("k", _r("s", 4).alias("s"))


class _Digits:
    def eval(self, key: int, n: int):
        while n:
            yield key, n % 10
            n //= 10


@query("user_table", "SELECT c_custkey, (c_custkey // (10 ** i)::BIGINT) % 10 AS digit FROM customer, range(0, 9) AS t(i) WHERE c_custkey >= (10 ** i)::BIGINT")
def user_table(spark, sf):
    U.table(spark, "digits", _Digits, "c_custkey bigint, digit bigint")
    T(spark, sf, "customer").select("c_custkey").createOrReplaceTempView("keys")
    return spark.sql("SELECT d.c_custkey, d.digit FROM keys, LATERAL digits(keys.c_custkey, keys.c_custkey) AS d")
