"""The thin queries op1 to op10: each applies its operator to its whole table and returns the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import shared, tokenids
from .decontaminate import contaminated
from .langid import language_report
from .linededup import line_report
from .media import media_report
from .minhash import near_duplicates
from .mixing import mix_report
from .quality import quality_report
from .toxicity import toxicity_report
from .urlfilter import PATTERNS, SITES, judge_urls, site_rule


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _add(f):
    QUERIES[f.__name__] = f
    return f


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES["op8_url_filters"] = f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h AS (SELECT *, '.' || host AS dotted FROM u),
r AS (SELECT *, CASE WHEN ends_with(dotted, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/' WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN ends_with(dotted, '.net') AND starts_with(path, '/es/') THEN 'net/es/' WHEN ends_with(dotted, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/' WHEN ends_with(dotted, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
  CASE WHEN regexp_matches(host, '(^|[.-])(adult|xxx)([.-]|$)') THEN 'adult hosts' WHEN regexp_matches(host, '(^|[.-])spam([.-]|$)') THEN 'spam hosts' WHEN regexp_matches(host, '(^|[.-])pills([.-]|$)') THEN 'pill shops'
  WHEN regexp_matches(host, '(^|[.-])casino([.-]|$)') THEN 'casinos' END AS p FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR p IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, CASE WHEN rule IS NULL THEN p END AS pattern FROM r
"""

#: Exact, by all common shingles and transitive closure: for small tables.
ORACLES["op10_minhash_near_dedup"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM t x JOIN t y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
m AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(b, doc_id)) AS kept FROM n LEFT JOIN m ON a = doc_id
"""


@_add
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(_table(spark, sf_dir, "documents"))


@_add
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(_table(spark, sf_dir, "documents"))


@_add
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    """The byte-level vocabulary that op4 and the pipeline use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_add
def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "token-blocks")
    tokenids.write_ids(_table(spark, sf_dir, "documents"), path, tokenizer_path(), end=0)
    return tokenids.read_ids(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@_add
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_add
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents"))


@_add
def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_report(_table(spark, sf_dir, "documents"))


@_add
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), tuple(site_rule(v, r) for v, r in SITES) + PATTERNS)


@_add
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_add
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80)
