"""URL filtering by pattern rules indexed under their rarest literal token; DataFrame operations only.

A rule is tried only on URLs that contain its index token: the one of its literal tokens that the fewest distinct
URLs contain.  URL tokens fetch candidate rules by an equi-join, and only these run their regular expressions.  Rules
without a literal token are tried on every URL.  Distinct URLs are judged once and joined back to the rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A rule: ``host`` and ``path`` patterns are regular expressions for the whole host and the path's beginning;
    ``literals`` are tokens that every fitting URL contains between characters other than letters and digits.  Site
    rules outrank pattern rules; among rules of a kind the one of larger ``rank`` wins, then the lesser name."""

    name: str
    verdict: str
    host: str
    path: str
    literals: tuple[str, ...]
    rank: int
    site: bool


def site_rule(verdict: str, text: str) -> Rule:
    """A rule like ``example.com/en/``: the host with all its subdomains, and how the path begins."""
    host, slash, path = text.partition("/")
    tail = slash + path
    ends = "" if not tail or not tail[-1].isalnum() else re.split(r"[^A-Za-z0-9]+", tail)[-1]
    whole = tail[: len(tail) - len(ends)]  # the path's last piece may go on in a URL
    tokens = [t.lower() for t in re.split(r"[^A-Za-z0-9]+", f"{host}{whole}") if t]
    return Rule(text, verdict, rf"(?s)^(.*\.)?{re.escape(host)}\z", rf"(?s)^{re.escape(tail)}", tuple(tokens), len(text), True)


def pattern_rule(name: str, verdict: str, host: str = "", path: str = "", literals: tuple[str, ...] = ()) -> Rule:
    return Rule(name, verdict, host, path, literals, len(name), False)


#: The sites of the query's contract (fixed values).
SITES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: What decides where no site rule fits.
PATTERNS = (
    pattern_rule("spam hosts", "block", r"(^|[.-])spam([.-]|\z)", "", ("spam",)),
    pattern_rule("pill shops", "block", r"(^|[.-])pills([.-]|\z)", "", ("pills",)),
    pattern_rule("casinos", "block", r"(^|[.-])casino([.-]|\z)", "", ("casino",)),
    pattern_rule("adult hosts", "block", r"(^|[.-])(adult|xxx)([.-]|\z)", ""),
)


def split_url(url: str = "url") -> tuple[Column, Column]:
    """(host, path): host is what follows the first ``://`` up to ``/ ? #``, A-Z lower-cased; path what follows it up
    to ``? #``.  Both are empty for a null and where there is no ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = rest.substr(F.length(host) + 1, F.length(rest))
    return F.translate(host, UPPER, LOWER), F.regexp_extract(tail, r"^[^?#]*", 0)


def _rules(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    schema = "id int, name string, verdict string, host_re string, path_re string, literals array<string>, rank int, site boolean"
    rows = ", ".join(
        "(" + ", ".join([f"{i}", _q(r.name), _q(r.verdict), _q(r.host), _q(r.path), f"array({', '.join(map(_q, r.literals))})", f"{r.rank}", str(r.site).lower()]) + ")" for i, r in enumerate(rules)
    )
    names = ", ".join(x.split()[0] for x in schema.split(", "))
    return spark.sql(f"SELECT id, name, verdict, host_re, path_re, CAST(literals AS array<string>) AS literals, rank, site FROM VALUES {rows} AS t({names})")


def _q(s: str) -> str:
    return "r'" + s + "'" if "'" not in s else '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...], otherwise: str = "allow") -> DataFrame:
    """Adds host, path, rule, verdict, pattern to ``pages`` (page_id, url; other columns are left out).

    ``rule`` is the site rule that decided (null if none fits), ``pattern`` the pattern rule that did.  A null URL has
    an empty host and path, and ``otherwise`` for its verdict unless a rule fits empty strings.  Repeated rows get
    equal answers; an empty table gives none.
    """
    host, path = split_url()
    urls = pages.select(F.coalesce("url", F.lit("")).alias("url")).distinct().select("url", host.alias("host"), path.alias("path"))
    table = _rules(pages.sparkSession, rules)
    tokens = F.array_distinct(F.filter(F.split(F.translate(F.concat("host", F.lit(" "), "path"), UPPER, LOWER), "[^a-z0-9]+"), lambda t: t != ""))
    held = urls.select("url", "host", "path", F.explode(tokens).alias("token"))
    literal = table.select("id", F.explode("literals").alias("token")).distinct()
    seen = held.select("token").join(literal.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    # a literal that no URL has makes its rule unreachable; it counts as the rarest
    rarest = literal.join(seen, "token", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("t")).select("id", F.col("t.token").alias("token"))
    index = table.join(rarest, "id")
    fetched = held.join(index, "token")
    always = table.where("size(literals) = 0")
    tried = fetched.select("url", "host", "path", *always.columns)
    if any(not r.literals for r in rules):
        # a fixed list of rules for every URL, each a row: the list is part of the plan and does not grow with the data
        listed = [r for r in enumerate(rules) if not r[1].literals]
        each = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.host).alias("host_re"), F.lit(r.path).alias("path_re"), F.array().cast("array<string>").alias("literals"), F.lit(r.rank).alias("rank"), F.lit(r.site).alias("site")) for i, r in listed])
        tried = tried.unionAll(urls.select("url", "host", "path", F.inline(each)))
    fits = tried.where(F.expr("rlike(host, host_re) AND rlike(path, path_re)"))
    best = fits.groupBy("url").agg(F.max(F.struct(F.col("site").alias("site"), F.col("rank").alias("rank"), (-F.col("id")).alias("first"), F.col("name").alias("name"), F.col("verdict").alias("verdict"))).alias("b"))
    out = pages.select("page_id", F.col("url").alias("_url"), F.coalesce("url", F.lit("")).alias("_key"), host.alias("host"), path.alias("path")).join(best, F.col("_key") == best.url, "left")
    return out.select("page_id", "host", "path", F.when(F.col("b.site"), F.col("b.name")).alias("rule"), F.coalesce("b.verdict", F.lit(otherwise)).alias("verdict"), F.when(~F.col("b.site"), F.col("b.name")).alias("pattern"))
