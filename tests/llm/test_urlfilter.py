import random
import re

from quarry.llm.urlfilter import PATTERNS, SITES, judge_urls, pattern_rule, site_rule

RULES = tuple(site_rule(v, r) for v, r in SITES) + PATTERNS


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def judge(url, rules):
    """By trying every rule."""
    host, path = split(url)
    fits = [(r.site, r.rank, -i, r) for i, r in enumerate(rules) if re.search(r.host.replace(r"\z", r"\Z"), host) and re.search(r.path, path)]
    if not fits:
        return host, path, None, "allow"
    best = max(fits, key=lambda f: f[:3])[3]
    return host, path, best.name if best.site else None, best.verdict


def urls():
    rng = random.Random(4)
    hosts = ["example.com", "www.example.com", "a.www.example.com", "EXAMPLE.com", "xexample.com", "foo.net", "net", "com", "spam.org", "my-spam-farm.org", "casino.net", "casinos.net", "xxx.org", "www.pills.org", "é.com", ""]
    paths = ["", "/", "/en/", "/en", "/en/x", "/EN/x", "/es/", "/es/a", "/fr/q", "/english/", "/é/"]
    tails = ["", "?a=1/en/", "#t", "?x#y"]
    out = [f"{rng.choice(['http', 'https', 'HTTP'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(tails)}" for _ in range(600)]
    return [*out, None, "", "no scheme/en/", "://", "a://b://c/en/", "http://x.net/es/\nq", "http://h.com\n/en/", "x" * 5000 + "://example.com/en/"]


def test_against_all_rules(spark):
    rows = list(enumerate(urls()))
    df = spark.createDataFrame([(i, u, 1, 2, 3) for i, u in rows], "page_id long, url string, host int, token int, verdict int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, RULES).collect()}
    assert got == {i: judge(u, RULES) for i, u in rows}


def test_rules_of_all_shapes(spark):
    rules = (site_rule("block", "net/es"), site_rule("allow", "b.net/es"), site_rule("block", "org"), pattern_rule("numbers", "block", "", r"/\d{3}$"), pattern_rule("deep", "allow", "", "/a/b/", ("a", "b")))
    rows = list(enumerate(["http://a.net/estate", "http://b.net/es", "http://c.org", "http://c.com/123", "http://c.com/a/b/c", "http://c.com/a-b/", None]))
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, rules).collect()}
    assert got == {i: judge(u, rules) for i, u in rows}


def test_repeated_rows_null_ids_and_none(spark):
    df = spark.createDataFrame([(1, "http://example.com/en/"), (1, "http://example.com/en/"), (None, "http://example.com/en/"), (None, None)], "page_id long, url string")
    assert sorted(str(r.verdict) for r in judge_urls(df, RULES).collect()) == ["allow", "block", "block", "block"]
    assert judge_urls(df.where("false"), RULES).count() == 0
