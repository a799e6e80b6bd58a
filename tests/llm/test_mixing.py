from collections import defaultdict

from quarry.llm.mixing import MOST, _targets, mix, mix_report, units


def waterfill(size):
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, free, rest = {}, set(names), sum(size.values())
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / total > MOST * size[s]]
        if not over:
            return out | {s: rest * w[s] / total for s in free}
        for s in over:
            out[s] = MOST * size[s]
            free.discard(s)
            rest -= out[s]
    return out


def test_report(odd, odd_rows):
    got = mix_report(odd).collect()
    assert len(got) == len(odd_rows)
    size, rows = defaultdict(int), defaultdict(list)
    for d, t, _, s in odd_rows:
        n = len((t or "").encode().split())
        size[s] += n
        rows[d, n].append(s)
    want = waterfill(size)
    taken, goal, largest = defaultdict(int), {}, defaultdict(int)
    for r in got:
        s = rows[r.doc_id, r.size].pop()
        assert r.source_size in size.values()
        assert 0 <= r.taken <= MOST * r.size and r.taken == r.copies * r.size
        assert (r.shard is not None) == (r.copies > 0)
    by_source = {v: k for k, v in size.items()}
    for r in got:
        s = by_source[r.source_size]
        taken[s] += r.taken
        goal[s] = r.target
        largest[s] = max(largest[s], r.size)
    for s, g in goal.items():
        assert abs(g - want[s]) < 1e-6
        assert abs(taken[s] - g) <= largest[s]


def test_same_again(odd):
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(key, mix_report(odd).collect())) == sorted(map(key, mix_report(odd.repartition(5)).collect()))


def test_mix_repeats_rows(odd):
    copies = mix_report(odd).agg({"copies": "sum"}).first()[0]
    out = mix(odd)
    assert out.columns == odd.columns and out.count() == copies


def test_empty(none):
    assert mix_report(none).count() == 0 and mix(none).count() == 0


def test_targets_of_sources_that_tie(spark):
    for size in ({"a": 100, "b": 200, "c": 1000}, {s: 500 for s in "abcdef"}, {"a": 5, "b": 10, "c": 15, None: 900}):
        rows = spark.createDataFrame(list(size.items()), "source string, _size long")
        got = {r.source: r.target for r in _targets(rows).collect()}
        want = waterfill(size)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)
        assert abs(sum(got.values()) - sum(size.values())) < 1e-6


def test_rows_that_repeat_are_taken_in_part(spark):
    """A source of one row's repeats takes as many of them as its target asks for, in the report and in the mix."""
    rows = [(i, "ten words " * 5, "a", i) for i in range(200)] + [(7, "ten words " * 5, "b", 0)] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _size int").repartition(5)
    got = mix_report(docs).collect()
    taken, goal = defaultdict(int), {}
    assert len(got) == 400 and all(r.taken <= MOST * r.size for r in got)
    twice = [r for r in got if r.doc_id == 7]
    assert sum(r.target == got[0].target for r in got) in (200, 400)
    for r in got:
        taken[r.target] += r.taken
        goal[r.target] = r.target
    for g in goal:
        assert abs(taken[g] - g) <= 10
    assert len(twice) == 201
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    by = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    want = waterfill({"a": 2000, "b": 2000})
    assert all(abs(10 * by[s] - want[s]) <= 10 for s in want)


def test_units_are_dealt_in_exact_quotas(spark):
    """Every node deals half of its slots to either side, and no unit is lost or dealt twice."""
    rows = [([f"s{i}"], i % 4, 100 * i) for i in range(12)]
    sources = spark.createDataFrame(rows, "_src array<string>, passes long, b1 int")
    got = units(sources, 8, 3).collect()
    want = {(f"s{i}", u) for i in range(12) for u in range(256 * (i % 4) + 100 * i // 16 + 1)}
    assert {(r._src[0], 256 * r["pass"] + r.block) for r in got} == want and len(got) == len(want)
    n = [0] * 8
    for r in got:
        n[r.shard] += 1
    assert max(n) - min(n) <= 3
    again = units(sources.repartition(3), 8, 3).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mix_against_targets(spark):
    """The mix of a whole table: every source comes near its water-filled target, no row more than three times."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = {(r.doc_id): (r.source, len((r.text or "").encode().split())) for r in docs.select("doc_id", "source", "text").collect()}
    total, largest = defaultdict(int), defaultdict(int)
    for s, n in size.values():
        total[s] += n
        largest[s] = max(largest[s], n)
    taken, times = defaultdict(int), defaultdict(int)
    for r in mix(docs, shards=8).select("doc_id").collect():
        times[r.doc_id] += 1
        taken[size[r.doc_id][0]] += size[r.doc_id][1]
    assert max(times.values()) <= MOST
    want = waterfill(total)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    assert times == {r.doc_id: r.copies for r in mix_report(docs).where("copies > 0").collect()}
