from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quarry.llm import queries, shared
from quarry.llm.langid import identify, train
from quarry.llm.sampling import fold
from quarry.llm.tokenids import Encoder

from .test_minhash import brute
from .test_mixing import waterfill

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        docs = shared.written(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return [d.collect() for d in out]


def test_language(spark, stages):
    docs = spark.createDataFrame(stages[0])
    kept = identify(docs, train(docs.where(fold(4) != 2))).where(f"lang_pred <> 'und' AND score >= {cp.LEAST_SCORE}")
    assert sorted(r.doc_id for r in stages[1]) == sorted(r.doc_id for r in kept.collect())


def test_near_dedup(stages):
    ids = [r.doc_id for r in stages[1]]
    want = {d for d, (_, c) in zip(ids, brute(ids, [r.text for r in stages[1]], 5), strict=True) if c == d}
    assert {r.doc_id for r in stages[2]} == want and len(stages[2]) == len(want)


def test_decontamination(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r.doc_id for r in stages[2] if not any(t in r.text for t in items)}
    assert {r.doc_id for r in stages[3]} == want


def test_mixture_and_columns(stages):
    names = set(stages[0][0].asDict())
    assert all(set(r.asDict()) == names for rows in stages[1:5] for r in rows)
    assert {r.doc_id for r in stages[4]} <= {r.doc_id for r in stages[3]}


def test_mixture_meets_its_targets(stages):
    """Each source comes near its water-filled target, no document comes more than three times, and rows are whole."""
    size, total = {}, Counter()
    for r in stages[3]:
        size[r.doc_id] = (r.source, len((r.text or "").encode().split()))
        total[r.source] += size[r.doc_id][1]
    times, taken = Counter(r.doc_id for r in stages[4]), Counter()
    for d, n in times.items():
        taken[size[d][0]] += n * size[d][1]
    want = waterfill(total)
    assert max(times.values()) <= 3
    assert all(abs(taken[s] - want[s]) <= max(n for t, n in size.values() if t == s) for s in want)
    rows = {r.doc_id: r for r in stages[3]}
    assert all(rows[r.doc_id] == r for r in stages[4])


def test_token_ids(stages):
    enc = Encoder(queries.tokenizer_path())
    at = 0
    for r, d in zip(sorted(stages[5], key=lambda r: r.start), sorted(stages[4], key=lambda r: r.doc_id), strict=True):
        n = len(enc.lib.encode(d.text, add_special_tokens=False).ids) + 1
        assert (r.doc_id, r.start, r.n_tokens) == (d.doc_id, at, n)
        at += n


def test_run_gives_the_last_stage(spark, stages):
    got = cp.run(spark, SF).collect()
    assert sorted((r.start, r.doc_id) for r in got) == sorted((r.start, r.doc_id) for r in stages[5])
    assert np.all(np.diff(sorted(r.start for r in got)) > 0)


def test_odd_rows_go_through(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0


def test_repeated_rows_leave_one(spark, odd):
    rows = cp.near_dedup(spark, odd, SF).collect()
    assert [r.doc_id for r in rows if r.doc_id is not None and r.doc_id == 50] == []
    assert sum(r.doc_id == 3 for r in rows) == 1


def test_no_rows_and_no_languages(spark, none, odd):
    docs = none
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
    unknown = odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "source")
    assert cp.language(spark, unknown, SF).count() == odd.count()


def test_rows_that_repeat_an_id_with_other_text(spark):
    """Each is judged by its own text: no text is lost for what another of its id says."""
    a, b, u = (" ".join(f"{x}{i}" for i in range(60)) for x in "abu")
    left = lambda rows: sorted((r.doc_id or 0, r.text) for r in cp.near_dedup(spark, spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string"), "").collect())
    assert left([(3, a), (5, u), (5, a)]) == [(3, a), (5, u)]
    assert left([(4, b + " x"), (5, b), (5, a)]) == [(4, b + " x"), (5, a)]
    got = left([(5, a), (5, a + " x"), (5, u), (7, a), (8, u + " k"), (None, a), (9, ""), (9, "")])
    assert got[0] == (0, a) and got[-1] == (9, "") and len(got) == 4
    assert (5, u) in got and sum(t.startswith(a) for d, t in got if d == 5) == 1
