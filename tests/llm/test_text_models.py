import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import zstandard

from quarry.llm import ftrl, toxicity, wordhash
from quarry.llm import langid as L
from quarry.llm import quality as Q
from quarry.llm.langid import identify, language_report, train
from quarry.llm.quality import assess, quality_report
from quarry.llm.quality import train as train_quality
from quarry.llm.toxicity import rate, toxicity_report
from quarry.llm.toxicity import train as train_toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def auc(score, label):
    r, y = pd.Series(score).rank().to_numpy(), np.asarray(label)
    n = y.sum()
    return (r[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_language_held_out(tables):
    docs, _ = tables
    got = language_report(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_odd_rows(odd, none, tables):
    model = train(tables[0])
    got = identify(odd, model)
    assert got.columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score"]
    for r in got.collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert r.lang_pred == "und" and r.score == 0
        else:
            assert r.lang_pred in model.labels
    assert identify(none, model).count() == 0
    assert train(none) is None
    assert {r.lang_pred for r in identify(odd, None).collect()} == {"und"}


def test_language_is_of_the_text_alone(tables):
    """A text scored alone, or within a batch, gets the same probabilities."""
    model = train(tables[0])
    texts = [r.text for r in tables[0].limit(20).collect()]
    assert np.allclose(model.scores(texts), np.vstack([model.scores([t]) for t in texts]), atol=1e-6)


def test_quality_held_out(tables):
    docs, labels = tables
    got = quality_report(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert auc(held.score, held.quality) > 0.9
    assert ((got.score >= 0.3).astype(int) == got.predicted).all() and got.score.between(0, 1).all()


def test_quality_odd_rows(odd, none, tables, spark):
    docs, labels = tables
    model = train_quality(docs, labels)
    got = assess(odd, model).toPandas()
    assert len(got) == odd.count() and got.quality_score.between(0, 1).all()
    assert got[got.text == ""].quality_score.notna().all()
    assert assess(none, model).count() == 0
    empty = train_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert assess(odd, empty).count() == odd.count()


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity_report(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id", suffixes=("", "_label"))
    held = got[got.held_out]
    assert auc(held.severity, held.toxic_label) > 0.95
    assert (held.toxic == held.toxic_label).mean() > 0.95
    assert got.severity.between(0, 2).all()


def test_toxicity_odd_rows(odd, none, tables, spark):
    docs, labels = tables
    model = train_toxicity(docs, labels)
    got = rate(odd, model).toPandas()
    assert len(got) == odd.count() and got.severity.between(0, 2).all()
    assert rate(none, model).count() == 0
    empty = train_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert rate(odd, empty).count() == odd.count()


def test_ftrl_learns_and_leaves_weights_at_zero():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 600)
    rows = [(np.array([int(v), int(rng.integers(2, 300))]), np.ones(2)) for v in y]
    w = ftrl.multinomial(rows, y, 300, 2, l1=1.0)
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]
    assert (w[2:300] == 0).mean() > 0.8


def test_ordinal_thresholds_ascend():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 900)
    rows = [(np.array([0]), np.array([v + rng.normal(0, 0.3)])) for v in y]
    w, theta = ftrl.ordinal(rows, y, 1, 3, alpha=0.5, l1=0.0)
    assert w[0] > 1 and theta[0] < theta[1]


def test_words_are_those_of_split(odd_rows):
    texts = [r[1] for r in odd_rows] + ["A\x0bB\x0cC\rD", "\x00a \x85b", "x"]
    raw, off = wordhash.utf8(pa.array(texts, pa.string()))
    seen: dict[int, bytes] = {}
    for i, j in wordhash.chunks(off, 500):
        h, start, end, first = wordhash.words(raw, off, i, j)
        for d in range(i, j):
            want = (texts[d] or "").encode().lower().split()
            a, z = first[d - i], first[d - i + 1]
            assert [raw[s:e].tobytes().lower() for s, e in zip(start[a:z], end[a:z], strict=True)] == want
            for x, w in zip(h[a:z].tolist(), want, strict=True):
                assert seen.setdefault(x, w) == w
    assert len(set(seen.values())) == len(seen)


def test_temperature():
    assert math.isclose(ftrl.best_temperature(lambda t: (math.log(t) - 1) ** 2), math.e, rel_tol=1e-3)


# Brute force: the same scores by plain Python.

ODD_TEXTS = [None, "", " \n\t ", "½ ² ① Ⅷ 12 !!", "a", "ab", "Straße und Äpfel, 12!", "漢字 🙂", "the quick brown fox. " * 30, "Ça va? Très bien, merci.", "x" * 5000]


def gram_hash(grams):
    """The feature of up to three code points, with whole numbers."""
    h = 0
    for n, c in enumerate(grams):
        h = ((h ^ (c + n + 1)) * int(L._MUL[n])) & 0xFFFFFFFF
        h ^= h >> 15
    return (h * 0x9E3779B1 & 0xFFFFFFFF) >> 16


def grams_of(text):
    p = [ord(c) for c in text.lower()]
    return Counter(gram_hash(p[i : i + n]) for n in (1, 2, 3) for i in range(len(p) - n + 1))


def test_language_scores_by_hand(spark, tables):
    model = train(tables[0])
    got = identify(spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS)], "doc_id long, text string"), model).collect()
    for r in got:
        text = r.text or ""
        if not any(unicodedata.category(c)[0] == "L" for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        n = grams_of(text)
        logit = [sum(k * float(model.weights[g, c]) for g, k in n.items()) / sum(n.values()) + model.bias[c] for c in range(len(model.labels))]
        e = [math.exp((v - max(logit)) / model.temperature) for v in logit]
        assert r.lang_pred == model.labels[max(range(len(e)), key=lambda c: (e[c], -c))]
        assert abs(r.score - max(e) / sum(e)) < 1e-4


def test_language_of_every_label_is_learned(spark):
    """Three hundred languages, each with letters of its own, the rarest with one text."""
    rows = []
    for k in range(300):
        own = chr(0x4E00 + 40 * k) + chr(0x4E01 + 40 * k)
        rows += [(10 * k + j, (own + " ") * (20 + j), f"l{k:03d}") for j in range(1 if k % 7 == 0 else 4)]
    rows += [(5000, None, "zz"), (5001, "abc", None), (None, "abc", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs, per_label=5)
    assert model.labels == [f"l{k:03d}" for k in range(300)]
    got = identify(docs.where("doc_id < 5000"), model).collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.99 * len(got)


def test_sample_is_bounded_and_repeatable(spark):
    from quarry.llm.sampling import least_hashes, texts_of

    rows = [(i, f"t{i}", "a") for i in range(500)] + [(7, f"other {i}", "b") for i in range(400)] + [(900, "x", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    pick = lambda d: sorted((r.label, r.text) for r in texts_of(d, least_hashes(d, 20), 20, ("doc_id", "label")).collect())
    got = pick(docs.repartition(7))
    assert got == pick(docs.repartition(2))
    assert Counter(x for x, _ in got) == {"a": 20, "b": 20, "c": 1}


def softmax(s):
    e = [math.exp(v - max(s)) for v in s]
    return [v / sum(e) for v in e]


def test_ftrl_by_loops():
    """The proximal leader a coordinate at a time, with dictionaries."""
    rng = np.random.default_rng(8)
    size, classes, a, b, l1, l2 = 12, 3, 0.3, 1.0, 0.02, 0.1
    rows = [(np.sort(rng.choice(size, 4, replace=False)), rng.random(4)) for _ in range(40)]
    y = rng.integers(0, classes, 40)
    z, n = defaultdict(float), defaultdict(float)

    def weight(f, c):
        v = z[f, c]
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((b + math.sqrt(n[f, c])) / a + l2)

    order = np.random.default_rng(5)
    for _ in range(4):
        for i in order.permutation(len(rows)):
            x = {**dict(zip(rows[i][0].tolist(), rows[i][1].tolist(), strict=True)), size: 1.0}
            p = softmax([sum(v * weight(f, c) for f, v in x.items()) for c in range(classes)])
            w = {(f, c): weight(f, c) for f in x for c in range(classes)}
            for f, v in x.items():
                for c in range(classes):
                    g = v * (p[c] - (c == y[i]))
                    z[f, c] += g - (math.sqrt(n[f, c] + g * g) - math.sqrt(n[f, c])) / a * w[f, c]
                    n[f, c] += g * g
    got = ftrl.multinomial(rows, y, size, classes, alpha=a, beta=b, l1=l1, l2=l2)
    assert np.allclose(got, [[weight(f, c) for c in range(classes)] for f in range(size + 1)], atol=1e-9)


def test_quality_scores_by_hand(spark, tables):
    """The calibrated difference of the two compressed sizes, and nothing else."""
    model = train_quality(*tables)
    bare = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
    good, bad = (zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), **bare) for d in (model.good, model.bad))
    texts = [*ODD_TEXTS, *[r.text for r in tables[0].orderBy("doc_id").limit(40).collect()]]
    for r in assess(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect():
        t = (r.text or "").encode()
        g, b = len(good.compress(t)), len(bad.compress(t))
        logit = np.interp((b - g) / max(g, b), Q._DIFF, model.weights)
        assert abs(r.quality_score - 1 / (1 + math.exp(-logit))) < 1e-9
    sizes = model.sizes([(t or "").encode() for t in texts])
    order = np.argsort(Q.difference(sizes))
    assert np.corrcoef(np.arange(len(order)), model.scores([(texts[i] or "").encode() for i in order]))[0, 1] > 0.3


def test_quality_of_little_text_uses_all_of_it(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 3) for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    model = train_quality(docs, labels)
    assert sum(f"word{i} ".encode() in model.good + model.bad for i in range(8)) >= 3
    assert all(len(d) < 200 for d in (model.good, model.bad))


def test_toxicity_scores_by_hand(spark, tables):
    """The cumulative link by its formula over word counts."""
    docs, labels = tables
    model = train_toxicity(docs, labels)
    weight = dict(zip(model.at.tolist(), model.weights.tolist(), strict=True))
    texts = [*ODD_TEXTS, *[r.text for r in docs.orderBy("doc_id").limit(60).collect()]]

    def feature(word):
        raw, off = wordhash.utf8(pa.array([word], pa.string()))
        return int(toxicity.features(wordhash.words(raw, off, 0, 1, signs=True)[0])[0])

    sigmoid = lambda v: 1 / (1 + math.exp(-max(-40, min(40, v))))
    for r in rate(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect():
        n = Counter(map(feature, re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))))
        score = sum(weight.get(f, 0.0) * math.log1p(k) for f, k in n.items())
        at_most = [sigmoid(t - score) for t in model.thresholds] + [1.0]
        grades = [at_most[0], at_most[1] - at_most[0], at_most[2] - at_most[1]]
        assert abs(r.severity - sum(k * p for k, p in enumerate(grades))) < 1e-9
        assert abs(r.toxic_probability - (1 - at_most[0])) < 1e-9
    assert model.thresholds[0] < model.thresholds[1]


def test_ordinal_tells_grades_that_a_two_grade_model_does_not():
    """With grades of their own, thresholds over shared weights order held-out rows better than toxic or not does."""
    rng = np.random.default_rng(3)
    grade = rng.integers(0, 3, 1500)
    rows = [(np.unique(np.concatenate([rng.integers(0, 5 + 5 * g, 2 + 2 * g), rng.integers(20, 200, 5)])), None) for g in grade]
    rows = [(at, np.ones(len(at))) for at, _ in rows]
    w3, t3 = ftrl.ordinal(rows[:1000], grade[:1000], 200, 3, alpha=0.5, l1=0.1)
    w2, t2 = ftrl.ordinal(rows[:1000], (grade[:1000] > 0).astype(int), 200, 2, alpha=0.5, l1=0.1)
    expect = lambda w, t, at: sum(1 - 1 / (1 + math.exp(-(k - w[at].sum()))) for k in t)
    test = grade[1000:]
    wrong = lambda w, t, scale: np.mean([abs(scale * expect(w, t, at) - g) for (at, _), g in zip(rows[1000:], test, strict=True)])
    assert wrong(w3, t3, 1) < wrong(w2, t2, 1.5)
