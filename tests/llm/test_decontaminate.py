import math
import random
import re
from collections import Counter

import numpy as np

from quarry.llm.decontaminate import ANSWER, B, K1, LEAST_WINDOW, QUESTION, THRESHOLD, Index, contaminated, decontaminate

from .conftest import SCHEMA, prose


def items(n=40):
    rng = random.Random(11)
    return [(i, " ".join(prose(rng, rng.randint(6, 14)).split()) + ". " + " ".join(prose(rng, 8).split()) + ".") for i in range(n)]


def test_wand_finds_what_exhaustive_scoring_finds():
    index = Index.of(items(300))
    rng = np.random.default_rng(1)
    for k in range(200):
        terms = np.unique(rng.integers(0, len(index.terms), rng.integers(1, 150)))
        if k % 2:
            terms = np.union1d(terms, np.searchsorted(index.terms, np.unique(index.items[k].words)))
        score = np.zeros(len(index.items))
        for t in terms:
            score[index.lists[t][0]] += index.lists[t][1]
        for least in (0.05, 0.2, THRESHOLD, 0.95):
            assert sorted(i for i, _ in index.search(terms, least)) == np.flatnonzero(score >= least - 1e-9).tolist()


def test_leaks_are_found_wherever_they_stand(spark):
    rng = random.Random(2)
    bench = items()
    rows, want = [], set()
    for d in range(60):
        words = prose(rng, rng.choice([5, 50, 300])).split(" ")
        if d % 3 == 0:
            item, text = bench[d % len(bench)]
            if d % 2:
                w = text.split(" ")
                w[len(w) // 2] = "changed"
                text = " ".join(w)
            at = rng.randint(0, len(words))
            words[at:at] = (text.upper() if d % 4 == 0 else text).split(" ")
            want.add((d, item))
        rows.append((d, " ".join(words), None, None))
    docs = spark.createDataFrame(rows, SCHEMA)
    table = spark.createDataFrame(bench, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, table).collect()} == want
    assert {r.doc_id for r in decontaminate(docs, table).collect()} == {d for d in range(60)} - {d for d, _ in want}


def altered(bench, seed=4, n=160):
    """Copies of items with some of their words changed, within other text."""
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        w = bench[rng.randrange(len(bench))][1].split(" ")
        for _ in range(rng.randint(0, len(w) // 3)):
            w[rng.randrange(len(w))] = rng.choice(["changed", "other", "alpha"])
        rows.append((d, prose(rng, rng.choice([3, 90])) + " " + " ".join(w) + " " + prose(rng, rng.choice([0, 150])), None, None))
    return rows


def test_blocks_of_items_change_nothing(spark):
    """Items in one block, and in blocks of some bytes looked up in several passes, give the same hits and scores."""
    bench = items()
    docs = spark.createDataFrame(altered(bench), SCHEMA)
    table = spark.createDataFrame(bench, "item_id long, text string")
    key = lambda r: (r.doc_id, r.item_id, round(r.score, 9), round(r.question, 9), round(r.answer, 9))
    one = sorted(map(key, contaminated(docs, table).collect()))
    assert len(one) > 40
    assert sorted(map(key, contaminated(docs, table, block_bytes=700, pass_bytes=2000).collect())) == one


def test_query_against_exhaustive_scoring(spark):
    """All passages against all items, scored and verified with plain Python from the definition."""
    bench = items(25) + [(90, prose(random.Random(8), 200).replace("\n", " "))]
    rows = altered(bench, 5, 60) + [(500, None, None, None), (501, "", None, None), (502, prose(random.Random(6), 4000), None, None)]
    words = lambda t: re.findall(r"[^\W_]+|[^\x00-\x7f]+", (t or "").lower())
    own = {i: words(t) for i, t in bench}
    n, mean = len(own), sum(map(len, own.values())) / len(own)
    df = Counter(t for w in own.values() for t in set(w))
    impact = {}
    for i, w in own.items():
        tf = Counter(w)
        raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in tf.items()}
        impact[i] = {t: v / sum(raw.values()) for t, v in raw.items()}
    grams = lambda w: [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    want = {}
    for d, text, *_ in rows:
        w = words(text)
        for i, t in bench:
            stride = max(LEAST_WINDOW, max((len(x) for j, x in own.items() if (len(x) <= 64) == (len(own[i]) <= 64)), default=0))
            last = len(words(re.split(r"(?<=[.!?])\s+", t)[-1]))
            cut = len(own[i]) - last or len(own[i])
            for a in range(0, max(len(w) - stride, 1), stride):
                p = w[a : a + 2 * stride]
                score = sum(v for x, v in impact[i].items() if x in p)
                if score < THRESHOLD - 1e-9:
                    continue
                seen, covered = set(grams(p)), [False] * len(own[i])
                for k, g in enumerate(grams(own[i])):
                    if g in seen:
                        covered[k : k + 3] = [True] * 3
                question, answer = sum(covered[:cut]) / cut, sum(covered[cut if cut < len(covered) else 0 :]) / (len(covered) - cut or cut)
                if question >= QUESTION and answer >= ANSWER and score > want.get((d, i), 0) + 1e-12:
                    want[d, i] = score
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got.keys() == want.keys() and len(want) > 15
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (3, "... !"), (4, "unseen words only here."), (5, "word")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(odd, bench).collect()}
    assert got == {(33, 5), (34, 5)}
    left = decontaminate(odd, bench)
    assert left.columns == odd.columns and left.count() == odd.count() - 2
    assert contaminated(none, bench).count() == 0
    assert contaminated(odd, bench.where("false")).count() == 0
    # a hit in a text without an id takes that row only
    null = spark.createDataFrame([(None, "a word b", None, None), (None, "nothing", None, None)], SCHEMA)
    assert [r.text for r in decontaminate(null, bench).collect()] == ["nothing"]
