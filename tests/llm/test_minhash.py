import random

import pytest

from quarry.llm.components import connected_components
from quarry.llm.minhash import near_duplicates

from .conftest import SCHEMA, prose


def sets(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def brute(ids, texts, k, percent=80):
    """(size, component) of each row by all pairs."""
    s, at = sets(texts, k), list(range(len(ids)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    usable = [i for i in range(len(ids)) if s[i] and ids[i] is not None]
    for a in usable:
        for b in usable:
            n = len(s[a] & s[b])
            if a < b and 100 * n >= percent * (len(s[a]) + len(s[b]) - n):
                x, y = root(a), root(b)
                at[max(x, y)] = min(x, y)
    least = {}
    for i in usable:
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [(len(s[i]), least[root(i)] if i in usable else ids[i]) for i in range(len(ids))]


def check(df, ids, texts, k):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, k).collect()), key=repr)
    want = sorted(((d, n, c, d == c) for d, (n, c) in zip(ids, brute(ids, texts, k), strict=True)), key=repr)
    assert got == want


@pytest.mark.parametrize("k", [2, 5])
def test_odd_rows(odd, odd_rows, k):
    check(odd, [r[0] for r in odd_rows], [r[1] for r in odd_rows], k)


def test_empty(none):
    assert near_duplicates(none, 2).count() == 0


def test_large_group_of_near_copies(spark):
    """Copies at all distances around the threshold, so that leaders alone do not find every link."""
    rng = random.Random(5)
    base = prose(rng, 120).split()
    texts = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    check(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA), list(range(150)), texts, 2)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
