"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

Every passage of every training text is a query.  Passages are overlapping windows of words, long enough that each
item lies whole in one of them.  A posting's impact is its BM25 weight divided by the item's score for itself, so a
passage that holds all of an item's words scores one, and ``THRESHOLD`` means the same for all items.  First a bound
of each passage's score for each item is computed for whole chunks of texts with array operations (``Index.pivots``);
it is WAND's pivot test before any list is opened.  Passages that can reach the threshold run block-max WAND over
lists whose blocks of ``POSTINGS`` postings have their greatest impact and last item in the index, and which returns
every item above the threshold.  Each is then verified in the passage: enough of the question's words, and of the
answer's, must be covered by word trigrams that they share with the passage in the order of the item.  An item's last
sentence is its answer, what stands before it the question (all of it, if there is one sentence only).

The statistics (number of items, their mean length, document frequencies) are those of all items, computed in Spark.
Items are indexed in blocks: by length (a very long item makes long windows for its like only) and, where a block's
text would exceed ``BLOCK_BYTES``, by hash.  Blocks of up to ``PASS_BYTES`` together are looked up in one pass over the
texts.  How items are cut into blocks changes no score and no hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, wordhash

K1, B = 1.2, 0.75
THRESHOLD = 0.6
QUESTION, ANSWER = 0.8, 0.6
REST = 0.3
GRAM = 3
BLOCK_BYTES = 8 << 20
PASS_BYTES = 32 << 20
POSTINGS = 64
LEAST_WINDOW = 64
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def _trigrams(w: np.ndarray) -> np.ndarray:
    """Hashes of the runs of GRAM words (of all words, if fewer)."""
    k = min(GRAM, len(w))
    s = np.zeros(max(len(w) - k + 1, 0), np.uint64)
    for t in range(k):
        s = wordhash.mix(s + w[t : t + len(s)])
    return s


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    parts: list[tuple[int, int]]  # word ranges of the question and the answer


@dataclass
class Statistics:
    """Of all items, or of some: how many, their mean number of words, and the frequency of each of ``terms``."""

    n: int
    mean: float
    terms: np.ndarray
    df: np.ndarray

    @staticmethod
    def of(items: list[Item]) -> Statistics:
        found = [np.unique(i.words) for i in items]
        terms, df = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return Statistics(len(items), float(np.mean([len(i.words) for i in items])) if items else 0.0, terms, df)


def parsed(item_id: int, text: str) -> Item | None:
    """An item's words and parts; None if it has no word and so can be in no text."""
    sentences = [s for s in _SENTENCE.split(text) if s.strip()]
    raw, off = wordhash.utf8(pa.array(sentences or [""], pa.string()))
    h, _, _, first = wordhash.words(raw, off, 0, len(off) - 1, signs=True)
    if len(h) == 0:
        return None
    cut = int(first[-2]) if len(sentences) > 1 and 0 < first[-2] < len(h) else len(h)
    return Item(item_id, h, [(0, cut), (cut, len(h))] if cut < len(h) else [(0, len(h))])


@dataclass
class Index:
    items: list[Item]
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    best: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Of each term: items, impacts, and of each block of postings the greatest impact and the last item.
    lists: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    window: int = LEAST_WINDOW
    p_term: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    p_item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    p_impact: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @staticmethod
    def of(rows: list[tuple[int, str]], known: Statistics | None = None) -> Index:
        """The index of some items, with the statistics of all (their own, if none are given)."""
        items = [i for i in (parsed(*r) for r in rows) if i is not None]
        index = Index(items)
        if not items:
            return index
        known = known or Statistics.of(items)
        size = np.array([len(i.words) for i in items])
        tf = [np.unique(i.words, return_counts=True) for i in items]
        index.terms = np.unique(np.concatenate([t for t, _ in tf]))
        df = known.df[np.searchsorted(known.terms, index.terms)]
        idf = np.log(1 + (known.n - df + 0.5) / (df + 0.5))
        rows_, cols, impact = [], [], []
        for k, (t, n) in enumerate(tf):
            at = np.searchsorted(index.terms, t)
            w = idf[at] * n * (K1 + 1) / (n + K1 * (1 - B + B * size[k] / known.mean))
            rows_.append(at)
            cols.append(np.full(len(t), k))
            impact.append(w / w.sum())
        r, c, v = np.concatenate(rows_), np.concatenate(cols), np.concatenate(impact)
        order = np.lexsort((c, r))
        r, c, v = r[order], c[order], v[order]
        index.p_term, index.p_item, index.p_impact = r, c, v
        bounds = np.searchsorted(r, np.arange(len(index.terms) + 1))
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            block = np.arange(0, z - a, POSTINGS)
            last = np.append(block[1:], z - a) - 1
            index.lists.append((c[a:z], v[a:z], np.maximum.reduceat(v[a:z], block), c[a:z][last]))
        index.best = np.maximum.reduceat(v, bounds[:-1])
        index.window = max(LEAST_WINDOW, int(size.max()))
        return index

    def pivots(self, at: np.ndarray, start: np.ndarray, near: np.ndarray, per: np.ndarray) -> np.ndarray:
        """Windows that may hold an item with a score of ``THRESHOLD``, given the terms ``at`` of a chunk's indexed
        words, the first window and number of windows of each word's document, and the last window that holds it.

        For each item, its terms that are commonest in the chunk and together weigh at most ``REST`` are set aside.
        What they add is bounded by their weight, so a window qualifies only if the other terms, whose occurrences
        are few, bring the rest; that holds for any choice of terms, so no item above the threshold is passed over.
        """
        if not len(at):
            return np.zeros(0, np.int64)
        count = np.bincount(at, minlength=len(self.terms))
        order = np.lexsort((count[self.p_term], self.p_item))
        item, term, v = self.p_item[order], self.p_term[order], self.p_impact[order]
        rarer = np.cumsum(v) - v - item  # each item's impacts sum to one
        needed = 1 - rarer > REST
        rest = np.bincount(item[~needed], weights=v[~needed], minlength=len(self.items))
        item, term, v = item[needed], term[needed], v[needed]
        order = np.argsort(term, kind="stable")
        item, term, v = item[order], term[order], v[order]
        a, z = np.searchsorted(term, at), np.searchsorted(term, at, "right")
        n = z - a
        place = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        word = np.repeat(np.arange(len(at)), n)
        window = np.concatenate([np.minimum(near, per - 1)[word], near[word] - 1])
        ok = window >= 0
        word, place = np.concatenate([word, word])[ok], np.concatenate([place, place])[ok]
        pair = (start[word] + window[ok]) * len(self.items) + item[place]
        key = np.unique(pair * np.int64(len(term)) + place)  # each posting once a window
        pair, at_ = key // len(term), key % len(term)
        cut = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        total = np.add.reduceat(v[at_], cut) if len(cut) else np.zeros(0)
        own = pair[cut]
        return np.unique(own[total + rest[own % len(self.items)] >= THRESHOLD - 1e-9] // len(self.items))

    def search(self, terms: np.ndarray, least: float) -> list[tuple[int, float]]:
        """Block-max WAND: (item, score) of every item whose summed impact over ``terms`` (distinct) is ``least`` or more."""
        cursors = [[0, self.lists[t][0], self.lists[t][1], float(self.best[t]), *self.lists[t][2:]] for t in terms.tolist()]
        out = []
        while cursors:
            cursors.sort(key=lambda q: q[1][q[0]])
            bound, pivot = 0.0, -1
            for k, q in enumerate(cursors):
                bound += q[3]
                if bound >= least - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][1][cursors[pivot][0]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][1][cursors[pivot + 1][0]] == item:
                pivot += 1
            # the greatest impact in the posting block that would hold the item, of each list up to the pivot
            tight, end = 0.0, None
            for q in cursors[: pivot + 1]:
                at = q[0] + int(np.searchsorted(q[1][q[0] :], item))
                if at < len(q[1]):
                    tight += float(q[4][at // POSTINGS])
                    last = int(q[5][at // POSTINGS])
                    end = last if end is None else min(end, last)
            if tight < least - 1e-9:
                # no item up to the end of these blocks can reach the threshold
                nxt = (end if end is not None else int(item)) + 1
                if pivot + 1 < len(cursors):
                    nxt = min(nxt, int(cursors[pivot + 1][1][cursors[pivot + 1][0]]))
                nxt = max(nxt, int(item) + 1)
                moved = cursors[: pivot + 1]
            elif cursors[0][1][cursors[0][0]] == item:
                score = sum(float(q[2][q[0]]) for q in cursors[: pivot + 1])
                if score >= least - 1e-9:
                    out.append((int(item), score))
                nxt, moved = int(item) + 1, cursors[: pivot + 1]
            else:
                nxt, moved = int(item), [q for q in cursors[: pivot + 1] if q[1][q[0]] < item]
            for q in moved:
                q[0] += int(np.searchsorted(q[1][q[0] :], nxt))
            cursors = [q for q in cursors if q[0] < len(q[1])]
        return out

    def overlap(self, item: int, passage: np.ndarray) -> list[float]:
        """Shares of the item's parts whose words are covered by trigrams of the passage."""
        own = self.items[item]
        k = min(GRAM, len(own.words))
        hit = np.isin(_trigrams(own.words), _trigrams(passage) if len(own.words) >= GRAM else _short(passage, k))
        covered = np.zeros(len(own.words), bool)
        for t in range(k):
            covered[t : t + len(hit)] |= hit
        return [float(covered[a:z].mean()) for a, z in own.parts]


def _short(w: np.ndarray, k: int) -> np.ndarray:
    s = np.zeros(max(len(w) - k + 1, 0), np.uint64)
    for t in range(k):
        s = wordhash.mix(s + w[t : t + len(s)])
    return s


def _found(index: Index, mask: np.ndarray, h: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(document, item): (score, question, answer) of the best passages, given the words of a chunk of documents."""
    size, stride = 2 * index.window, index.window
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    some = np.flatnonzero(mask[(h >> np.uint64(44)).astype(np.int64)])
    at = np.searchsorted(index.terms, h[some])
    at[at == len(index.terms)] = 0
    ok = index.terms[at] == h[some]
    some, at = some[ok], at[ok]
    # windows begin at every ``stride`` words of a document
    n = np.diff(first)
    per = np.maximum(-(-(n - stride) // stride), 1) * (n > 0)
    start = np.cumsum(per) - per
    doc = np.repeat(np.arange(len(n)), per)
    begin = first[doc] + (np.arange(len(doc)) - start[doc]) * stride
    end = np.minimum(begin + size, first[doc + 1])
    lo, hi = np.searchsorted(some, begin), np.searchsorted(some, end)
    owner = np.searchsorted(first, some, "right") - 1
    near = (some - first[owner]) // stride
    for w in index.pivots(at, start[owner], near, per[owner]).tolist():
        for item, score in index.search(np.unique(at[lo[w] : hi[w]]), THRESHOLD):
            shares = index.overlap(item, h[begin[w] : end[w]])
            if shares[0] >= QUESTION and shares[-1] >= ANSWER:
                key = (int(doc[w]), item)
                if key not in found or found[key][0] < score:
                    found[key] = (score, shares[0], shares[-1])
    return found


def _hits(indexes: list[Index]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # words are looked up by the high bits of their hashes first: most are in no item
        masks = [np.zeros(1 << 20, bool) for _ in indexes]
        for mask, index in zip(masks, indexes, strict=True):
            mask[(index.terms >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            raw, off = wordhash.utf8(batch.column("text"))
            ids = batch.column("doc_id")
            for i, j in wordhash.chunks(off):
                h, _, _, first = wordhash.words(raw, off, i, j, signs=True)
                for mask, index in zip(masks, indexes, strict=True):
                    found = _found(index, mask, h, first) if len(h) and len(index.terms) else {}
                    if found:
                        yield pa.record_batch(
                            {
                                "doc_id": ids.slice(i, j - i).take(pa.array([d for d, _ in found])),
                                "item_id": pa.array([index.items[k].item_id for _, k in found], pa.int64()),
                                "score": pa.array([v[0] for v in found.values()]),
                                "question": pa.array([v[1] for v in found.values()]),
                                "answer": pa.array([v[2] for v in found.values()]),
                            }
                        )

    return run


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's words and distinct terms."""
    for batch in batches:
        raw, off = wordhash.utf8(batch.column("text"))
        for i, j in wordhash.chunks(off):
            h, _, _, first = wordhash.words(raw, off, i, j, signs=True)
            own = [np.unique(h[a:z]).view(np.int64) for a, z in zip(first[:-1], first[1:], strict=True)]
            yield pa.record_batch({"item_id": batch.column("item_id").slice(i, j - i), "text": batch.column("text").slice(i, j - i), "words": pa.array(np.diff(first)), "terms": pa.array(own, pa.list_(pa.int64()))})


def _blocks(items: DataFrame, block_bytes: int) -> list[tuple[int, int, int, int]]:
    """(length class, hash, number of hashes, bytes) of blocks of at most ``block_bytes`` of text, as far as items can be
    told apart."""
    out, n, left = [], 1, None
    while True:
        h = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        found = items.groupBy("long", h.alias("h")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_distinct("item_id", "text").alias("n")).collect()
        found = [r for r in found if left is None or r.long in left]
        over = {r.long for r in found if r.bytes > block_bytes and r.n > 1}
        out += [(r.long, r.h, n, r.bytes) for r in found if r.long not in over]
        if not over:
            return sorted(out)
        left, n = over, 2 * n


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, item_id, score, question, answer) for each item that a text of ``docs`` (doc_id, text) holds.

    A row of ``docs`` gives an item at most once, with its best passage; of passages that tie the first.  Null and empty
    texts, and items with a null id or text or without words, give none.  Very long texts are searched whole, and a very
    long item like others.  Repeated rows of ``docs`` give repeated hits, repeated items count once; an empty table on
    either side gives none.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question double, answer double"
    given = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    items = shared.written(shared.map_arrow(given, _terms, "item_id long, text string, words long, terms array<long>"), "bench-items").where("words > 0")
    path = [items]
    items = items.withColumn("long", F.greatest(F.lit(0), F.ceil(F.log2(F.col("words") / LEAST_WINDOW))).cast("int"))
    whole = items.agg(F.count("*").alias("n"), F.avg("words").alias("mean")).first()
    df = shared.written(items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "bench-terms")
    blocks = _blocks(items, block_bytes)
    out = spark.createDataFrame([], schema) if not blocks else None
    while blocks:
        taken, size = [], 0
        while blocks and (not taken or size + blocks[0][3] <= pass_bytes):
            taken.append(blocks.pop(0))
            size += taken[-1][3]
        indexes = []
        for long, h, n, _ in taken:
            block = items.where((F.col("long") == long) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == h))
            rows = sorted((r.item_id, r.text) for r in block.select("item_id", "text").collect())
            own = block.select(F.explode("terms").alias("term")).distinct().join(df, "term").toArrow()
            term, count = own["term"].to_numpy().view(np.uint64), own["df"].to_numpy()
            order = np.argsort(term)
            indexes.append(Index.of(rows, Statistics(whole.n, whole.mean, term[order], count[order])))
        hits = shared.written(shared.map_arrow(docs, _hits(indexes), schema), "bench-hits")
        out = hits if out is None else out.unionAll(hits)
    shared.drop(*path, df)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose doc_id is in no hit of ``contaminated``.  Rows with a null doc_id
    are judged by their text alone, like others: a null-safe comparison would drop all of them for one hit, so they
    are numbered by their text's hash."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    # the hits are a written table, so the planner knows how few they are before it moves any text
    hits = contaminated(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hits, key == hits["_hit"], "left_anti")
