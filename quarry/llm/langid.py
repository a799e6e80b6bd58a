"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the lower-cased text are hashed into ``SIZE`` features.  A feature's value is
its share of the text's n-grams times its inverse document frequency, so a text's scores are a mean over its n-grams
of the class weights: whole texts are scored by table lookups and one sum, whatever their length.  The model is fitted
by follow-the-regularised-leader with elastic-net penalties on at most ``PER_LABEL`` texts a language, and where there
are many languages on about ``SAMPLE`` texts of all (a bounded sample: those of the least hashes of doc_id, one of each
language at least); a fifth of the sample is set aside to calibrate the softmax's temperature.  Every language is
learned, however rare.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ftrl, shared
from .sampling import fold, least_hashes, texts_of
from .scoring import with_text_columns

SIZE = 1 << 16
PER_LABEL = 600
SAMPLE = 24_000
SCALE = 100.0
CHUNK = 1 << 17
_LETTER = regex.compile(r"\p{L}")
_MUL = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK`` characters together."""
    i = size = 0
    for j, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def ngrams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For n = 1, 2, 3 the hashed n-gram that begins at each character (SIZE where it would leave the text), and where
    each text begins."""
    low = [t.lower() for t in texts]
    p = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))])
    stop = np.repeat(first[1:], np.diff(first))
    place = np.arange(len(p))
    out, h = [], np.zeros(len(p), np.uint32)
    for n in range(3):
        nxt = np.zeros(len(p), np.uint32)
        nxt[: len(p) - n] = p[n:] if n else p
        h = (h ^ (nxt + np.uint32(n + 1))) * _MUL[n]
        h = h ^ (h >> np.uint32(15))
        at = ((h * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32)
        at[place + n >= stop] = SIZE
        out.append(at)
    return out, first


@dataclass
class Model:
    """``weights``: (SIZE + 1, classes), the inverse document frequencies and the scale included, the last row zero."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities (texts, classes)."""
        grams, first = ngrams(texts)
        n = np.diff(first)
        total = np.zeros((len(texts), len(self.labels)), np.float64)
        some = np.flatnonzero(n > 0)
        if len(some):
            for at in grams:
                total[some] += np.add.reduceat(self.weights[at], first[some], axis=0, dtype=np.float64)
        count = np.maximum(3 * n - 3, n)  # n-grams of a text of n characters, for n > 1
        return ftrl.softmax((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse n-gram counts of each labelled text: features and counts as bytes."""
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for i, j in _pieces(texts):
            grams, first = ngrams(texts[i:j])
            ids, vals = [], []
            for d in range(j - i):
                at, n = np.unique(np.concatenate([g[first[d] : first[d + 1]] for g in grams]), return_counts=True)
                keep = at < SIZE
                ids.append(at[keep].astype("<i4").tobytes())
                vals.append(n[keep].astype("<i4").tobytes())
            yield pa.record_batch({"label": batch.column("label").slice(i, j - i), "h": batch.column("h").slice(i, j - i), "ids": pa.array(ids, pa.binary()), "vals": pa.array(vals, pa.binary())})


def train(docs: DataFrame, per_label: int = PER_LABEL, sample: int = SAMPLE) -> Model | None:
    """Fits a model to ``docs`` (doc_id, text, lang), leaving out rows with a null in any of them.  None if no row is left."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("label"))
    chosen = shared.written(least_hashes(known, per_label), "language-sample")
    labels = sorted(r.label for r in chosen.select("label").distinct().collect())
    if not labels:
        shared.drop(chosen)
        return None
    each = max(1, min(per_label, sample // len(labels)))
    texts = texts_of(known, least_hashes(chosen, each), each, ("doc_id", "label"))
    counted = shared.written(shared.map_arrow(texts, _counts, "label string, h long, ids binary, vals binary"), "language-counts")
    rows = counted.orderBy("h", "label", "ids", "vals").collect()
    shared.drop(chosen, counted)
    ids = [np.frombuffer(r.ids, "<i4") for r in rows]
    df = np.zeros(SIZE)
    for at in ids:
        df[at] += 1
    idf = (np.log((1 + len(ids)) / (1 + df)) + 1).astype(np.float32)
    x = []
    for at, r in zip(ids, rows, strict=True):
        n = np.frombuffer(r.vals, "<i4").astype(np.float32)
        x.append((at, SCALE * n / max(n.sum(), 1) * idf[at]))
    place = {v: k for k, v in enumerate(labels)}
    y = np.array([place[r.label] for r in rows])
    held = np.array([r.h % 5 == 0 for r in rows])
    learned = np.bincount(y[~held], minlength=len(labels)) > 0
    held &= learned[y]  # a language of which all texts would be set aside is learned from them
    fit = np.flatnonzero(~held) if (~held).any() else np.arange(len(rows))
    w = ftrl.multinomial([x[i] for i in fit], y[fit], SIZE, len(labels), l1=0.02, l2=0.1)
    logits = np.array([v @ w[at] + w[SIZE] for at, v in x])
    test = np.flatnonzero(held) if held.any() else np.arange(len(rows))

    def loss(t: float) -> float:
        p = ftrl.softmax(logits[test] / t)
        return float(-np.log(np.maximum(p[np.arange(len(test)), y[test]], 1e-12)).mean())

    table = np.zeros((SIZE + 1, len(labels)), np.float32)
    table[:SIZE] = w[:SIZE] * idf[:, None] * SCALE
    return Model(labels, table, w[SIZE], ftrl.best_temperature(loss))


def _scored(model: Model | None):
    def run(texts: list[str | None]) -> Iterator[tuple[int, dict[str, pa.Array]]]:
        for i, j in _pieces(texts):
            own = [t or "" for t in texts[i:j]]
            has = np.array([_LETTER.search(t) is not None for t in own])
            pred, score = np.full(j - i, "und", object), np.zeros(j - i)
            if model is not None and has.any():
                p = model.scores(own)
                pred = np.where(has, np.array(model.labels, object)[p.argmax(axis=1)], "und")
                score = np.where(has, p.max(axis=1), 0.0)
            yield j - i, {"lang_pred": pa.array(pred.tolist(), pa.string()), "score": pa.array(score)}

    return run


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the columns lang_pred and score (0 to 1, calibrated) in place of any of those names.

    A text that is null or has no letter (Unicode category L) is ``und`` with score 0, as is every text if nothing could
    be learned.  Of languages that tie the least by code point is given.  Very long texts are scored whole.  Equal
    texts get equal answers; an empty table gives no rows; other columns (``keep``: only those) pass through.
    """
    return with_text_columns(docs, _scored(model), {"lang_pred": "string", "score": "double"}, keep)


def language_report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from rows whose fold of 4 is not 2, applied to all."""
    out = fold(4) == 2
    model = train(docs.where(~F.coalesce(out, F.lit(False))))
    return shared.written(identify(docs, model, ["doc_id"]).select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score"), "language-report")
