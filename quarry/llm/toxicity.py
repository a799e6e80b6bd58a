"""Toxicity by cumulative-link ordinal regression on sparse word features.

Words (runs of letters and digits, A-Z lower-cased) are hashed into ``SIZE`` features with value log(1 + count).  One
weight vector is shared by all thresholds: P(grade <= k) = sigmoid(threshold[k] - w.x).  The labels tell two grades
only, 0 and 1.  The third is an assumption of this module: grade 2 is a text of label 1 with at least the median number
of telling words among such texts, telling words being those that at least ``LIFT`` times the share of toxic texts hold.
So above 1 the severity says how much telling vocabulary a text has, not what an annotator graded; where a table has
grades, ``ftrl.ordinal`` takes them.  Weights are learned by follow-the-regularised-leader
with elastic-net penalties, which leave nearly all of them zero, on at most ``PER_LABEL`` texts of each label (a
bounded sample: the least hashes of doc_id).  The output is the expected grade, over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ftrl, shared, wordhash
from .sampling import fold, least_hashes, texts_of

SIZE = 1 << 18
PER_LABEL = 2500
GRADES = 3
LIFT = 5.0
#: Probability of a grade above 0 from which the report calls a text toxic: a miss is worse than a false alarm.
TOXIC = 0.3


def features(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


@dataclass
class Model:
    """``at``: the features with a weight, ascending."""

    at: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, raw: np.ndarray, off: np.ndarray, i: int, j: int) -> np.ndarray:
        """Expected grades of documents i..j-1, with P(grade > 0) in a second column."""
        h, _, _, first = wordhash.words(raw, off, i, j, signs=True)
        f = features(h)
        known = np.zeros(SIZE, bool)
        known[self.at] = True
        hit = np.flatnonzero(known[f])
        owner = np.searchsorted(first, hit, "right") - 1
        cell, n = np.unique(owner * SIZE + f[hit], return_counts=True)
        w = self.weights[np.searchsorted(self.at, cell % SIZE)] if len(cell) else np.zeros(0)
        score = np.bincount(cell // SIZE, weights=w * np.log1p(n), minlength=j - i)
        above = 1 - ftrl.sigmoid(self.thresholds[None, :] - score[:, None])
        return np.column_stack([above.sum(axis=1), above[:, 0]])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = wordhash.utf8(batch.column("text"))
        for i, j in wordhash.chunks(off):
            h, _, _, first = wordhash.words(raw, off, i, j, signs=True)
            f = features(h)
            found = [np.unique(f[first[d] : first[d + 1]], return_counts=True) for d in range(j - i)]
            yield pa.record_batch({"label": batch.column("label").slice(i, j - i), "h": batch.column("h").slice(i, j - i), "ids": pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), "vals": pa.array([n.astype("<i4").tobytes() for _, n in found], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Fits a model to ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic 0 or 1); rows with nulls are left out."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    texts = texts_of(docs.where("text IS NOT NULL").select("doc_id", "text"), least_hashes(known, per_label), per_label)
    counted = shared.written(shared.map_arrow(texts, _counts, "label int, h long, ids binary, vals binary"), "toxicity-counts")
    rows = counted.orderBy("h", "ids", "vals").collect()
    shared.drop(counted)
    x = [(np.frombuffer(r.ids, "<i4").astype(np.int64), np.log1p(np.frombuffer(r.vals, "<i4"))) for r in rows]
    toxic = np.array([r.label for r in rows], int)
    with_, without = np.zeros(SIZE), np.zeros(SIZE)
    for (at, _), t in zip(x, toxic, strict=True):
        (with_ if t else without)[at] += 1
    n1, n0 = max(int(toxic.sum()), 1), max(int((1 - toxic).sum()), 1)
    telling = ((with_ + 0.5) / n1 > LIFT * (without + 0.5) / n0) & (with_ >= 3)
    hits = np.array([int(telling[at].sum()) for at, _ in x])
    grade = toxic.copy()
    if toxic.any():
        grade[(toxic == 1) & (hits >= max(np.median(hits[toxic == 1]), 1))] = 2
    w, theta = ftrl.ordinal(x, grade, SIZE, GRADES, epochs=10, alpha=1.0, l1=8.0, l2=0.01)
    # the sample holds both labels evenly; the thresholds go back to the labels' own shares
    n = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if n.get(0) and n.get(1) and 0 < toxic.sum() < len(toxic):
        theta = theta + np.log(n[0] / n[1]) - np.log((len(toxic) - toxic.sum()) / toxic.sum())
    at = np.flatnonzero(w)
    return Model(at, w[at], theta)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = wordhash.utf8(batch.column("text"))
            for i, j in wordhash.chunks(off):
                s = model.severity(raw, off, i, j)
                yield pa.record_batch({"row": batch.column("row").slice(i, j - i), "severity": pa.array(s[:, 0].copy()), "toxic_probability": pa.array(s[:, 1].copy())})

    return run


def rate(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with severity (expected grade, 0 to 2) and toxic_probability, in place of columns of those names.

    A null or empty text, or one without telling words, has the severity of a text that says nothing.  Very long texts
    are taken whole.  Equal texts get equal values, and so do texts of one score; an empty table gives no rows; other columns (``keep``: only those) pass through.
    """
    new = ("severity", "toxic_probability")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").cast("string").alias("text"))
    out = shared.map_arrow(row, _scored(model), f"row {row.schema['row'].dataType.simpleString()}, severity double, toxic_probability double")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], *new)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, severity, score, toxic): labels of fold 0 of 5 are never learned from; toxic is 1 where the
    grade is above 0 with a probability of TOXIC or more."""
    model = train(docs, labels.where(fold(5) != 0))
    scored = rate(docs, model, ["doc_id"])
    return shared.written(scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "severity", F.col("toxic_probability").alias("score"), (F.col("toxic_probability") >= TOXIC).cast("int").alias("toxic")), "toxicity-report")
