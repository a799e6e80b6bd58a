"""Quality by compression: zstandard dictionaries from good and bad text.

A text is compressed with a dictionary of good and with one of bad labelled text; the difference of the two sizes,
normalised by the larger, says which it resembles.  A piecewise-linear logistic regression on texts that no dictionary
was built from calibrates that one number to a probability.  Dictionaries and calibration are fitted on at most
``PER_LABEL`` texts of each label (a bounded sample: the least hashes of doc_id), half of them for either purpose;
whole texts are used throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ftrl, shared
from .sampling import fold, least_hashes, texts_of
from .scoring import with_text_columns

PER_LABEL = 2500
DICT_BYTES = 32768
LEVEL = 3
PIECE = 4096
#: Knots of the piecewise-linear calibration of the normalised size difference.
_DIFF = np.array([-0.6, -0.3, -0.15, -0.08, -0.04, -0.02, 0.0, 0.02, 0.04, 0.08, 0.15, 0.3, 0.6])


def _hats(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Piecewise-linear basis: the weight of each knot."""
    x = np.clip(x, knots[0], knots[-1])
    k = np.clip(np.searchsorted(knots, x, "right") - 1, 0, len(knots) - 2)
    f = (x - knots[k]) / (knots[k + 1] - knots[k])
    out = np.zeros((len(x), len(knots)))
    out[np.arange(len(x)), k] = 1 - f
    out[np.arange(len(x)), k + 1] += f
    return out


def difference(sizes: np.ndarray) -> np.ndarray:
    """The normalised size difference of each text: above 0 if the good dictionary serves it better."""
    g, b = sizes[:, 0], sizes[:, 1]
    return (b - g) / np.maximum(np.maximum(g, b), 1)


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray

    def __post_init__(self) -> None:
        self._tools: list | None = None

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "weights": self.weights, "_tools": None}

    def sizes(self, texts: list[bytes]) -> np.ndarray:
        """(compressed with good, with bad, bytes) of each text."""
        if self._tools is None:
            bare = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
            self._tools = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), **bare) if d else zstandard.ZstdCompressor(level=LEVEL, **bare) for d in (self.good, self.bad)]
        g, b = self._tools
        return np.array([(len(g.compress(t)), len(b.compress(t)), len(t)) for t in texts], np.float64).reshape(-1, 3)

    @staticmethod
    def columns(sizes: np.ndarray) -> np.ndarray:
        return _hats(difference(sizes), _DIFF)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return ftrl.sigmoid(self.columns(self.sizes(texts)) @ self.weights)


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text for the trainer, that text itself, whole."""
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Fits a model to ``docs`` (doc_id, text) with ``labels`` (doc_id, quality 0 or 1); rows with nulls are left out."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    texts = texts_of(docs.where("text IS NOT NULL").select("doc_id", "text"), least_hashes(known, per_label), per_label)
    rows = texts.select(F.col("text").cast("string").cast("binary").alias("t"), "label", "h").orderBy("h", "t").toArrow().to_pylist()
    build, fit = [r for k, r in enumerate(rows) if k % 2 == 0], [r for k, r in enumerate(rows) if k % 2]
    model = Model(_dictionary([r["t"] for r in build if r["label"] == 1]), _dictionary([r["t"] for r in build if r["label"] == 0]), np.zeros(len(_DIFF)))
    if fit:
        x, y = model.columns(model.sizes([r["t"] for r in fit])), np.array([r["label"] for r in fit], float)
        # both labels were sampled evenly; weighting back to their shares makes the score a probability
        n = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
        model.weights = ftrl.logistic(x, y, ridge=0.05)
        if 0 < y.sum() < len(y) and n.get(0) and n.get(1):
            shift = np.log(n[1] / n[0]) - np.log(y.sum() / (len(y) - y.sum()))
            model.weights = model.weights + shift  # each text's knots weigh one together
    return model


def _scored(model: Model):
    def run(texts: list[bytes | None]) -> Iterator[tuple[int, dict[str, pa.Array]]]:
        yield len(texts), {"quality_score": pa.array(model.scores([t or b"" for t in texts]))}

    return run


def assess(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with quality_score (0 to 1; higher: label 1 likelier), in place of a column of that name.  A null or
    empty text is scored as zero bytes, for which neither dictionary serves better.  Very long texts are compressed
    whole.  Equal texts get equal scores, and so do texts whose difference ties; an empty table gives no rows; other
    columns (``keep``: only those) pass through."""
    return with_text_columns(docs, _scored(model), {"quality_score": "double"}, keep, as_bytes=True)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): labels of fold 0 of 5 are never learned from."""
    out = F.coalesce(fold(5) == 0, F.lit(False))
    model = train(docs, labels.where(fold(5) != 0))
    scored = assess(docs, model, ["doc_id"])
    return shared.written(scored.select("doc_id", out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted")), "quality-report")
