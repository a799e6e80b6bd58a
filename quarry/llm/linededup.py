"""Line deduplication by word runs around each line.

A text is its lines that hold a word (words as elsewhere: non-space bytes, A-Z lower-cased; spacing within a line does
not matter).  Many texts keep a whole paragraph on one line, and a passage that is repeated inside it would be part of
two unlike lines; so a line also ends after a full stop, exclamation or question mark that a blank follows.  A line has
up to two grams: ``GRAM`` words from its first one on, and ``GRAM`` words up to its last one, or else the whole line if
it has as many.  The ends of lines count in a gram, but it may end inside another line, so a repeated passage may begin
and end inside lines.  If a gram has stood before (by doc_id, then place, in any text), its line goes, and with a gram
from the first word on all lines that are whole in it.

This is winnowing with a window of one gram: every gram is a fingerprint, not the least of several.  With wider windows
a fingerprint has to stand for its neighbours, so its match must be extended against a partner; with one partner for each
fingerprint, a run that a text shares only with another holder stays, and all partners of a common fingerprint are too
many.  Here each line is asked for itself whether it stood before, in whatever text, so runs are whole without that.

So of a repeated run of whole lines with ``GRAM`` words or more every line goes.  A passage of ``WINDOW`` words has
``GRAM`` of them from the start or up to the end of any line whole in it, as ``GRAM`` is half of it; so every line that
is whole in a repeated passage of ``WINDOW`` words, here and where it stood before, goes.  Both hold whatever other texts
hold of it: no partner is chosen and nothing is extended.  Lines that the passage cuts stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, wordhash

GRAM = 25
#: Of a repeated passage of so many words, twice GRAM, every whole line goes.
WINDOW = 50
_END = (1 << 63) - 1
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
#: Where a line ends, as a split that loses no character.
LINE_END = r"(?<=\n)|(?<=[.!?])(?=[ \t])"


def lines_of(raw: np.ndarray, off: np.ndarray, i: int, j: int):
    """Of documents i..j-1: the hash of each word; (first word, words, number in the text counting from 0) of each line
    with a word; the first word and the first such line of each document and the end."""
    h, start, _, first = wordhash.words(raw, off, i, j)
    base = int(off[i])
    b = raw[base : int(off[j])]
    ends = b == 0x0A
    if len(b) > 1:
        ends[:-1] |= _STOP[b[:-1]] & ((b[1:] == 0x20) | (b[1:] == 0x09))
    breaks = np.flatnonzero(ends) + base
    doc = np.repeat(np.arange(j - i), np.diff(first))
    before = np.searchsorted(breaks, start)  # line ends before each word
    number = before - np.searchsorted(breaks, off[i:j])[doc]
    new = np.ones(len(h), bool)
    new[1:] = (number[1:] != number[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    stop = np.append(at[1:], len(h)) if len(at) else at
    return h, at, stop - at, number[at], first, np.searchsorted(at, first)


def grams(h: np.ndarray, at: np.ndarray, size: np.ndarray, words: np.ndarray, first: np.ndarray, gram: int):
    """(line, last line that goes with it, hash) of each gram, lines ascending; arguments as ``lines_of`` gives them."""
    up, down = wordhash._pow(len(h) + 1)
    stop = at + size
    h = h.copy()
    h[stop - 1] = wordhash.mix(h[stop - 1] + np.uint64(1))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    lo, hi = (np.repeat(w, np.diff(first)) for w in (words[:-1], words[1:]))

    def hashed(start: np.ndarray, end: np.ndarray, side: int) -> np.ndarray:
        return wordhash.mix((total[end] - total[start]) * down[start] + (2 * (end - start) + side).astype(np.uint64))

    end = np.maximum(stop, at + gram)
    after = np.flatnonzero(end <= hi)
    before = np.flatnonzero((size < gram) & (stop - gram >= lo))
    line = np.concatenate([after, before])
    last = np.concatenate([np.searchsorted(stop, end[after], "right") - 1, before])
    g = np.concatenate([hashed(at[after], end[after], 0), hashed(stop[before] - gram, stop[before], 1)])
    order = np.argsort(line, kind="stable")
    return line[order], last[order], g[order]


def _signed(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = wordhash.utf8(batch.column("text"))
            for i, j in wordhash.chunks(off):
                h, at, size, number, words, first = lines_of(raw, off, i, j)
                line, last, g = grams(h, at, size, words, first, gram)
                cut = np.searchsorted(line, first)
                own = np.repeat(first[:-1], np.diff(cut))

                def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))

                marks = pa.StructArray.from_arrays([pa.array(g.view(np.int64)), pa.array((line - own).astype(np.int32)), pa.array((last - own).astype(np.int32))], ["g", "i", "e"])
                yield pa.record_batch(
                    {
                        "id": batch.column("id").slice(i, j - i),
                        "th": batch.column("th").slice(i, j - i),
                        "sizes": lists(size.astype(np.int32), first),
                        "numbers": lists(number.astype(np.int32), first),
                        "marks": pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), marks),
                    }
                )

    return run


def _keys(docs: DataFrame):
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_END)), F.xxhash64("text")


def repeated_lines(docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """(id, th, sizes, numbers, gone) for each row of ``docs``: word counts and line numbers of its lines, and the places
    (in these lists) of the lines to delete, ascending (null if none).

    ``id`` is the doc_id, a null counting as the greatest, ``th`` a hash of the text; texts are ordered by both.
    Rows that agree in both are one text, which is not a repetition of itself.  Null texts have no lines; very long texts
    are taken whole.
    """
    id_, th = _keys(docs)
    own = docs.select(id_.alias("id"), th.alias("th"), F.col("text").cast("string").alias("text"))
    schema = "id long, th long, sizes array<int>, numbers array<int>, marks array<struct<g: long, i: int, e: int>>"
    signed = shared.written(shared.map_arrow(own, _signed(gram), schema), "lines-signed")
    mark = signed.select("id", "th", F.inline("marks"))
    at = F.struct("id", "th", "i")
    # repeated rows hold their grams at the same places, so their first and last holders agree
    # written, so that the join has plain shuffles on both sides: a gram that very many texts hold is then split
    first = shared.written(mark.groupBy("g").agg(F.min(at).alias("f"), F.max(at).alias("z")).where("f != z").select("g", "f"), "lines-first")
    hit = mark.join(first, "g").where("NOT (f.id = id AND f.th = th AND f.i = i)")
    gone = hit.groupBy("id", "th").agg(F.collect_set(F.struct("i", "e")).alias("runs"))
    gone = gone.select("id", "th", F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["i"], r["e"]))))).alias("gone"))
    out = shared.written(signed.select("id", "th", "sizes", "numbers").join(gone, ["id", "th"], "left"), "lines-repeated")
    shared.drop(signed, first)
    return out


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, removed_lines, removed_words, removed): for each row of ``docs`` its lines with a word, how
    many of them and of their words go, and the numbers of those lines in the text.  An empty table gives no rows."""
    r = repeated_lines(docs)
    at = F.coalesce("gone", F.array().cast("array<int>"))
    return r.select(
        F.when(F.col("id") != _END, F.col("id")).alias("doc_id"),
        F.size("sizes").alias("n_lines"),
        F.size(at).alias("removed_lines"),
        F.aggregate(at, F.lit(0).cast("long"), lambda s, p: s + F.element_at("sizes", p + 1)).alias("removed_words"),
        F.transform(at, lambda p: F.element_at("numbers", p + 1)).alias("removed"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs``, all columns kept, with the repeated lines deleted from ``text``.  Only rows that lose lines are joined;
    a null text stays null."""
    r = repeated_lines(docs).where("gone IS NOT NULL").select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.transform("gone", lambda p: F.element_at("numbers", p + 1)).alias("_gone")).dropDuplicates(["_id", "_th"])
    names = docs.columns
    id_, th = _keys(docs)
    # user columns travel in one struct, so that no name of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), id_.alias("_id0"), th.alias("_th0"))
    out = rows.join(r, (F.col("_id0") == F.col("_id")) & (F.col("_th0") == F.col("_th")), "left")
    text = F.col("_row.text")
    left = F.array_join(F.filter(F.split(text, LINE_END), lambda x, k: ~F.array_contains("_gone", k)), "")
    return out.select(*[F.when(F.col("_gone").isNull(), text).otherwise(left).alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in names])
