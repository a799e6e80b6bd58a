"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact check, components.

Texts with equal shingle sets form one class, which stands for all its copies from then on, so a group of a thousand
copies costs one signature.  For each class, ``BANDS * ROWS`` minima of the hashes a*x+b (mod 2**32, a odd) are taken
over its whole shingle set.  Classes that agree on all ``ROWS`` minima of a band share a bucket.  Pairs from buckets
must pass, in this order: a size test (sizes further apart than the threshold allows), the share of equal minima
(pairs whose estimate is over five standard errors too low go), and the exact test on the full sets.

All pairs of a bucket are never listed.  In each of ``ROUNDS`` rounds a bucket compares its members with one leader, and
found links merge components; a bucket that is all in one component is done.  For members that are still outside the
main component of a bucket, an exact join finds every partner: with shingles in the order of their frequency, two sets
that reach the threshold share a shingle among the first few of each, at places that still leave room for the overlap
(prefix and position filters).  A member of a large group that is linked to nobody differs from the rest in shingles
of its own, which come first and meet nothing.  So no link between components is lost, and the work stays near linear.

Odds of missing a link of exactly 0.8: (1 - 0.8**6)**40 = 5e-6 by the bands, below 1e-6 by the estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, wordhash
from .components import connected_components

ROWS, BANDS = 6, 40
HASHES = ROWS * BANDS
_rng = np.random.default_rng(77)
_A = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
_STEP = 1024
ROUNDS = 2
#: Members of a bucket that meet its leader in one task at the utmost, in the mean.
PIECE = 256


def signature(shingles: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """The minima of all hash functions over a set of 64-bit shingles (uint32, one for each function)."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), _STEP):
        y = x[i : i + _STEP]
        v = buf[:, : len(y)]
        np.multiply(_A, y[None, :], out=v)
        np.add(v, _B, out=v)
        np.minimum(out, v.min(axis=1), out=out)
    return out


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buf = np.empty((HASHES, _STEP), np.uint32)
        salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            raw, off = wordhash.utf8(batch.column("text"))
            for i, j in wordhash.chunks(off):
                h, _, _, first = wordhash.words(raw, off, i, j)
                s, at = wordhash.shingles(h, first, k)
                n = np.diff(at)
                sig = np.zeros((j - i, HASHES), np.uint32)
                fp = np.zeros((j - i, 2), np.uint64)
                for d in range(j - i):
                    if n[d]:
                        own = s[at[d] : at[d + 1]]
                        sig[d] = signature(own, buf)
                        fp[d, 0] = np.add.reduce(own)
                        fp[d, 1] = np.add.reduce(wordhash.mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                key = salt[None, :].repeat(j - i, 0)
                wide = sig.reshape(j - i, BANDS, ROWS).astype(np.uint64)
                for r in range(ROWS):
                    key = wordhash.mix(key + wide[:, :, r])
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(i, j - i),
                        "text_hash": batch.column("text_hash").slice(i, j - i),
                        "n_shingles": pa.array(n.astype(np.int64)),
                        "fp": pa.array(wordhash.mix(fp[:, 0]).view(np.int64)),
                        "fq": pa.array(fp[:, 1].view(np.int64)),
                        "bands": pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(key.reshape(-1).view(np.int64))),
                        "sig": pa.array([x.tobytes() for x in (sig & np.uint32(0xFF)).astype(np.uint8)], pa.binary()),
                    }
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = wordhash.utf8(batch.column("text"))
            for i, j in wordhash.chunks(off):
                h, _, _, first = wordhash.words(raw, off, i, j)
                s, at = wordhash.shingles(h, first, k)
                yield pa.record_batch({"node": batch.column("node").slice(i, j - i), "shingles": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(s.view(np.int64)))})

    return run


def _estimate(least: float):
    """Keeps pairs whose share of equal signature bytes, less what chance gives, is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                sides = []
                for c in ("sig_a", "sig_b"):
                    raw, off = wordhash.utf8(batch.column(c))
                    sides.append(raw[off[0] : off[-1]].reshape(n, HASHES))
                share = ((sides[0] == sides[1]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
                yield batch.select(["a", "b"]).filter(pa.array(share >= least))

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Words are runs of non-space bytes with A-Z lower-cased; a document's set is its distinct ``k``-word shingles, or
    the whole sequence when it has fewer words.  Rows are linked when 100 * intersection >= ``percent`` * union.
    Rows without words, or with a null text, have an empty set and no links.  ``component_id`` is the least doc_id
    reachable.  A row with a null doc_id takes part in no link, has a null component and is kept.  Repeated rows are
    copies of each other; rows that repeat a doc_id with other text are judged by their own text.  Very long texts are
    taken whole.  An empty table gives an empty result.
    """
    return judged(docs, k, percent).select("doc_id", "n_shingles", "component_id", "kept")


def judged(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``near_duplicates`` with text_hash (xxhash64 of the text) and component, a number that no two components share
    (two may have one least doc_id, if rows repeat it with other text; null without links or words)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    schema = "doc_id long, text_hash long, n_shingles long, fp long, fq long, bands array<long>, sig binary"
    signed = shared.written(shared.map_arrow(docs, _signed(k), schema), "minhash-signed")
    able = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = shared.written(able.groupBy("fp", "fq", "n_shingles").agg(F.min(F.struct("doc_id", "text_hash")).alias("r")).select("fp", "fq", "n_shingles", "r.*"), "minhash-classes")
    classes, made = _numbered(classes, able)
    # the class's signature is the one of its least row (equal sets have equal signatures)
    reps = able.join(classes, ["doc_id", "text_hash", "fp", "fq", "n_shingles"]).dropDuplicates(["doc_id", "text_hash", "fp", "fq", "n_shingles"])
    reps = shared.written(reps.select("node", "doc_id", "text_hash", "n_shingles", "bands", "sig"), "minhash-reps")
    row = reps.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    many = row.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    # a large bucket is dealt out in pieces, each of which meets the leader
    salts = F.ceil(F.col("n") / PIECE).cast("int")
    members = row.join(many, "bucket").select("bucket", "node", F.col("n_shingles").alias("size"), salts.alias("salts"), F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"))
    members = shared.written(members, "minhash-members")
    comps = _joined(docs, reps, members, k, percent)
    label = classes.select("fp", "fq", F.col("n_shingles").alias("n_set"), "node", F.col("doc_id").alias("least"))
    if comps is None:
        of_class = label.select("fp", "fq", "n_set", F.col("least").alias("found"), F.col("node").alias("component"))
    else:
        of_class = label.join(comps.withColumnRenamed("component", "c"), "node", "left").withColumn("component", F.coalesce("c", "node"))
        least = of_class.where("c IS NOT NULL").groupBy("component").agg(F.min("least").alias("found"))
        of_class = of_class.join(least, "component", "left").select("fp", "fq", "n_set", F.coalesce("found", "least").alias("found"), "component")
    s = signed.select("doc_id", "text_hash", "n_shingles", "fp", "fq")
    out = s.join(of_class, (s.fp == of_class.fp) & (s.fq == of_class.fq) & (s.n_shingles == of_class.n_set) & s.doc_id.isNotNull(), "left")
    out = out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("found")).otherwise(F.col("doc_id")).alias("component_id"), "component")
    out = shared.written(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "minhash-judged")
    shared.drop(signed, classes, made, reps, members, comps)
    return out


def _numbered(classes: DataFrame, able: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``classes`` with node: the least doc_id, or, where several classes have the same one (a doc_id that is repeated
    with other text), a number that no row has."""
    twice = classes.groupBy("doc_id").count().where("count > 1").select("doc_id")
    plain = classes.withColumn("node", F.col("doc_id"))
    if twice.isEmpty():
        return plain, None
    ends = able.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    number = F.monotonically_increasing_id()
    free = F.lit(ends.hi) + 1 + number if ends.hi < 1 << 62 else F.lit(ends.lo) - 1 - number
    made = shared.written(classes.join(twice, "doc_id", "left_semi").withColumn("node", free), "minhash-numbered")
    return plain.join(twice, "doc_id", "left_anti").unionByName(made), made


def _joined(docs: DataFrame, reps: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame | None:
    """(node, component) of the classes that have links; None if no two classes share a bucket."""
    inside = reps.join(members.select("node").distinct(), "node", "left_semi")
    # the texts of the classes' least rows; of equal rows one
    who = inside.select("node", "doc_id", "text_hash", F.col("n_shingles").alias("size"), "sig")
    texts = docs.join(who.select("node", "doc_id", "text_hash"), ["doc_id", "text_hash"]).select("node", "text")
    sets = shared.map_arrow(texts, _sets(k), "node long, shingles array<long>").dropDuplicates(["node"])
    sets = shared.written(sets.join(who.select("node", "sig"), "node"), "minhash-sets")
    comps = links = old = None
    found, now = [], members
    for step in range(ROUNDS + 1):
        if step == 0:
            now = members.withColumn("comp", F.col("node"))
        else:
            named = comps.select(F.col("node").alias("_n"), "component")
            labelled = now.drop("comp").join(named, now.node == F.col("_n"), "left").select("bucket", "node", "size", "salts", "salt", F.coalesce("component", "node").alias("comp"))
            mixed = labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("salts").alias("salts")).where("lo <> hi").select("bucket", _pieces())
            was, now = now, shared.written(labelled.join(mixed, ["bucket", "salt"]), "minhash-open")
            if step > 1:
                shared.drop(was)
        if now.isEmpty():
            break
        if step < ROUNDS:
            lead = now.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", F.lit(step)).alias("h"), "node", "size", "comp")).alias("l"), F.max("salts").alias("salts"))
            lead = lead.select("bucket", _pieces(), F.col("l.node").alias("x"), F.col("l.size").alias("nx"), F.col("l.comp").alias("cx"))
            pairs = now.join(lead, ["bucket", "salt"]).where((F.col("cx") != F.col("comp")) & _near("nx", "size", percent))
            pairs = pairs.select(F.greatest("node", "x").alias("a"), F.least("node", "x").alias("b"))
            outside = []
        else:
            pairs, outside = _outside(now, sets, percent)
        found.append(shared.written(_verified(pairs.distinct(), sets, percent), "minhash-links"))
        shared.drop(*outside)
        links = found[-1] if links is None else links.unionAll(found[-1])
        shared.drop(old)
        joined = connected_components(links)
        old, comps = comps, shared.written(joined, "minhash-comps")
        shared.drop(joined)
    shared.drop(sets, old, *found, *([now] if now is not members else []))
    return comps


def _pieces():
    """A row for each piece into which a bucket is dealt."""
    return F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")


def _outside(now: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, b) of unlike components that may reach the threshold, one of them outside a bucket's main component;
    and the tables that they are read from."""
    tally = now.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.max("salts").alias("salts"))
    main = tally.groupBy("bucket").agg(F.max_by("comp", F.struct("n", F.negative("comp"))).alias("main"), F.max("salts").alias("salts")).select("bucket", "main", _pieces())
    reps = shared.written(now.join(main, ["bucket", "salt"]).groupBy("node", "size", "comp").agg(F.max(F.col("comp") != F.col("main")).alias("out")), "minhash-outside")
    token = sets.join(reps, "node", "left_semi").select("node", F.explode("shingles").alias("t"))
    common = token.groupBy("t").agg(F.count("*").alias("n")).where("n > 1")
    # shingles that only one set has come first and meet nothing: they only shift the places of the others
    order = token.join(common, "t").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("l"))
    place = order.join(reps, "node").select("node", "size", "comp", "out", (F.col("size") - F.size("l")).alias("own"), F.posexplode("l").alias("i", "s"))
    place = place.select("node", "size", "comp", "out", (F.col("own") + F.col("i")).alias("at"), F.col("s.t").alias("t"))
    place = place.where((F.col("size") - F.col("at")) * 100 >= F.col("size") * percent)
    place = shared.written(place, "minhash-prefix")
    x = place.where("out").select("t", F.col("node").alias("x"), F.col("size").alias("nx"), F.col("comp").alias("cx"), F.col("at").alias("ax"))
    room = F.least(F.col("size") - F.col("at"), F.col("nx") - F.col("ax")) * (100 + percent) >= (F.col("size") + F.col("nx")) * percent
    pairs = x.join(place, (x.t == place.t) & (F.col("cx") != F.col("comp")) & _near("nx", "size", percent) & room)
    return pairs.select(F.greatest("node", "x").alias("a"), F.least("node", "x").alias("b")), [reps, place]


def _near(x: str, y: str, percent: int):
    """Sizes of sets that can reach the threshold."""
    return (F.least(x, y) * 100) >= (F.greatest(x, y) * percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold: by signature first, then on the full sets."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    share = percent / 100
    least = max(0.0, share - 5.5 * (share * (1 - share) / HASHES) ** 0.5)
    likely = shared.map_arrow(with_b.select("a", "b", "sig_a", "sig_b"), _estimate(least), "a long, b long")
    left = likely.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")
