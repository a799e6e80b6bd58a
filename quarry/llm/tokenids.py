"""Token ids in a byte-aligned, frequency-ranked binary format.

Encoding: texts are cut into the tokenizer's pre-tokens with array operations, and the tokenizers library encodes each
distinct pre-token once for as long as a worker remembers it.  Within a block of documents ids are replaced by their
rank in the block's id frequencies, and ranks are stored in 1 to 4 bytes each with the lengths (2 bits an id) in separate
control bytes, so that numpy decodes a block with table lookups.

File format: a Parquet folder with one row for each block of whole documents, in ascending doc_id order (files,
rows and documents within a row).  A block's bytes are the magic ``QTID``, four little-endian uint32 (documents, ids,
data bytes, distinct ids), the documents' id counts, the distinct ids by rank (uint32 each), the control bytes, and the
data bytes.  A block can be read without any other.  Parquet carries the bytes so that any store Spark can write to
will do and a task that is run again replaces its own output.
"""

from __future__ import annotations

import os
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, wordhash

MAGIC = b"QTID"
BLOCK_IDS = 1 << 18
_SLOTS = 1 << 20
_POOL = 1 << 22

#: White space in Unicode (fixed values).
_BLANK = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


@lru_cache(1)
def _kinds() -> np.ndarray:
    """The kind of every code point."""
    first = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[list(_BLANK)] = SPACE
    return out


def pretoken_starts(points: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each code point; ``doc`` marks the first code point of each document.

    A run of letters, of numbers, or of other signs is a pre-token, together with one plain space before it.  Of a
    run of white space before such a run, the last character stands alone unless it is that plain space.  A lone
    apostrophe without such a space takes s, t, m, d, re, ve or ll that follows it.
    """
    n = len(points)
    kind = _kinds()[points]
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new |= doc
    last = np.ones(n, bool)  # the last of its run
    last[:-1] = new[1:]
    inner = np.ones(n, bool)  # something follows in the same document
    inner[:-1] = ~doc[1:]
    inner[-1:] = False
    start = new.copy()
    # the last blank of a run that a solid run follows starts a pre-token; if it is a plain space, the run joins it
    tail = (kind == SPACE) & last & inner
    start |= tail
    joins = np.flatnonzero(tail & (points == 0x20)) + 1
    start[joins] = False
    quote = np.flatnonzero(start & new & last & inner & (points == 0x27))
    if len(quote):
        def at(k: int) -> np.ndarray:
            """The code point k places on, 0 beyond the document."""
            p = quote + k
            ok = p < n
            p = np.minimum(p, n - 1)
            for step in range(1, k + 1):
                ok &= ~doc[np.minimum(quote + step, n - 1)]
            return np.where(ok, points[p], 0)

        one, two = at(1), at(2)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[quote[short | long] + 1] = False
        for hit, size in ((quote[short], 2), (quote[long & ~short], 3)):
            p = hit + size
            p = p[p < n]
            # the rest of the run of letters is a pre-token of its own; other runs start by themselves
            p = p[kind[p] == LETTER]
            start[p] = True
    return start


class Encoder:
    """Encodes chunks of documents; remembers the ids of pre-tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        self.key = np.zeros(_SLOTS, np.uint64)
        self.at = np.zeros(_SLOTS, np.int64)
        self.n = np.zeros(_SLOTS, np.int32)
        self.pool = np.zeros(_POOL, np.uint32)
        self.used = 0

    def _learn(self, h: np.ndarray, texts: list[str]) -> None:
        got = [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        need = int(size.sum())
        if self.used + need > len(self.pool):
            # a new pool, as ids found earlier in this chunk are still read from the old one
            self.key[:] = 0
            self.used = 0
            self.pool = np.zeros(max(_POOL, need), np.uint32)
        flat = np.fromiter((x for ids in got for x in ids), np.uint32, need)
        self.pool[self.used : self.used + need] = flat
        slot = (h >> np.uint64(44)).astype(np.int64)
        self.key[slot], self.n[slot] = h, size
        self.at[slot] = self.used + np.cumsum(size) - size
        self.used += need

    def encode(self, raw: np.ndarray, off: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each document) of documents i..j-1."""
        lo, hi = int(off[i]), int(off[j])
        b = raw[lo:hi]
        count = np.zeros(j - i, np.int64)
        if not len(b):
            return np.zeros(0, np.uint32), count
        data = b.tobytes()
        if any(s in data for s in self.special):
            # texts with the string of a special token go to the library whole
            parts = [self.lib.encode(data[off[d] - lo : off[d + 1] - lo].decode(), add_special_tokens=False).ids for d in range(i, j)]
            return np.concatenate([np.asarray(p, np.uint32) for p in parts]), np.fromiter(map(len, parts), np.int64, j - i)
        lead = np.flatnonzero((b & 0xC0) != 0x80)
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        doc = np.zeros(len(points), bool)
        begin = np.searchsorted(lead, off[i:j] - lo)
        doc[begin[begin < len(points)]] = True
        first = lead[np.flatnonzero(pretoken_starts(points, doc))]
        stop = np.append(first[1:], len(b))
        up, down = wordhash._pow(len(b) + 1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
        h = wordhash.mix((total[stop] - total[first]) * down[first]) | np.uint64(1)
        owner = np.searchsorted(off[i : j + 1] - lo, first, "right") - 1
        ids, size = self._lookup(h, first, stop, data)
        count[:] = np.bincount(owner, weights=size, minlength=j - i).astype(np.int64)
        return ids, count

    def _lookup(self, h: np.ndarray, first: np.ndarray, stop: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        slot = (h >> np.uint64(44)).astype(np.int64)
        start, size = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        left = np.arange(len(h))
        while len(left):
            hit = self.key[slot[left]] == h[left]
            own = left[hit]
            if len(own):
                size[own] = self.n[slot[own]]
                start[own] = self.at[slot[own]]
                out.append((own, start[own], self.pool))
            left = left[~hit]
            if len(left):
                _, pick = np.unique(h[left], return_index=True)
                pick = left[pick]
                # of those that fall into one slot, one is learned at a time
                _, lone = np.unique(slot[pick], return_index=True)
                pick = pick[lone]
                self._learn(h[pick], [data[a:z].decode() for a, z in zip(first[pick].tolist(), stop[pick].tolist(), strict=True)])
        begin = np.cumsum(size) - size
        ids = np.empty(int(size.sum()), np.uint32)
        for own, src, pool in out:
            n = size[own]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            ids[np.repeat(begin[own], n) + step] = pool[np.repeat(src, n) + step]
        return ids, size


_BYTE = np.random.default_rng(4242).integers(1, 1 << 63, 256, dtype=np.uint64)


def _encoder(path: str) -> Encoder:
    """The worker's encoder, with what it has learned in earlier tasks."""
    at, encoder = shared.KEPT.get("tokenids", (None, None))
    if at != path:
        encoder = Encoder(path)
        shared.KEPT["tokenids"] = (path, encoder)
    return encoder


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of uint32 values: two bits a value tell its bytes less one."""
    n = len(values)
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    code = np.zeros(-(-n // 4) * 4, np.uint8)
    code[:n] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = values.astype("<u4").view(np.uint8).reshape(n, 4)
    return control.astype(np.uint8).tobytes(), data[np.arange(4)[None, :] < size[:, None]].tobytes()


_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])[None, :]) & 3).astype(np.uint8) + 1


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The uint32 values of ``pack``'s bytes: lengths come from a table of the 256 control bytes."""
    size = _LENGTHS[control].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4)[None, :] < size[:, None]] = data[: int(size.sum(dtype=np.int64))]
    return out.view("<u4").reshape(-1)


def encode_block(docs: list[np.ndarray]) -> bytes:
    """The bytes of a block that holds the documents' ids."""
    flat = np.concatenate(docs)
    count = np.bincount(flat)
    used = np.flatnonzero(count)
    id_of = used[np.lexsort((used, -count[used]))]
    rank_of = np.zeros(len(count), np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    control, data = pack(rank_of[flat])
    head = np.array([len(docs), len(flat), len(data), len(id_of)], "<u4").tobytes()
    return MAGIC + head + np.fromiter(map(len, docs), "<u4", len(docs)).tobytes() + id_of.astype("<u4").tobytes() + control + data


def decode_block(block: bytes) -> list[np.ndarray]:
    """The documents' ids of one block."""
    if block[:4] != MAGIC:
        raise ValueError("not a token-id block")
    n_docs, n_ids, n_data, n_used = np.frombuffer(block, "<u4", 4, 4).tolist()
    counts = np.frombuffer(block, "<u4", n_docs, 20).astype(np.int64)
    at = 20 + 4 * n_docs
    id_of = np.frombuffer(block, "<u4", n_used, at)
    at += 4 * n_used
    control = np.frombuffer(block, np.uint8, -(-n_ids // 4), at)
    data = np.frombuffer(block, np.uint8, n_data, at + len(control))
    if counts.sum() != n_ids or len(control) + len(data) + at != len(block):
        raise ValueError("damaged token-id block")
    return np.split(id_of[unpack(control, data, n_ids)], np.cumsum(counts)[:-1])


_BLOCK = "part int, block int, at long, n_ids long, doc_ids array<long>, bytes binary"


def _blocks(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = _encoder(path)
        part, block, at = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, at, docs, held, size
            row = {"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "at": pa.array([at], pa.int64()), "n_ids": pa.array([size], pa.int64())}
            out = pa.record_batch(row | {"doc_ids": pa.array([docs], pa.list_(pa.int64())), "bytes": pa.array([encode_block(held)], pa.binary())})
            block, at = block + 1, at + size
            docs, held, size = [], [], 0
            return out

        for batch in batches:
            raw, off = wordhash.utf8(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for i, j in wordhash.chunks(off):
                flat, n = enc.encode(raw, off, i, j)
                for doc_id, own in zip(ids[i:j], np.split(flat, np.cumsum(n)[:-1]), strict=True):
                    docs.append(doc_id)
                    held.append(np.append(own, np.uint32(end)))
                    size += len(own) + 1
                    if size >= BLOCK_IDS:
                        yield flush()
        if docs:
            yield flush()

    return run


def _read_blocks(offset: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at, doc_ids, block in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "doc_ids")), batch.column("bytes"), strict=True):
                docs = [d.astype("<u4").tobytes() for d in decode_block(block.as_buffer().to_pybytes())]
                n = np.fromiter(map(len, docs), np.int64, len(docs)) // 4
                yield pa.record_batch(
                    {
                        "doc_id": pa.array(doc_ids, pa.int64()),
                        "start": pa.array(offset[part] + at + np.cumsum(n) - n),
                        "n_tokens": pa.array(n),
                        "ids": pa.array(docs, pa.binary()),
                        "ids_crc32": pa.array([zlib.crc32(d) for d in docs], pa.int64()),
                    }
                )

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int = 0) -> None:
    """Encodes ``docs`` (doc_id, text) and writes them in the file format to the folder ``path``.

    A null or empty text has only the end id.  Rows with a null doc_id come first; rows that repeat a doc_id follow
    each other in the order of a hash of their texts, so that an id that very many rows repeat, or a null, is no task of
    its own; rows that agree in both are written one after the other.  An empty table gives an empty folder.  Other
    columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    placed = docs.repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
    with shared.small_batches(docs.sparkSession):
        shared.map_arrow(placed, _blocks(tokenizer, end), _BLOCK, keeps="tokenids").write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids, ids_crc32) of each document in the folder ``path``; start counts the ids of all
    documents before it, ids are little-endian uint32, ids_crc32 is their unsigned CRC-32."""
    blocks = spark.read.schema(_BLOCK).parquet(path)
    # one row for each partition of the writing job
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    before, offset = 0, {}
    for p, n in sorted((r.part, r.n) for r in parts):
        offset[p], before = before, before + n
    return shared.map_arrow(blocks.select("part", "at", "doc_ids", "bytes"), _read_blocks(offset), "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")
