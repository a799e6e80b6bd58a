"""Media columns: payloads stored as lossless WebP images, read back, and described by features.

A payload is a row of bytes, a multiple of 192 long: rows of 192 grey samples.  It is stored as a chain of WebP files of
at most ``ROWS`` rows each, one after the other; each tells its own length, so the chain needs no index.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, webp, wordhash

UNIT = 192
ROWS = 32
GROUP = 1 << 20


def padded(text: bytes) -> bytes:
    """``text`` with spaces up to a positive multiple of UNIT bytes."""
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def store(payloads: list[bytes], used: dict[str, int] | None = None) -> list[bytes]:
    """The chain of images that holds each payload.  ``used`` counts the images by the encoder's features."""
    parts = [[np.frombuffer(p, np.uint8, min(ROWS * UNIT, len(p) - i), i) for i in range(0, len(p), ROWS * UNIT)] for p in payloads]
    files = iter(webp.encode_grey([x for own in parts for x in own], UNIT, used))
    return [b"".join(next(files) for _ in own) for own in parts]


def links(media: bytes) -> list[bytes]:
    """The files of a chain."""
    out, at = [], 0
    while at < len(media):
        n = 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at : at + n])
        at += n
    return out


def pixels(media: list[bytes]) -> list[np.ndarray]:
    """The pixel array (rows, 192, RGBA) of each chain."""
    chains = [links(m) for m in media]
    flat = webp.decode_many([x for c in chains for x in c])
    out, at = [], 0
    for c in chains:
        out.append(np.concatenate(flat[at : at + len(c)]) if len(c) != 1 else flat[at])
        at += len(c)
    return out


def payload(image: np.ndarray) -> bytes:
    """The bytes that a picture holds."""
    return image[..., 1].tobytes()


def feature(image: np.ndarray) -> str:
    """Mean and deviation (three decimals) and a 64-bit average hash of the samples in eight by eight areas."""
    grey = image[..., 1]
    edge = np.arange(8) * len(grey) // 8
    columns = grey.reshape(len(grey), 8, UNIT // 8).mean(axis=2)
    total = np.concatenate([[np.zeros(8)], np.cumsum(columns, axis=0)])
    stop = np.maximum(np.append(edge[1:], len(grey)), edge + 1)
    cells = (total[stop] - total[edge]) / (stop - edge)[:, None]
    bits = np.packbits((cells > cells.mean()).reshape(-1)).tobytes().hex()
    return f"{grey.mean():.3f},{grey.std():.3f}:{bits}"


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = wordhash.utf8(batch.column("text"))
        for i, j in wordhash.chunks(off):
            texts = [raw[off[d] : off[d + 1]].tobytes() for d in range(i, j)]
            yield pa.record_batch({"doc_id": batch.column("doc_id").slice(i, j - i), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "media": pa.array(store([padded(t) for t in texts]), pa.binary())})


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold about GROUP bytes of media, as many images are decoded side by side."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= GROUP:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _grouped(batches):
        raw, off = wordhash.utf8(batch.column("media"))
        for i, j in wordhash.chunks(off, GROUP):
            media = [raw[off[d] : off[d + 1]].tobytes() for d in range(i, j)]
            images = pixels(media)
            bytes_ = [payload(im) for im in images]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").slice(i, j - i),
                    "n_bytes": batch.column("n_bytes").slice(i, j - i),
                    "payload_bytes": pa.array([len(b) for b in bytes_], pa.int64()),
                    "payload_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in bytes_]),
                    "tail_crc32": pa.array([zlib.crc32(b[-16:]) for b in bytes_], pa.int64()),
                    "media_bytes": pa.array([len(m) for m in media], pa.int64()),
                    "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    "feature": pa.array([feature(im) for im in images]),
                }
            )


def write_media(docs: DataFrame, path: str) -> None:
    """Stores each text of ``docs`` (doc_id, text; a null is empty) as media (doc_id, n_bytes, media) in ``path``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared.map_arrow(docs, _encoded, "doc_id long, n_bytes long, media binary").write.parquet(path)


def describe_media(stored: DataFrame) -> DataFrame:
    """Decodes (doc_id, n_bytes, media) and describes payload, stored form and picture; a row for each row."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return shared.map_arrow(stored, _described, schema)


def media_report(docs: DataFrame) -> DataFrame:
    """Stores every text and describes what is read back.  Rows with a null doc_id and repeated rows are stored like
    others; very long texts are chains of many images; equal texts, and so ties, have equal media; an empty table gives
    no rows."""
    spark = docs.sparkSession
    path = shared.new_path(spark, "media")
    with shared.small_batches(spark):
        write_media(docs, path)
    out = shared.written(describe_media(spark.read.schema("doc_id long, n_bytes long, media binary").parquet(path)), "media-report")
    shared.remove(spark, path)
    return out
