import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import shared, tokenids, wordhash
from quarry.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def encoder():
    return tokenids.Encoder(tokenizer_path())


def encode(encoder, texts, chunk=1 << 20):
    raw, off = wordhash.utf8(pa.array(texts, pa.string()))
    out = []
    for i, j in wordhash.chunks(off, chunk):
        ids, n = encoder.encode(raw, off, i, j)
        out += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    return out


def library(encoder, texts):
    return [encoder.lib.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_ids_are_the_library_s(encoder):
    rng = random.Random(1)
    parts = ["a", "b", "é", "ß", "漢", "1", "٣", " ", "  ", "\n", "\t", "\u00a0", "'", "'s", "'re", "'ll", "'ve", "'m", "!", "$$", "_", "🙂", "\u0301", "T", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts[:-1]) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    texts += ["".join(rng.choice(parts) for _ in range(12)) for _ in range(50)] + ["", None, " ", "'", "'s", "x's", "''s", " 's"]
    assert encode(encoder, texts) == library(encoder, texts)
    assert encode(encoder, texts, 64) == library(encoder, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text(texts):
    enc = tokenids._encoder(tokenizer_path())
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    # letters and numbers are classed by this Python's Unicode version, which may know characters the library does not
    texts = ["".join(c for c in t if ord(c) < 0x3000) for t in texts]
    assert encode(enc, texts) == library(enc, texts)


def test_a_full_memory_is_emptied(encoder):
    encoder.pool, encoder.used = np.zeros(8, np.uint32), 0
    encoder.key[:] = 0
    texts = [f"word{i} other{i}" for i in range(50)]
    assert encode(encoder, texts, 100) == library(encoder, texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_packing_round_trip(values):
    v = np.array(values, np.uint32)
    control, data = tokenids.pack(v)
    assert tokenids.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(v)).tolist() == values


def test_block_round_trip_and_damage():
    docs = [np.array([5, 5, 70000, 1]), np.array([0]), np.arange(600)]
    block = tokenids.encode_block([d.astype(np.uint32) for d in docs])
    assert [d.tolist() for d in tokenids.decode_block(block)] == [d.tolist() for d in docs]
    for bad in (b"XXXX" + block[4:], block[:-1], block + b"\0"):
        with pytest.raises(ValueError):
            tokenids.decode_block(bad)


def test_files(spark, odd, odd_rows, encoder, monkeypatch):
    path = shared.new_path(spark, "ids")
    tokenids.write_ids(odd, path, tokenizer_path())
    got = tokenids.read_ids(spark, path).collect()
    texts = spark.createDataFrame([(t,) for t in {r[1] or "" for r in odd_rows}], "t string")
    place = {r.t: r.h for r in texts.selectExpr("t", "xxhash64(t) AS h").collect()}
    rows = sorted(((d is not None, d or 0, place[t or ""]), d, t or "") for d, t, *_ in odd_rows)
    at = 0
    for r, (_, d, t) in zip(sorted(got, key=lambda r: r.start), rows, strict=True):
        ids = np.array([*library(encoder, [t])[0], 0], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids), r.ids_crc32) == (d, at, len(ids) // 4, ids, zlib.crc32(ids))
        at += r.n_tokens


def test_no_rows(spark, none):
    path = shared.new_path(spark, "ids")
    tokenids.write_ids(none, path, tokenizer_path())
    assert tokenids.read_ids(spark, path).count() == 0
