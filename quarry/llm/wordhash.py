"""Vectorised word and shingle hashing over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, after A-Z have been lower-cased.  Whole texts are
hashed straight from the Arrow buffers: each word gets the polynomial sum of random byte values, read off one
wrapping prefix sum, so no Python object is made for a word.  Texts are taken in chunks of whole documents so that
temporary arrays stay near ``CHUNK`` bytes of text (one longer document makes a chunk of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SEED = 20240229

_bytes = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE = _bytes.copy()
_VALUE[65:91] = _bytes[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For words of letters and digits: every other ASCII sign parts them too.
_SIGN = _SPACE.copy()
_SIGN[[c for c in range(128) if not chr(c).isalnum()]] = True
_powers = {"n": 0, "up": np.ones(0, np.uint64), "down": np.ones(0, np.uint64)}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, mod 2**64."""
    if _powers["n"] < n:
        size = max(n, CHUNK + 1)
        for key, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def chunks(off: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def words(raw: np.ndarray, off: np.ndarray, i: int, j: int, signs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents i..j-1: (hash of each word, first byte, byte after the last, first word of each document and the end).
    signs: words are runs of letters and digits, parted by all other ASCII characters."""
    lo, hi = int(off[i]), int(off[j])
    b = raw[lo:hi]
    n = len(b)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(j - i + 1, np.int64)
    solid = ~(_SIGN if signs else _SPACE)[b]
    cut = np.zeros(n + 1, bool)  # a document starts here
    cut[off[i : j + 1] - lo] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | cut[1:])) + 1
    up, down = _pow(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[b] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start])
    return h, start + lo, end + lo, np.searchsorted(start, off[i : j + 1] - lo).astype(np.int64)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k-word shingles, sorted within each document, and where each document's begin.

    A document of 1 to k-1 words has its whole sequence as one shingle; one without words has none.
    """
    n, docs = len(h), len(first) - 1
    count = np.diff(first)
    s = np.zeros(n, np.uint64)
    room = max(n - k + 1, 0)
    for t in range(k):
        s[:room] = mix(s[:room] + h[t : t + room]) if room else s[:room]
    keep = np.zeros(n, bool)
    full = count >= k
    if n:
        owner = np.repeat(np.arange(docs), count)
        keep = full[owner] & (np.arange(n) < (first[1:] - k + 1)[owner])
    short = np.flatnonzero((count > 0) & ~full)
    for d in short:
        x = np.zeros(1, np.uint64)
        for t in range(int(first[d]), int(first[d + 1])):
            x = mix(x + h[t : t + 1])
        s[first[d]] = mix(x + np.uint64(count[d]))[0]
        keep[first[d]] = True
    s = s[keep]
    made = np.concatenate([[0], np.cumsum(np.where(full, count - k + 1, (count > 0).astype(np.int64)))])
    for d in range(docs):
        s[made[d] : made[d + 1]].sort()
    fresh = np.ones(len(s), bool)
    if len(s):
        fresh[1:] = s[1:] != s[:-1]
        inner = made[:-1]
        fresh[inner[inner < len(s)]] = True
    return s[fresh], np.concatenate([[0], np.cumsum(fresh)])[made]
