"""Lossless WebP: a decoder of the whole format, and an encoder of grey images.

The decoder reads prefix codes (with meta codes), back-references and the colour cache, and inverts the predictor,
cross-colour, subtract-green and palette transforms.  It works a pixel at a time.  Images with one group of prefix
codes, no colour cache and a constant red, blue and alpha, as the encoder here makes them, are decoded many at once
(``decode_many``): step k reads the k-th literal or back-reference of every image with table lookups on arrays, and all
back-references are then followed together.

The encoder (``encode_grey``) takes many images of 8-bit samples at once.  A sample is a pixel of equal red, green and
blue, which subtract-green turns into green alone, or, where an image has few values, a palette that packs several
pixels into one.  Where the differences from the pixel to the left or above are told in fewer bits than the samples, the
predictor transform is used.  Repeated words and runs become back-references.  A colour cache, cross-colour and meta codes would
say nothing of such images that their green does not say already, so the encoder leaves them out.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Order in which the lengths of the code-length code are stored (fixed values of the format).
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Offsets (x, y) of the distance codes 1 to 120 (fixed values of the format).
# fmt: off
DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
# fmt: on
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
_CACHE_MUL = 0x1E35A7BD
FAST_BITS = 10


class BadImage(ValueError):
    """The bytes are not a lossless WebP image."""


class Bits:
    """Reads bits, least significant first; beyond the end come zeros, and ``check`` then raises."""

    def __init__(self, data: bytes):
        self.bytes, self.at, self.n = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        """The next n bits, 57 at most."""
        at = self.at
        lo = at >> 3
        return (int.from_bytes(self.bytes[lo : lo + 8], "little") >> (at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        return v

    def check(self) -> None:
        if self.at > self.n:
            raise BadImage("the data end within the image")


@lru_cache(16)
def _reversed(n: int) -> list[int]:
    """The numbers of n bits with their bits in the other order."""
    out = [0]
    for k in range(n):
        out = [2 * v for v in out] + [2 * v + 1 for v in out] if k else [0, 1]
    return out if n else [0]


#: The numbers of fifteen bits, the most that a code takes, and of FAST_BITS, turned round.
_REVERSED, _FAST_REVERSED = np.array(_reversed(15)), np.array(_reversed(FAST_BITS))


class Code:
    """A canonical prefix code, given the length of each symbol."""

    def __init__(self, lengths: list[int]):
        self.used = sorted([(n, s) for s, n in enumerate(lengths) if n])
        if not self.used:
            raise BadImage("a prefix code without symbols")
        self.single = self.used[0][1] if len(self.used) == 1 else None
        self.most = self.used[-1][0]
        if self.single is None and sum([1 << (15 - n) for n, _ in self.used]) != 1 << 15:
            raise BadImage("a prefix code that is not complete")
        self._table: list[tuple[int, int]] | None = None

    def ahead(self) -> list[tuple[int, int]]:
        """For each value of the next ``most`` bits: (length, symbol)."""
        if self._table is None:
            row: list[tuple[int, int]] = []
            for x in self.used:
                row += [x] * (1 << (self.most - x[0]))
            self._table = [row[i] for i in _reversed(self.most)]
        return self._table

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        n, s = self.ahead()[bits.peek(self.most)]
        bits.at += n
        return s


@lru_cache(512)
def _one(symbol: int) -> Code:
    return Code([0] * symbol + [1])


def _read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        if not two and first < size:
            return _one(first)
        symbols = [first, bits.read(8)] if two else [first]
        for s in symbols:
            if s >= size:
                raise BadImage("a symbol beyond the alphabet")
            lengths[s] = 1
        return Code(lengths)
    meta = [0] * 19
    stored = bits.read(4) + 4
    word = bits.read(3 * stored)
    for k in range(stored):
        meta[CODE_LENGTH_ORDER[k]] = word >> 3 * k & 7
    code = Code(meta)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    # a length takes 14 bits at most, its repetition included
    begin = bits.at >> 3
    word = int.from_bytes(bits.bytes[begin : begin + (14 * min(left, size) >> 3) + 2], "little") >> (bits.at & 7)
    table, mask = code.ahead(), (1 << code.most) - 1
    at, before, used = 0, 8, 0
    while at < size and left > 0:
        left -= 1
        if code.single is None:
            n, s = table[word >> used & mask]
            used += n
        else:
            s = code.single
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
            continue
        few = (2, 3, 7)[s - 16]
        n = (11 if s == 18 else 3) + (word >> used & ((1 << few) - 1))
        used += few
        if at + n > size:
            raise BadImage("code lengths beyond the alphabet")
        if s == 16:
            lengths[at : at + n] = [before] * n
        at += n
    bits.at += used
    bits.check()
    return Code(lengths)


def _value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _entropy_image(bits: Bits, w: int, h: int, main: bool) -> list[int]:
    """ARGB values of an image, its transforms not inverted."""
    cache_bits = 0
    if bits.read(1):
        cache_bits = bits.read(4)
        if not 1 <= cache_bits <= 11:
            raise BadImage("a colour cache of a wrong size")
    meta, shift, across, groups = None, 0, 0, 1
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across = -(-w // (1 << shift))
        meta = [(p >> 8) & 0xFFFF for p in _entropy_image(bits, across, -(-h // (1 << shift)), False)]
        groups = max(meta) + 1
    cache = [0] * (1 << cache_bits) if cache_bits else None
    sizes = (280 + (len(cache) if cache else 0), 256, 256, 256, 40)
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    out: list[int] = []
    total = w * h

    def put(p: int) -> None:
        out.append(p)
        if cache is not None:
            cache[(_CACHE_MUL * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p

    while len(out) < total:
        y, x = divmod(len(out), w)
        green, red, blue, alpha, dist = codes[meta[(y >> shift) * across + (x >> shift)]] if meta else codes[0]
        s = green.read(bits)
        if s < 256:
            r, b = red.read(bits), blue.read(bits)
            put(alpha.read(bits) << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            n = _value(bits, s - 256)
            d = _value(bits, dist.read(bits))
            if d > 120:
                d -= 120
            else:
                dx, dy = DISTANCES[d - 1]
                d = max(1, dx + dy * w)
            if d > len(out) or len(out) + n > total:
                raise BadImage("a back-reference beyond the image")
            for _ in range(n):
                put(out[-d])
        else:
            put(cache[s - 280])
        bits.check()
    return out


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """left, top, top right and top left pixels as arrays of four components."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _average(_average(left, right), top)
    if mode == 6:
        return _average(left, corner)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(corner, top)
    if mode == 9:
        return _average(top, right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = _average(left, top)
        return np.clip(mean + ((mean - corner) / 2).astype(np.int64), 0, 255)
    return np.array([255, 0, 0, 0])


def _unpredict(p: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    h, w = p.shape[:2]
    out = p.astype(np.int64)
    black = np.array([255, 0, 0, 0])
    if (modes == 1).all() or (modes == 2).all():
        # sums along the first row and column, then along the rows or columns
        out[0, 0] += black
        out[0] = np.cumsum(out[0], axis=0)
        if modes.flat[0] == 1:
            out[:, 0] = np.cumsum(out[:, 0], axis=0)
            out[1:] = np.cumsum(out[1:], axis=1)
        else:
            out = np.cumsum(out, axis=0)
        return out & 255
    for y in range(h):
        for x in range(w):
            if y == 0:
                guess = black if x == 0 else out[0, x - 1]
            elif x == 0:
                guess = out[y - 1, 0]
            else:
                # to the right of the last column comes the first pixel of the row itself
                right = out[y - 1, x + 1] if x + 1 < w else out[y, 0]
                guess = _predict(int(modes[y >> shift, x >> shift]), out[y, x - 1], out[y - 1, x], right, out[y - 1, x - 1])
            out[y, x] = (out[y, x] + guess) & 255
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x.astype(np.int64) & 255) ^ 128) - 128


def _uncross(p: np.ndarray, blocks: np.ndarray, shift: int) -> np.ndarray:
    h, w = p.shape[:2]
    m = blocks[np.arange(h)[:, None] >> shift, np.arange(w)[None, :] >> shift]
    out = p.astype(np.int64)
    green = _signed(out[..., 2])
    red = (out[..., 1] + (_signed(m[..., 3]) * green >> 5)) & 255
    blue = out[..., 3] + (_signed(m[..., 2]) * green >> 5) + (_signed(m[..., 1]) * _signed(red) >> 5)
    out[..., 1], out[..., 3] = red, blue & 255
    return out


def _planes(pixels: list[int], w: int, h: int) -> np.ndarray:
    """(h, w, 4): alpha, red, green, blue."""
    v = np.array(pixels, np.uint32).reshape(h, w)
    return np.stack([v >> 24, v >> 16 & 255, v >> 8 & 255, v & 255], axis=-1).astype(np.int64)


def _payload(image: bytes) -> bytes:
    """The VP8L chunk of a RIFF file."""
    if len(image) < 20 or image[:4] != b"RIFF" or image[8:12] != b"WEBP":
        raise BadImage("not a WebP file")
    at = 12
    while at + 8 <= len(image):
        kind, size = image[at : at + 4], struct.unpack_from("<I", image, at + 4)[0]
        if kind == b"VP8L":
            return image[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise BadImage("no lossless image in the file")


def _header(bits: Bits) -> tuple[int, int, int, list[tuple]]:
    """(width, height, coded width, transforms as they were applied) of an image."""
    if bits.read(8) != 0x2F:
        raise BadImage("a wrong signature")
    w, h = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise BadImage("an unknown version")
    transforms: list[tuple] = []
    across = w
    while bits.read(1):
        kind = bits.read(2)
        if kind in [t[0] for t in transforms]:
            raise BadImage("a transform occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            bw, bh = -(-across // (1 << shift)), -(-h // (1 << shift))
            transforms.append((kind, shift, _planes(_entropy_image(bits, bw, bh, False), bw, bh), across))
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind, 0, None, across))
        else:
            n = bits.read(8) + 1
            table = np.cumsum(_planes(_entropy_image(bits, n, 1, False), n, 1)[0], axis=0) & 255
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, pack, table, across))
            across = -(-across // (1 << pack))
    return w, h, across, transforms


def _inverted(p: np.ndarray, transforms: list[tuple]) -> np.ndarray:
    """RGBA bytes of the coded planes (alpha, red, green, blue)."""
    for kind, shift, extra, width in reversed(transforms):
        if kind == PREDICTOR:
            p = _unpredict(p, extra[..., 2], shift)
        elif kind == CROSS_COLOUR:
            p = _uncross(p, extra, shift)
        elif kind == SUBTRACT_GREEN:
            p[..., 1] = (p[..., 1] + p[..., 2]) & 255
            p[..., 3] = (p[..., 3] + p[..., 2]) & 255
        else:
            x, each = np.arange(width), 8 >> shift
            index = p[:, x >> shift, 2] >> (each * (x & ((1 << shift) - 1)))[None, :] & ((1 << each) - 1)
            p = np.vstack([extra, np.zeros((256, 4), np.int64)])[index]
    return p[..., [1, 2, 3, 0]].astype(np.uint8)


def decode(image: bytes) -> np.ndarray:
    """The pixels (height, width, RGBA) of a lossless WebP file as an array of bytes."""
    bits = Bits(_payload(image))
    _, h, across, transforms = _header(bits)
    return _inverted(_planes(_entropy_image(bits, across, h, True), across, h), transforms)


# --- the encoder -----------------------------------------------------------------------------------------------------


def code_lengths(count: np.ndarray, most: int) -> np.ndarray:
    """Lengths, ``most`` at the utmost, of a complete prefix code; two symbols at least have a count."""
    used = np.flatnonzero(count)
    out = np.zeros(len(count), np.int64)
    out[used] = _lengths(count[used], most)
    return out


def _lengths(count: np.ndarray, most: int) -> np.ndarray:
    """``code_lengths`` of symbols that all have a count."""
    order = np.argsort(count, kind="stable")
    weight = count[order].tolist()
    n = len(weight)
    while True:
        # leaves ascend, and so do the nodes made of them: the least two stand at the head of either row
        made: list[int] = []
        parent = [0] * (2 * n - 1)
        leaf = node = 0
        for own in range(n, 2 * n - 1):
            if leaf < n and (node >= len(made) or weight[leaf] <= made[node]):
                total = weight[leaf]
                parent[leaf] = own
                leaf += 1
            else:
                total = made[node]
                parent[n + node] = own
                node += 1
            if leaf < n and (node >= len(made) or weight[leaf] <= made[node]):
                made.append(total + weight[leaf])
                parent[leaf] = own
                leaf += 1
            else:
                made.append(total + made[node])
                parent[n + node] = own
                node += 1
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if depth[0] <= most:
            out = np.empty(n, np.int64)
            out[order] = depth[:n]
            return out
        weight = [(c + 1) >> 1 for c in weight]


def _codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol with its bits in reading order."""
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    out[used] = _in_order(lengths[used])
    return out


def _in_order(lengths: np.ndarray) -> np.ndarray:
    """``_codes`` of symbols that all have a length."""
    order = np.argsort(lengths, kind="stable")
    n = lengths[order]
    step = 1 << (15 - n)
    out = np.empty(len(n), np.int64)
    out[order] = _REVERSED[(np.cumsum(step) - step) >> (15 - n)] >> (15 - n)
    return out


class _Writer:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, v: int, n: int) -> None:
        self.value |= int(v) << self.n
        self.n += n


def _zeros(n: int) -> list[tuple[int, int, int]]:
    """Tokens of a run of n lengths of 0."""
    out = [(18, 127, 7)] * (n // 138)
    n %= 138
    return out + ([(18, n - 11, 7)] if n >= 11 else [(17, n - 3, 3)] if n >= 3 else [(0, 0, 0)] * n)


#: The code of code lengths that the encoder uses for all its codes: lengths by symbol.
_META = {0: 5, 1: 4, 2: 5, 3: 4, 4: 4, 5: 3, 6: 3, 7: 3, 8: 3, 9: 4, 10: 4, 17: 4, 18: 4}
_META_CODE = dict(zip(_META, _in_order(np.array(list(_META.values()))).tolist(), strict=True))
_META_KEPT = max(k for k, s in enumerate(CODE_LENGTH_ORDER) if s in _META) + 1
_META_HEAD = (_META_KEPT - 4) << 1 | sum(_META.get(s, 0) << (5 + 3 * k) for k, s in enumerate(CODE_LENGTH_ORDER[:_META_KEPT]))
_RUN = {n: _zeros(n) for n in range(1, 280)}


def _put_code(out: _Writer, used: np.ndarray, lengths: np.ndarray) -> None:
    """A prefix code by its symbols (two at least) and their lengths, zeros in runs."""
    value, at, n_tokens, before = 0, 0, 0, -1
    for s, n in zip(used.tolist(), lengths.tolist(), strict=True):
        if s > before + 1:
            for t, extra, few in _RUN[s - before - 1]:
                value |= (_META_CODE[t] | extra << _META[t]) << at
                at += _META[t] + few
                n_tokens += 1
        value |= _META_CODE[n] << at
        at += _META[n]
        n_tokens += 1
        before = s
    wide = 3 if n_tokens < 258 else 4  # eight bits or ten for the number of tokens
    out.put(_META_HEAD, 5 + 3 * _META_KEPT)
    out.put(1 | wide << 1 | (n_tokens - 2) << 4, 6 + 2 * wide)
    out.put(value, at)


def _prefixes(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each value up to ``most``: its prefix symbol, the number of extra bits, and these."""
    v = np.maximum(np.arange(most + 1) - 1, 0)
    top = np.frexp(np.maximum(v, 1))[1] - 1
    few = np.maximum(top - 1, 0)
    high = v >> few & 1
    symbol = np.where(v < 4, v, 2 * top + high)
    bits = np.where(v < 4, 0, few)
    return symbol, bits, np.where(v < 4, 0, v & ((1 << few) - 1))


#: Shortest and longest back-reference, and the samples that an image may have.
LEAST, MOST = 4, 4096
PIXELS = 1 << 16
_SYMBOL, _EXTRA, _REST = _prefixes(PIXELS + 120)


@lru_cache(16)
def _near(width: int) -> np.ndarray:
    """The distance code of each distance up to PIXELS."""
    code = np.arange(PIXELS + 1) + 120
    for k in range(len(DISTANCES) - 1, -1, -1):
        d = DISTANCES[k][0] + DISTANCES[k][1] * width
        if 1 <= d <= PIXELS:
            code[d] = k + 1
    return code


_HASH = np.uint64(0x9E3779B97F4A7C15)
_BYTE_ENDS = [np.uint64((1 << 8 * k) - 1) for k in range(1, 8)]


def _eights(x: np.ndarray) -> np.ndarray:
    """At each byte the eight from there on as one number; zeros follow the end."""
    n = len(x)
    wide = np.zeros((n + 31) // 8 * 8, np.uint8)
    wide[:n] = x
    out = np.empty(len(wide) - 8, "<u8")
    for k in range(8):
        own = wide[k : k + (len(wide) - 8 - k + 7) // 8 * 8].view("<u8")
        out[k::8] = own[: len(out[k::8])]
    return out



def _matches(x: np.ndarray, image: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, distance), places ascending, of matches of LEAST samples or more within an image: from a blank on
    with the last blank that the same samples follow, and from the second sample of a run on with the first.  ``stop`` is
    the end of each sample's image.  Words repeat more often than parts of words, so little is lost by that choice."""
    n = len(x)
    eight = _eights(x)
    blank = np.flatnonzero((x == 0x20) | (x == 0x0A))
    # sorted by a hash of the image and the samples, and then by place, in one number
    four = (image[blank].astype(np.uint64) << np.uint64(32)) | (eight[blank] & np.uint64(0xFFFFFFFF))
    key = np.sort((four * _HASH & ~np.uint64(0xFFFFFFFF)) | np.arange(len(blank), dtype=np.uint64))
    same = np.flatnonzero((key[1:] ^ key[:-1]) >> np.uint64(32) == 0)
    here, there = (key[same + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64), (key[same] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ok = four[here] == four[there]
    back = np.zeros(n, np.int64)
    back[blank[here[ok]]] = blank[here[ok]] - blank[there[ok]]
    equal = np.zeros(n + LEAST, bool)
    equal[1:n] = (x[1:] == x[:-1]) & (image[1:] == image[:-1])
    run = equal[:n] & ~np.concatenate([[False], equal[: n - 1]])
    for k in range(1, LEAST):
        run &= equal[k : n + k]
    back[run] = 1
    at = np.flatnonzero(back)
    at = at[stop[at] - at >= LEAST]
    was = at - back[at]
    room = np.minimum(stop[at] - at, MOST)
    length = np.full(len(at), LEAST)
    live, a, p = np.arange(len(at)), at + LEAST, was + LEAST
    while len(live):
        differ = eight[a] ^ eight[p]
        # the first byte that differs, by the lowest bit that is set
        low = differ & (~differ + np.uint64(1))
        equal = (low > _BYTE_ENDS[0]).astype(np.int64)
        for end in _BYTE_ENDS[1:]:
            equal += low > end
        whole = differ == 0
        equal[whole] = 8
        length[live] += equal
        whole &= length[live] < room[live]
        live, a, p = live[whole], a[whole] + 8, p[whole] + 8
    return at, np.minimum(length, room), at - was


def _tokens(x: np.ndarray, bounds: np.ndarray, width: int):
    """A greedy parse of the images that ``bounds`` parts: of each literal or back-reference its image and green symbol;
    and which of them are back-references, with the length's extra bits and their number, the distance's symbol, its
    extra bits and their number."""
    image = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at, n, back = _matches(x, image, bounds[1:][image])
    # from a match on to the first one that begins at its end or later
    before = np.zeros(len(x) + 1, np.int64)
    before[at + 1] = 1
    further = np.cumsum(before)[at + n].tolist()
    taken, k, end = [], 0, len(further)
    while k < end:
        taken.append(k)
        k = further[k]
    at, n, back = at[taken], n[taken], back[taken]
    inner = np.zeros(len(x) + 1, np.int8)
    inner[at + 1] += 1
    inner[at + n] -= 1
    places = np.flatnonzero(np.cumsum(inner[:-1], dtype=np.int8) == 0)
    far = np.searchsorted(places, at)
    green = x[places].astype(np.int64)
    green[far] = 256 + _SYMBOL[n]
    code = _near(width)[back]
    return image[places], green, far, _REST[n], _EXTRA[n], _SYMBOL[code], _REST[code], _EXTRA[code]


def _put_single(out: _Writer, symbol: int) -> None:
    """A code of one symbol, which takes no bits."""
    out.put(0b1 | 0 << 1 | (symbol > 1) << 2, 3)
    out.put(symbol, 8 if symbol > 1 else 1)


def _fitted(out: _Writer, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stores a code that fits ``count``; (lengths, codes)."""
    lengths, codes = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
    used = np.flatnonzero(count)
    if len(used) < 2 and (not len(used) or used[0] < 256):
        _put_single(out, int(used[0]) if len(used) else 0)
        return lengths, codes
    if len(used) < 2:
        used = np.array([0, used[0]])
    n = _lengths(np.maximum(count[used], 1), FAST_BITS)
    _put_code(out, used, n)
    lengths[used], codes[used] = n, _in_order(n)
    return lengths, codes


def _entropy(count: np.ndarray) -> np.ndarray:
    """Bits that symbols of these counts take at least, by row."""
    total = count.sum(axis=1)
    return total * np.log2(np.maximum(total, 1)) - (count * np.log2(np.maximum(count, 1))).sum(axis=1)


def _residuals(x: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Differences from the pixel to the left, and above: the first row has those from the left, the first column those
    from above, the first pixel is told whole."""
    rows, first = x.reshape(-1, width), bounds[:-1] // width
    left = rows.copy()
    left[:, 1:] -= rows[:, :-1]
    left[1:, 0] -= rows[:-1, 0]
    left[first, 0] = rows[first, 0]
    top = rows.copy()
    top[1:] -= rows[:-1]
    top[first] = left[first]
    return left.reshape(-1), top.reshape(-1)


#: Bits that a predictor must save before it is used, and values up to which pixels are packed.
WORTH, FEW = 200, 16


def encode_grey(images: list[np.ndarray], width: int, used: dict[str, int] | None = None) -> list[bytes]:
    """Lossless WebP files of images of 8-bit samples, rows of ``width``.  ``used`` counts the images by feature."""
    if not images:
        return []
    sizes = np.array([len(i) for i in images])
    if (sizes % width).any() or not sizes.all() or sizes.max() > PIXELS:
        raise ValueError(f"an image has rows of {width} samples, and {PIXELS} samples at most")
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    x = np.concatenate(images).astype(np.uint8)
    image = np.repeat(np.arange(len(images)), sizes)
    count = np.bincount(image * 256 + x, minlength=256 * len(images)).reshape(-1, 256)
    values = (count > 0).sum(axis=1)
    bits = [_entropy(count)]
    rest = [x, *_residuals(x, bounds, width)]
    bits += [_entropy(np.bincount(image * 256 + r, minlength=256 * len(images)).reshape(-1, 256)) + WORTH for r in rest[1:]]
    mode = np.where(values <= FEW, 0, np.argmin(np.stack(bits), axis=0))
    heads, parts = [], []
    for k in range(len(images)):
        head = _Writer()
        head.put(0x2F, 8)
        head.put(width - 1, 14)
        head.put(sizes[k] // width - 1, 14)
        head.put(0, 1 + 3)  # no alpha, version 0
        if values[k] <= FEW:
            table = np.flatnonzero(count[k])
            head.put(1 | PALETTE << 1, 3)
            head.put(len(table) - 1, 8)
            head.put(0, 1)  # the palette's image: grey differences, no cache
            _palette_image(head, np.diff(table, prepend=0))
            parts.append(_packed(np.searchsorted(table, x[bounds[k] : bounds[k + 1]]), width, len(table)))
        else:
            head.put(1 | SUBTRACT_GREEN << 1, 3)
            if mode[k]:
                head.put(1 | PREDICTOR << 1, 3)
                # blocks as large as can be, one mode for all
                head.put(7, 3)
                head.put(0, 1)
                for symbol in (mode[k], 0, 0, 0, 0):
                    _put_single(head, int(symbol))
            parts.append(rest[mode[k]][bounds[k] : bounds[k + 1]])
        head.put(0, 1 + 1 + 1)  # no further transform, no colour cache, no meta code
        heads.append(head)
    coded = np.array([len(p) for p in parts])
    across = coded // (sizes // width)
    out: list[bytes | None] = [None] * len(images)
    for w in np.unique(across):
        which = np.flatnonzero(across == w)
        for k, file in zip(which, _coded([heads[k] for k in which], [parts[k] for k in which], int(w), [bool(values[k] > FEW and not mode[k]) for k in which]), strict=True):
            out[k] = file
    if used is not None:
        for name, n in (("palette", (values <= FEW).sum()), ("subtract_green", (values > FEW).sum()), ("predictor_left", (mode == 1).sum()), ("predictor_top", (mode == 2).sum())):
            used[name] = used.get(name, 0) + int(n)
    return out


def _palette_image(out: _Writer, delta: np.ndarray) -> None:
    """The palette's differences, literals of equal red, green and blue."""
    lengths, codes = _fitted(out, np.bincount(delta, minlength=280))
    for _ in range(2):
        _fitted(out, np.bincount(delta, minlength=256))
    # alpha: 255, then differences of 0
    alpha = np.zeros(256, np.int64)
    alpha[255], alpha[0] = 1, len(delta) - 1
    lengths_a, codes_a = _fitted(out, alpha)
    _put_single(out, 0)
    for i, d in enumerate(delta.tolist()):
        for _ in range(3):
            out.put(codes[d], int(lengths[d]))
        a = 0 if i else 255
        out.put(codes_a[a], int(lengths_a[a]))


def _packed(index: np.ndarray, width: int, colours: int) -> np.ndarray:
    """Palette indices, as many in a byte as there is room for."""
    pack = 3 if colours <= 2 else 2 if colours <= 4 else 1
    each, per = 8 >> pack, 1 << pack
    across = -(-width // per)
    rows = np.zeros((len(index) // width, across * per), np.int64)
    rows[:, :width] = index.reshape(-1, width)
    return (rows.reshape(len(rows), across, per) << (each * np.arange(per))).sum(axis=2).reshape(-1).astype(np.uint8)


def _coded(heads: list[_Writer], parts: list[np.ndarray], width: int, alpha: list[bool]) -> list[bytes]:
    """The files: each head followed by the codes and the tokens of its green plane.  All tokens are laid into one array
    of 64-bit words, in which every file begins at a word."""
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    own, green, far, rest, extra, dist, rest_d, extra_d = _tokens(np.concatenate(parts), bounds, width)
    n = len(parts)
    count = np.bincount(own * 280 + green, minlength=280 * n).reshape(n, 280)
    count_d = np.bincount(own[far] * 40 + dist, minlength=40 * n).reshape(n, 40)
    lengths, codes, lengths_d, codes_d = (np.zeros((n, m), np.int64) for m in (280, 280, 40, 40))
    for k, head in enumerate(heads):
        lengths[k], codes[k] = _fitted(head, count[k])
        _put_single(head, 0)
        _put_single(head, 0)
        _put_single(head, 255 if alpha[k] else 0)  # differences and indices have none
        lengths_d[k], codes_d[k] = _fitted(head, count_d[k])
    cell = own * 280 + green
    value, size = codes.reshape(-1)[cell], lengths.reshape(-1)[cell]
    # a back-reference goes on with the length's bits, the distance and the distance's bits
    cell = own[far] * 40 + dist
    v, z = value[far] | rest << size[far], size[far] + extra
    v, z = v | codes_d.reshape(-1)[cell] << z, z + lengths_d.reshape(-1)[cell]
    value[far], size[far] = v | rest_d << z, z + extra_d
    total = np.bincount(own, weights=size, minlength=n).astype(np.int64) + np.array([h.n for h in heads])
    base = np.concatenate([[0], np.cumsum(-(-total // 64) + 1)])
    before = np.cumsum(size) - size
    first = np.searchsorted(own, np.arange(n))
    at = base[own] * 64 + np.array([h.n for h in heads])[own] + before - before[first][own]
    words = np.zeros(int(base[-1]) + 1, np.uint64)
    for k, head in enumerate(heads):
        raw = np.frombuffer(head.value.to_bytes(-(-head.n // 64) * 8, "little"), "<u8")
        words[base[k] : base[k] + len(raw)] |= raw
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    value = value.astype(np.uint64)
    low, high = value << shift, (value >> np.uint64(1)) >> (np.uint64(63) - shift)
    start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[start]] |= np.bitwise_or.reduceat(low, start)
    words[word[start] + 1] |= np.bitwise_or.reduceat(high, start)
    raw = words.astype("<u8").tobytes()
    out = []
    for k in range(n):
        body = raw[8 * base[k] : 8 * base[k] + -(-int(total[k]) // 8)]
        pad = b"\0" * (len(body) & 1)
        out.append(b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad)
    return out


# --- many images at once ---------------------------------------------------------------------------------------------


@dataclass
class _Lane:
    """What stands before the pixels of an image of one varying channel: ``across`` pixels a row are coded, from bit
    ``at`` of the chunk on."""

    width: int
    height: int
    across: int
    transforms: list[tuple]
    at: int
    green: Code
    dist: Code
    rest: tuple[int, int, int]  # red, blue, alpha


def _lane(chunk: bytes) -> _Lane | None:
    """None for an image that only ``decode`` can read."""
    bits = Bits(chunk)
    w, h, across, transforms = _header(bits)
    if bits.read(1) or bits.read(1):
        return None
    green, red, blue, alpha, dist = (_read_code(bits, n) for n in (280, 256, 256, 256, 40))
    bits.check()
    if any(c.single is None for c in (red, blue, alpha)) or max(green.most, dist.most) > FAST_BITS:
        return None
    if any(t[0] == CROSS_COLOUR or t[0] == PREDICTOR and len(np.unique(t[2][..., 2])) > 1 for t in transforms):
        return None
    return _Lane(w, h, across, transforms, bits.at, green, dist, (red.single, blue.single, alpha.single))


def _fast_table(code: Code, told: np.ndarray) -> np.ndarray:
    """For each FAST_BITS bits ahead: ``told`` of the symbol, with the number of bits that it takes in the lowest four."""
    if code.single is not None:
        return np.full(1 << FAST_BITS, told[code.single])
    n, s = np.array(code.used).T
    return np.repeat(told[s] | n, 1 << (FAST_BITS - n))[_FAST_REVERSED]


_DX, _DY = np.array(DISTANCES).T
_STEP = np.arange(40)
_FEW = np.where(_STEP < 4, 0, (_STEP - 2) >> 1)
_BASE = np.where(_STEP < 4, _STEP + 1, ((2 + (_STEP & 1)) << _FEW) + 1)
#: By green symbol, from bit 4 on: its extra bits (4), whether it is a length (1), the literal or the least length.
_GREEN = np.concatenate([np.arange(256) << 9, _FEW[:24] << 4 | 1 << 8 | _BASE[:24] << 9])
#: By distance symbol: its extra bits (4), the least distance code.
_FAR = _FEW << 4 | _BASE << 8


def _greens(lanes: list[_Lane], chunks: list[bytes]) -> list[np.ndarray]:
    """The coded green plane of each image, flat.

    First all lanes are read side by side into literals and back-references; then every pixel points at the one that it
    repeats, and pointers are doubled until all end at literals.
    """
    total = np.array([c.across * c.height for c in lanes])
    data = np.frombuffer(b"".join(c + bytes(8) for c in chunks) + bytes(512), np.uint8)
    begin = np.cumsum([0] + [len(c) + 8 for c in chunks[:-1]]) * 8
    limit = begin + np.array([8 * len(c) for c in chunks])
    pos = begin + np.array([c.at for c in lanes])
    # as signed numbers, so that all arrays are of one type: of the bits ahead only the lower 52 are looked at
    ahead = _eights(data).view(np.int64)
    table = np.concatenate([t for lane in lanes for t in (_fast_table(lane.green, _GREEN), _fast_table(lane.dist, _FAR))])
    where = np.arange(len(lanes)) * 2 << FAST_BITS
    across = np.array([c.across for c in lanes])
    made = np.zeros(len(lanes), np.int64)
    mask, low = (1 << FAST_BITS) - 1, np.array([(1 << k) - 1 for k in range(16)])
    live = np.arange(len(lanes))
    seen: list[tuple[np.ndarray, ...]] = []
    while len(live):
        p, green, dist = pos[live], where[live], where[live] + (1 << FAST_BITS)
        goal, have = total[live], made[live]
        sizes, tells = np.empty((32, len(live)), np.int16), np.empty((32, len(live)), np.int32)
        # 32 tokens take 180 bytes at most, so no lane that is read beyond its end leaves the array
        for k in range(32):
            x = ahead[p >> 3] >> (p & 7)
            e = table[green + (x & mask)]
            bits, some, far = e & 15, e >> 4 & 15, (e & 256) != 0
            x >>= bits
            n = (e >> 9) + (x & low[some])
            x >>= some
            f = table[dist + (x & mask)]
            own, more = f & 15, f >> 4 & 15
            x >>= own
            tells[k] = np.where(far, (f >> 8) + (x & low[more]), -1 - n)
            # lanes that have all their pixels stand still until they are put aside
            going = have < goal
            n = np.where(far, n, 1) * going
            sizes[k] = n
            have = have + n
            p = p + (bits + some + (own + more) * far) * going
        seen.append((live, sizes, tells))
        if (p > limit[live]).any():
            raise BadImage("the data end within an image")
        pos[live], made[live] = p, have
        live = live[have < goal]
    if (made != total).any():
        raise BadImage("a back-reference beyond the image")
    # token after token of each lane: how many it has in each round tells where they go
    counts = np.zeros((len(seen), len(lanes)), np.int64)
    for r, (which, sizes, _) in enumerate(seen):
        counts[r, which] = (sizes > 0).sum(axis=0)
    each = counts.sum(axis=0)
    slot = np.cumsum(counts, axis=0) - counts + (np.cumsum(each) - each)[None, :]
    n, told = np.empty(int(each.sum()), np.int64), np.empty(int(each.sum()), np.int64)
    for r, (which, sizes, tells) in enumerate(seen):
        keep = sizes.T > 0  # tokens of a lane stand first among its 32
        to = (slot[r, which][:, None] + np.arange(32)[None, :])[keep]
        n[to], told[to] = sizes.T[keep], tells.T[keep]
    seen.clear()
    lane = np.repeat(np.arange(len(lanes)), each)
    at = np.cumsum(n) - n  # of each token, among the pixels of all images
    near = (told > 0) & (told <= 120)
    k = np.where(near, told - 1, 0)
    back = np.where(told < 0, 0, np.where(near, np.maximum(_DX[k] + _DY[k] * across[lane], 1), told - 120))
    start = np.cumsum(total) - total
    if (at - back < start[lane]).any():
        raise BadImage("a back-reference beyond the image")
    root = np.arange(int(total.sum()), dtype=np.int32) - np.repeat(back, n).astype(np.int32)
    value = np.repeat(np.where(told < 0, -1 - told, 0), n).astype(np.uint8)
    which = np.flatnonzero(np.repeat(back > 0, n))
    while len(which):
        was = root[which]
        further = root[was]
        moved = further != was
        root[which] = further
        which = which[moved]
    return np.split(value[root], start[1:])


def decode_many(images: list[bytes]) -> list[np.ndarray]:
    """``decode`` of each image; those with one varying channel are decoded side by side."""
    chunks = [_payload(i) for i in images]
    found = [_lane(c) for c in chunks]
    out: list[np.ndarray | None] = [None if lane else decode(i) for lane, i in zip(found, images, strict=True)]
    which = [k for k, lane in enumerate(found) if lane]
    if not which:
        return out
    for k, green in zip(which, _greens([found[k] for k in which], [chunks[k] for k in which]), strict=True):
        lane = found[k]
        red, blue, alpha = lane.rest
        p = np.empty((lane.height, lane.across, 4), np.int64)
        p[..., 0], p[..., 1], p[..., 2], p[..., 3] = alpha, red, green.reshape(lane.height, lane.across), blue
        out[k] = _inverted(p, lane.transforms)
    return out
