"""The decoder is tested with an encoder of its own, which writes every feature of the format."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from quarry.llm import media, webp


class Out:
    """Writes a stream with all features: transforms are applied by the caller."""

    def __init__(self):
        self.bits = []

    def put(self, v, n):
        self.bits += [v >> k & 1 for k in range(n)]

    def code(self, lengths):
        """A normal prefix code, lengths written one by one, zeros and repeats in runs."""
        tokens, k = [], 0
        while k < len(lengths):
            n = 1
            while k + n < len(lengths) and lengths[k + n] == lengths[k]:
                n += 1
            if lengths[k] == 0 and n >= 3:
                m = min(n, 138)
                tokens.append((18, m - 11, 7) if m >= 11 else (17, m - 3, 3))
                k += m
            elif n >= 4 and k and lengths[k - 1] == lengths[k]:
                m = min(n, 6)
                tokens.append((16, m - 3, 2))
                k += m
            else:
                tokens.append((lengths[k], 0, 0))
                k += 1
        count = np.bincount([t[0] for t in tokens], minlength=19)
        if (count > 0).sum() < 2:
            count[[i for i in range(19) if not count[i]][0]] += 1
        meta = webp.code_lengths(count, 7)
        code = webp._codes(meta)
        self.put(0, 1)
        self.put(15, 4)
        for s in webp.CODE_LENGTH_ORDER:
            self.put(int(meta[s]), 3)
        self.put(0, 1)
        for s, extra, n in tokens:
            self.put(int(code[s]), int(meta[s]))
            self.put(extra, n)

    def bytes(self):
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


def prefix(v):
    """(prefix symbol, extra value, extra bits) of a length or distance code."""
    if v <= 4:
        return v - 1, 0, 0
    top = (v - 1).bit_length() - 1
    half = (v - 1) >> (top - 1) & 1
    return 2 * top + half, (v - 1) - ((2 + half) << (top - 1)), top - 1


def entropy_image(out, pixels, w, main, cache_bits=0, refs=True, groups=1, shift=3):
    """Literal pixels, back-references to equal runs, and cache hits."""
    h = -(-len(pixels) // w)
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    across = -(-w // (1 << shift))
    if main:
        out.put(1 if groups > 1 else 0, 1)
        if groups > 1:
            out.put(shift - 2, 3)
            tiles = [(i % groups) << 8 for i in range(across * -(-h // (1 << shift)))]
            entropy_image(out, tiles, across, False, 0, False)
    size = 1 << cache_bits if cache_bits else 0
    cache, steps, at = [0] * size, [], 0
    slot = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)
    while at < len(pixels):
        run, d = 0, 0
        for back in [1, w, 2 * w + 1, 3, w - 1, 4 * w + 30] if refs else []:
            n = 0
            while 0 < back <= at and at + n < len(pixels) and n < 4000 and pixels[at + n] == pixels[at + n - back]:
                n += 1
            if n > run:
                run, d = n, back
        n = 1
        if run >= 3:
            near = [k + 1 for k, (x, y) in enumerate(webp.DISTANCES) if x + y * w == d]
            steps.append(("ref", run, near[0] if near else d + 120, at))
            n = run
        elif size and cache[slot(pixels[at])] == pixels[at]:
            steps.append(("hit", slot(pixels[at]), 0, at))
        else:
            steps.append(("lit", pixels[at], 0, at))
        for p in pixels[at : at + n]:
            if size:
                cache[slot(p)] = p
        at += n
    group = lambda at: ((at // w >> shift) * across + (at % w >> shift)) % groups if groups > 1 else 0
    counts = [[np.zeros(280 + size, int), np.zeros(256, int), np.zeros(256, int), np.zeros(256, int), np.zeros(40, int)] for _ in range(groups)]
    for kind, a, b, at in steps:
        c = counts[group(at)]
        if kind == "lit":
            for k, v in enumerate((a >> 8 & 255, a >> 16 & 255, a & 255, a >> 24)):
                c[k][v] += 1
        elif kind == "ref":
            c[0][256 + prefix(a)[0]] += 1
            c[4][prefix(b)[0]] += 1
        else:
            c[0][280 + a] += 1
    codes = []
    for c in counts:
        own = []
        for n in c:
            if (n > 0).sum() < 2:
                s = int(n.argmax())
                if s < 256:  # a simple code of one symbol
                    out.put(0b01, 2)
                    out.put(1, 1)
                    out.put(s, 8)
                    own.append((np.zeros(len(n), int), np.zeros(len(n), int)))
                    continue
                n[0] += 1
            lengths = webp.code_lengths(n, 15)
            out.code(lengths.tolist())
            own.append((webp._codes(lengths), lengths))
        codes.append(own)
    for kind, a, b, at in steps:
        c = codes[group(at)]
        put = lambda k, s: out.put(int(c[k][0][s]), int(c[k][1][s]))  # noqa: E731, B023
        if kind == "lit":
            for k, v in enumerate((a >> 8 & 255, a >> 16 & 255, a & 255, a >> 24)):
                put(k, v)
        elif kind == "ref":
            s, extra, n = prefix(a)
            put(0, 256 + s)
            out.put(extra, n)
            s, extra, n = prefix(b)
            put(4, s)
            out.put(extra, n)
        else:
            put(0, 280 + a)


def file(out):
    body = out.bytes()
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


def start(w, h, alpha=1):
    out = Out()
    out.put(0x2F, 8)
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(alpha, 1)
    out.put(0, 3)
    return out


def argb(p):
    return [(int(a) << 24 | int(r) << 16 | int(g) << 8 | int(b)) for r, g, b, a in p.reshape(-1, 4)]


def picture(w, h, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    p = np.stack([x * 5 + y, y * 7, x + y * 3, 255 - x], -1) + rng.integers(0, 3, (h, w, 4))
    p[h // 3 : h // 2] = p[:1]
    return (p & 255).astype(np.uint8)


@pytest.mark.parametrize(("cache", "groups"), [(0, 1), (4, 1), (11, 1), (0, 3), (6, 4)])
def test_prefix_codes_references_and_cache(cache, groups):
    p = picture(37, 29)
    out = start(37, 29)
    out.put(0, 1)
    entropy_image(out, argb(p), 37, True, cache, True, groups)
    assert (webp.decode(file(out)) == p).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    """The residuals are made with scalar predictors written from the format's description."""
    p = picture(11, 9, mode).astype(int)[..., [3, 0, 1, 2]]
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    clip = lambda v: max(0, min(255, v))

    def half(a, c):
        d = a - c
        return clip(a + (d // 2 if d >= 0 else -(-d // 2)))

    def guess(y, x):
        if y == 0:
            return [255, 0, 0, 0] if x == 0 else list(p[0, x - 1])
        if x == 0:
            return list(p[y - 1, 0])
        left, top, corner = list(p[y, x - 1]), list(p[y - 1, x]), list(p[y - 1, x - 1])
        right = list(p[y - 1, x + 1]) if x + 1 < 11 else list(p[y, 0])
        if mode == 11:
            to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
            to_top = sum(abs(v - c) for v, c in zip(left, corner, strict=True))
            return left if to_left < to_top else top
        return {
            0: [255, 0, 0, 0], 1: left, 2: top, 3: right, 4: corner, 5: avg(avg(left, right), top), 6: avg(left, corner), 7: avg(left, top), 8: avg(corner, top), 9: avg(top, right), 10: avg(avg(left, corner), avg(top, right)),
            12: [clip(a + b - c) for a, b, c in zip(left, top, corner, strict=True)], 13: [half(m, c) for m, c in zip(avg(left, top), corner, strict=True)],
        }[mode]

    rest = np.array([[[(v - g) % 256 for v, g in zip(p[y, x], guess(y, x), strict=True)] for x in range(11)] for y in range(9)])
    out = start(11, 9)
    out.put(1, 1)
    out.put(webp.PREDICTOR, 2)
    out.put(0, 3)  # blocks of four
    entropy_image(out, [mode << 8] * 9, 3, False)
    out.put(0, 1)
    entropy_image(out, argb(rest[..., [1, 2, 3, 0]]), 11, True)
    assert (webp.decode(file(out)) == p[..., [1, 2, 3, 0]]).all()


def test_cross_colour_and_subtract_green():
    p = picture(12, 10, 3).astype(int)
    s8 = lambda v: (v & 255) - 256 if v & 128 else v & 255
    blocks = [(int(a), int(b), int(c)) for a, b, c in np.random.default_rng(4).integers(0, 256, (9, 3))]
    q = p.copy()
    q[..., 0] = (q[..., 0] - q[..., 1]) % 256
    q[..., 2] = (q[..., 2] - q[..., 1]) % 256
    for y in range(10):
        for x in range(12):
            to_red, green_blue, red_blue = blocks[(y // 4) * 3 + x // 4]
            r, g, b, _ = q[y, x]
            b = b - (s8(green_blue) * s8(g) >> 5) - (s8(red_blue) * s8(r) >> 5)
            q[y, x, 0], q[y, x, 2] = (r - (s8(to_red) * s8(g) >> 5)) % 256, b % 256
    out = start(12, 10)
    out.put(1, 1)
    out.put(webp.SUBTRACT_GREEN, 2)
    out.put(1, 1)
    out.put(webp.CROSS_COLOUR, 2)
    out.put(0, 3)
    entropy_image(out, [c << 16 | b << 8 | a for a, b, c in blocks], 3, False)
    out.put(0, 1)
    entropy_image(out, argb(q), 12, True, 5)
    assert (webp.decode(file(out)) == p).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palette(colours):
    rng = np.random.default_rng(colours)
    table = rng.integers(0, 256, (colours, 4))
    index = rng.integers(0, colours, (7, 13))
    p = table[index]
    delta = table.copy()
    delta[1:] = (table[1:] - table[:-1]) % 256
    each = 1 if colours <= 2 else 2 if colours <= 4 else 4 if colours <= 16 else 8
    per = 8 // each
    across = -(-13 // per)
    packed = np.zeros((7, across), int)
    for x in range(13):
        packed[:, x // per] |= index[:, x] << (each * (x % per))
    out = start(13, 7)
    out.put(1, 1)
    out.put(webp.PALETTE, 2)
    out.put(colours - 1, 8)
    entropy_image(out, argb(delta), colours, False, 0, False)
    out.put(0, 1)
    entropy_image(out, [255 << 24 | int(v) << 8 for v in packed.reshape(-1)], across, True)
    assert (webp.decode(file(out)) == p).all()


def samples(seed, n=40):
    """Images of few and many values, of runs, ramps, repeated rows and text."""
    rng = np.random.default_rng(seed)
    text = ("and the rain came down on the town again and again while they all sang of it " * 200).encode()
    out = []
    for k in range(n):
        rows = 1 + k % 7
        kind = k % 8
        if kind < 3:
            x = rng.integers(0, (1, 2, 3, 5, 16, 17, 200, 256)[k // 8 % 8], 192 * rows)
        elif kind == 3:
            x = np.full(192 * rows, k)
        elif kind == 4:
            x = np.cumsum(rng.integers(0, 3, 192 * rows))
        elif kind == 5:
            x = np.tile(rng.integers(0, 256, 192), rows) + np.repeat(np.arange(rows), 192)
        else:
            x = np.frombuffer(text, np.uint8, 192 * rows, int(rng.integers(0, 200)))
        out.append((x.astype(int) % 256).astype(np.uint8))
    return out


def test_grey_images():
    """Every image is read back by either decoder, and the encoder uses each of its features where they pay."""
    images, used = samples(1), {}
    files = webp.encode_grey(images, 192, used)
    assert all(used[k] > 0 for k in ("palette", "subtract_green", "predictor_left", "predictor_top"))
    for x, f, many in zip(images, files, webp.decode_many(files), strict=True):
        p = webp.decode(f)
        assert (p[..., 3] == 255).all() and (p[..., :3] == x.reshape(-1, 192, 1)).all()
        assert (p == many).all()
    # repeated text is told once
    assert len(files[6]) < len(images[6]) / 2
    assert webp.encode_grey(images[::-1], 192)[::-1] == files
    assert webp.encode_grey([], 192) == []
    for bad in ([np.zeros(100, np.uint8)], [np.zeros(0, np.uint8)]):
        with pytest.raises(ValueError):
            webp.encode_grey(bad, 192)


def test_the_querys_own_images(spark):
    """Of the images that the query stores, nearly all hold back-references and are decoded side by side."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    payloads = [media.padded((t or "").encode()) for t in texts]
    used = {}
    stored = media.store(payloads, used)
    files = [f for m in stored for f in media.links(m)]
    assert used["subtract_green"] > 0.9 * len(files) and used["palette"] > 0
    lanes = [webp._lane(webp._payload(f)) for f in files]
    assert all(lanes)
    refs = sum(any(s >= 256 for _, s in lane.green.used) for lane in lanes)
    assert refs > 0.9 * len(files)
    assert sum(map(len, stored)) < 0.5 * sum(map(len, payloads))
    assert [media.payload(i) for i in media.pixels(stored)] == payloads


def test_many_at_once_are_as_one_by_one():
    images = webp.encode_grey(samples(6), 192)
    out = start(37, 29)
    out.put(0, 1)
    entropy_image(out, argb(picture(37, 29)), 37, True, 4)
    images.insert(7, file(out))
    for a, b in zip(webp.decode_many(images), [webp.decode(i) for i in images], strict=True):
        assert (a == b).all()


def test_damaged_files():
    rng = np.random.default_rng(2)
    good = webp.encode_grey([rng.integers(0, 200, 384).astype(np.uint8)], 192)[0]
    for bad in (b"", b"RIFF", good[:12] + b"VP8X" + good[16:], good[:20] + b"\0" + good[21:], good[:-60]):
        with pytest.raises(webp.BadImage):
            webp.decode(bad)
        with pytest.raises(webp.BadImage):
            webp.decode_many([bad])


def test_prefix_codes_are_complete_and_short():
    rng = np.random.default_rng(5)
    for k in range(200):
        count = np.zeros(280, int)
        used = rng.choice(280, rng.integers(2, 200), replace=False)
        count[used] = np.maximum(1, rng.exponential(1, len(used)) ** (1 + k % 9)).astype(int)
        n = webp.code_lengths(count, 12)
        assert ((n > 0) == (count > 0)).all() and n.max() <= 12 and (1.0 / 2 ** n[n > 0]).sum() == 1
        assert len({(a, b) for a, b in zip(n[used].tolist(), webp._codes(n)[used].tolist(), strict=True)}) == len(used)


def test_payloads():
    rng = random.Random(1)
    texts = [b"", b"a", b"x" * 192, b"y" * 193, bytes(rng.randrange(256) for _ in range(20_000)), "漢字".encode() * 5000]
    stored = media.store([media.padded(t) for t in texts])
    for t, image in zip(texts, media.pixels(stored), strict=True):
        p = media.payload(image)
        assert p == t + b" " * (len(p) - len(t)) and len(p) % 192 == 0 and len(p) - len(t) < 192 + (not t)


def test_report(odd, odd_rows, none):
    got = media.media_report(odd).collect()
    want = []
    for d, t, *_ in odd_rows:
        p = media.padded((t or "").encode())
        want.append((d, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)) for r in got)
    same = {}
    for r in got:
        assert same.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    assert media.media_report(none).count() == 0
