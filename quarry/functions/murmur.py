"""MurmurHash3 for 64-bit machines, 128 bits, from its published description."""

from __future__ import annotations

import struct

_MASK = (1 << 64) - 1
#: Multipliers of the published algorithm (fixed values).
_C1, _C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
_F1, _F2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def _turn(x: int, n: int) -> int:
    return (x << n | x >> (64 - n)) & _MASK


def _finish(x: int) -> int:
    x = (x ^ x >> 33) * _F1 & _MASK
    x = (x ^ x >> 33) * _F2 & _MASK
    return x ^ x >> 33


def murmur3_128(data: bytes, seed: int = 0) -> bytes:
    """Sixteen bytes, both halves little-endian."""
    a = b = seed
    whole = len(data) // 16 * 16
    for p, q in struct.iter_unpack("<QQ", data[:whole]):
        a ^= _turn(p * _C1 & _MASK, 31) * _C2 & _MASK
        a = ((_turn(a, 27) + b) * 5 + 0x52DCE729) & _MASK
        b ^= _turn(q * _C2 & _MASK, 33) * _C1 & _MASK
        b = ((_turn(b, 31) + a) * 5 + 0x38495AB5) & _MASK
    p, q = struct.unpack("<QQ", data[whole:].ljust(16, b"\0"))
    b ^= _turn(q * _C2 & _MASK, 33) * _C1 & _MASK
    a ^= _turn(p * _C1 & _MASK, 31) * _C2 & _MASK
    a, b = a ^ len(data), b ^ len(data)
    a = (a + b) & _MASK
    b = (a + b) & _MASK
    a, b = _finish(a), _finish(b)
    a = (a + b) & _MASK
    return struct.pack("<QQ", a, (a + b) & _MASK)
