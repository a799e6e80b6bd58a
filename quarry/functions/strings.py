"""Strings, regular expressions and bytes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _literal(s: str) -> str:
    return re.escape(s)


def chr_(n: str | Column) -> Column:
    """The character of a code point (not only of a byte): its UTF-32 bytes, decoded."""
    return F.decode(F.unhex(F.lpad(F.hex(_c(n)), 8, "0")), "UTF-32")


def codepoint(s: str | Column) -> Column:
    """The code point of a character."""
    return F.conv(F.hex(F.encode(F.substring(_c(s), 1, 1), "UTF-32")), 16, 10).cast("int")


def split(s: str | Column, delimiter: str, limit: int = -1) -> Column:
    """Split at a literal delimiter."""
    return F.split(_c(s), _literal(delimiter), limit)


def split_part(s: str | Column, delimiter: str, index: int) -> Column:
    """The index-th field (from 1); null beyond the last."""
    parts = F.split(_c(s), _literal(delimiter), -1)
    return F.try_element_at(parts, F.lit(index))


def split_to_map(s: str | Column, entry: str, pair: str) -> Column:
    return F.str_to_map(_c(s), F.lit(_literal(entry)), F.lit(_literal(pair)))


def strpos(s: str | Column, sub: str, instance: int = 1) -> Column:
    """Where the instance-th occurrence starts (from 1), counting occurrences that do not overlap; 0 if there is none."""
    if instance == 1:
        return F.instr(_c(s), sub)
    head = F.substring_index(_c(s), sub, instance)
    return F.when(F.char_length(head) < F.char_length(_c(s)), F.char_length(head) + 1).otherwise(0)


def strrpos(s: str | Column, sub: str) -> Column:
    """Where the last occurrence starts; 0 if there is none."""
    c = _c(s)
    at = F.locate(sub[::-1], F.reverse(c))
    return F.when(at == 0, 0).otherwise(F.char_length(c) - at - len(sub) + 2)


def hamming_distance(a: str | Column, b: str | Column) -> Column:
    """Differing places of two strings of one length; an error for others."""
    x, y = _c(a), _c(b)
    n = F.aggregate(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.when(p == q, 0).otherwise(1)), F.lit(0), lambda s, v: s + v)
    return F.when(F.char_length(x) == F.char_length(y), n).when(x.isNotNull() & y.isNotNull(), F.raise_error(F.lit("hamming_distance needs strings of one length"))).cast("bigint")


def regexp_extract(s: str | Column, pattern: str, group: int = 0) -> Column:
    """The first match's group; null if nothing matches."""
    return F.when(F.regexp_like(_c(s), F.lit(pattern)), F.regexp_extract(_c(s), pattern, group))


def regexp_extract_all(s: str | Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_c(s), F.lit(pattern), F.lit(group))


def regexp_replace(s: str | Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(_c(s), pattern, by)


def regexp_position(s: str | Column, pattern: str) -> Column:
    """Where the first match starts; -1 if nothing matches."""
    at = F.regexp_instr(_c(s), F.lit(pattern))
    return F.when(at == 0, -1).otherwise(at)


def word_count(s: str | Column) -> Column:
    return F.regexp_count(_c(s), F.lit(r"\S+"))


def trim_of(s: str | Column, characters: str) -> Column:
    """Without ``characters`` at both ends."""
    return F.btrim(_c(s), F.lit(characters))


def to_utf8(s: str | Column) -> Column:
    return F.encode(_c(s), "UTF-8")


def from_utf8(b: str | Column) -> Column:
    """Malformed bytes become the replacement character."""
    return F.call_function("make_valid_utf8", _c(b).cast("string"))


def digest(b: str | Column, kind: str) -> Column:
    """md5, sha1, sha256 or sha512 as bytes."""
    x = _c(b)
    return F.unhex({"md5": F.md5, "sha1": F.sha1, "sha256": lambda v: F.sha2(v, 256), "sha512": lambda v: F.sha2(v, 512)}[kind](x))


def to_big_endian_64(x: str | Column) -> Column:
    return F.unhex(F.lpad(F.hex(_c(x).cast("bigint")), 16, "0"))


def from_big_endian_64(b: str | Column) -> Column:
    """Signed, from eight bytes."""
    h = F.hex(_c(b))
    high, low = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.conv(F.substring(h, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def normalize(s: str | Column, form: str = "NFC") -> Column:
    """Unicode normalisation.  No built-in function does this, so texts go through Arrow batches; ASCII texts, which
    it cannot change, stay as they are, and a null goes in their place."""
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.str.normalize(form)

    ascii_ = F.regexp_like(_c(s), F.lit("^[\\x00-\\x7F]*$"))
    return F.coalesce(run(F.when(~ascii_, _c(s))), _c(s))


def xxhash64(b: str | Column) -> Column:
    """The eight bytes of XXH64 with seed 0 (the built-in function has another seed), through Arrow batches."""
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        import xxhash

        return x.map(lambda v: None if v is None else xxhash.xxh64(v).digest())

    return run(_c(b))


def murmur3(b: str | Column) -> Column:
    """The sixteen bytes of MurmurHash3 (x64, 128 bits, seed 0), through Arrow batches."""
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        from .murmur import murmur3_128

        return x.map(lambda v: None if v is None else murmur3_128(v))

    return run(_c(b))


def word_stem(word: str | Column) -> Column:
    """The stem of an English word (Porter's second algorithm), through Arrow batches of distinct words."""
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        from .stem import stem

        found = {w: stem(w) for w in x.dropna().unique()}
        return x.map(found)

    return run(_c(word))


def hmac(b: str | Column, key: bytes, kind: str) -> Column:
    """Keyed digest (md5, sha1, sha256, sha512) with a constant key; the padded keys are literals of the plan."""
    import hashlib

    size = 128 if kind == "sha512" else 64
    k = (hashlib.new(kind, key).digest() if len(key) > size else key).ljust(size, b"\0")
    inner = digest(F.concat(F.lit(bytes(x ^ 0x36 for x in k)), _c(b)), kind)
    return digest(F.concat(F.lit(bytes(x ^ 0x5C for x in k)), inner), kind)
