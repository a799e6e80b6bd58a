"""Type signatures: ``row(a bigint, b array(varchar(3)))`` and the like, as Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

_TOKEN = re.compile(r"\s*(?:(\"[^\"]*\"|\w+)|([(),]))")
_PLAIN = {
    "boolean": T.BooleanType, "tinyint": T.ByteType, "smallint": T.ShortType, "integer": T.IntegerType, "int": T.IntegerType, "bigint": T.LongType, "real": T.FloatType, "double": T.DoubleType, "varchar": T.StringType, "char": T.StringType,
    "varbinary": T.BinaryType, "date": T.DateType, "timestamp": T.TimestampNTZType, "json": T.StringType, "hyperloglog": T.BinaryType, "unknown": T.NullType,
}


class BadType(ValueError):
    """The text is no type signature that is supported."""


def parse(signature: str) -> T.DataType:
    """The Spark type of a signature.  ``char`` and ``varchar`` of any length are strings (never padded); a timestamp
    has no zone, ``timestamp with time zone`` is an instant, ``interval day to second`` an interval."""
    tokens, at = [], 0
    text = signature.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise BadType(f"cannot read {signature!r} at {text[at:]!r}")
        tokens.append(m[1] or m[2])
        at = m.end()
    tokens = [t if t.startswith('"') else t.lower() for t in tokens]
    kind, rest = _type(tokens)
    if rest:
        raise BadType(f"{signature!r} goes on after a type: {' '.join(rest)}")
    return kind


def _words(tokens: list[str], *words: str) -> bool:
    return tokens[: len(words)] == list(words)


def _numbers(tokens: list[str], name: str, least: int, most: int) -> tuple[list[int], list[str]]:
    if not _words(tokens, "("):
        if least:
            raise BadType(f"{name} needs a parameter")
        return [], tokens
    inner = tokens[1 : tokens.index(")")] if ")" in tokens else []
    digits = inner[::2]
    if not inner or any(c != "," for c in inner[1::2]) or not all(d.isdigit() for d in digits) or not least <= len(digits) <= most:
        raise BadType(f"wrong parameters of {name}")
    return [int(d) for d in digits], tokens[len(inner) + 2 :]


def _type(tokens: list[str]) -> tuple[T.DataType, list[str]]:
    if not tokens:
        raise BadType("a type is missing")
    head, rest = tokens[0], tokens[1:]
    if head == "double" and _words(rest, "precision"):
        return T.DoubleType(), rest[1:]
    if head == "interval":
        if not _words(rest, "day", "to", "second"):
            raise BadType("this interval is not supported")
        return T.DayTimeIntervalType(), rest[3:]
    if head == "timestamp":
        _, rest = _numbers(rest, head, 0, 1)
        if _words(rest, "with", "time", "zone"):
            return T.TimestampType(), rest[3:]
        return T.TimestampNTZType(), rest
    if head == "decimal":
        n, rest = _numbers(rest, head, 2, 2)
        if not 0 < n[0] <= 38 or n[1] > n[0]:
            raise BadType("wrong parameters of decimal")
        return T.DecimalType(*n), rest
    if head in ("varchar", "char"):
        return T.StringType(), _numbers(rest, head, 0, 1)[1]
    if head in ("array", "map", "row"):
        if not _words(rest, "("):
            raise BadType(f"{head} needs parameters")
        return _nested(head, rest[1:])
    if head in _PLAIN:
        return _PLAIN[head](), rest
    raise BadType(f"unknown type {head}")


def _nested(head: str, rest: list[str]) -> tuple[T.DataType, list[str]]:
    parts: list[tuple[str, T.DataType]] = []
    while True:
        name = f"col{len(parts)}"
        if head == "row" and len(rest) > 1 and rest[1] not in ("(", ")", ",") and not _words(rest, "double", "precision") and rest[0] != "interval" and not _words(rest, "timestamp", "with"):
            name, rest = rest[0].strip('"'), rest[1:]
        kind, rest = _type(rest)
        parts.append((name, kind))
        if not rest or rest[0] not in (",", ")"):
            raise BadType(f"{head} is not closed")
        sign, rest = rest[0], rest[1:]
        if sign == ")":
            break
    need = {"array": 1, "map": 2}.get(head)
    if need and len(parts) != need:
        raise BadType(f"{head} takes {need} types")
    if head == "array":
        return T.ArrayType(parts[0][1]), rest
    if head == "map":
        return T.MapType(parts[0][1], parts[1][1]), rest
    return T.StructType([T.StructField(n, k) for n, k in parts]), rest
