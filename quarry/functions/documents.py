"""JSON and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def json_extract(j: str | Column, path: str) -> Column:
    return F.get_json_object(_c(j), path)


def json_extract_scalar(j: str | Column, path: str) -> Column:
    """Null for objects and arrays."""
    v = F.get_json_object(_c(j), path)
    return F.when(~F.startswith(F.ltrim(v), F.lit("{")) & ~F.startswith(F.ltrim(v), F.lit("[")), v)


def json_parse(j: str | Column) -> Column:
    """The JSON text in its plain form; null for malformed text."""
    return F.to_json(F.try_parse_json(_c(j)))


def json_array_contains(j: str | Column, x: Column, kind: str) -> Column:
    return F.array_contains(F.from_json(_c(j), f"array<{kind}>"), x)


def json_array_get(j: str | Column, i: int) -> Column:
    """From 0; negative places count from the end."""
    if i >= 0:
        return F.get_json_object(_c(j), f"$[{i}]")
    return F.try_element_at(F.from_json(_c(j), "array<string>"), F.lit(i))


def json_size(j: str | Column, path: str = "$") -> Column:
    """Members of an object or array; 0 for a scalar."""
    v = F.get_json_object(_c(j), path)
    return F.coalesce(F.size(F.json_object_keys(v)).cast("bigint"), F.json_array_length(v).cast("bigint"), F.when(v.isNotNull(), F.lit(0).cast("bigint")))


def is_json_scalar(j: str | Column) -> Column:
    t = F.ltrim(_c(j))
    return ~(F.startswith(t, F.lit("{")) | F.startswith(t, F.lit("[")))


def url_part(u: str | Column, part: str) -> Column:
    """protocol, host, port, path, query, fragment; null for what a URL lacks or where it is malformed."""
    c = _c(u)
    if part == "port":
        return F.regexp_extract(F.try_parse_url(c, F.lit("AUTHORITY")), r":(\d+)$", 1).try_cast("bigint")
    return F.try_parse_url(c, F.lit({"fragment": "REF"}.get(part, part.upper())))


def url_parameter(u: str | Column, name: str) -> Column:
    return F.try_parse_url(_c(u), F.lit("QUERY"), F.lit(name))
