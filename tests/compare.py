"""Runs a query in Spark and its oracle in DuckDB and compares names, types, number of rows and values."""

from __future__ import annotations

import math
import os

import duckdb
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def kind(t: pa.DataType) -> str:
    """A type's name, engines' ways of writing it evened out."""
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return f"list<{kind(t.value_type)}>"
    if pa.types.is_map(t):
        return f"map<{kind(t.key_type)},{kind(t.item_type)}>"
    if pa.types.is_struct(t):
        return "struct<" + ",".join(f"{f.name}:{kind(f.type)}" for f in t) + ">"
    if pa.types.is_timestamp(t):
        return "timestamp" + ("_tz" if t.tz else "")
    return str(t).replace("large_", "")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    if isinstance(v, tuple):
        return tuple(plain(x) for x in v)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return str(v)
    return v


def rows(t: pa.Table) -> list:
    names = sorted(t.column_names)
    return sorted((tuple(plain(v) for v in r) for r in zip(*[t[c].to_pylist() for c in names], strict=True)), key=repr)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs, or an empty text."""
    a = spark_df.toArrow()
    b = con.execute(sql).to_arrow_table()
    if sorted(a.column_names) != sorted(b.column_names):
        return f"columns {a.column_names} and {b.column_names}"
    types = {c: (kind(a.schema.field(c).type), kind(b.schema.field(c).type)) for c in a.column_names}
    odd = {c: t for c, t in types.items() if t[0] != t[1]}
    if odd:
        return f"types {odd}"
    if a.num_rows != b.num_rows:
        return f"{a.num_rows} and {b.num_rows} rows"
    x, y = rows(a), rows(b)
    bad = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    return f"{len(bad)} of {len(x)} rows, such as {bad[0]}" if bad else ""
