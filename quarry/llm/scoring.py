"""Applies a function of whole texts to each row of a table, passing the other columns through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, wordhash

#: Bytes of text that become Python objects at once.
SLICE = 1 << 20


def with_text_columns(docs: DataFrame, score: Callable[[list], Iterator[tuple[int, dict[str, pa.Array]]]], new: dict[str, str], keep: list[str] | None = None, as_bytes: bool = False) -> DataFrame:
    """``docs`` with the columns ``new`` (name: type), which replace columns of those names.

    ``score`` gets the texts of a slice (None for nulls) and yields, in order, (number of rows, their new columns).
    ``keep`` limits the other columns; those travel as one struct, so no name can clash, and the text only once.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    kind = "binary" if as_bytes else "string"
    own = docs.schema["text"].dataType.simpleString() == "string" and "text" in keep and not as_bytes
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    sent = docs.select(row) if own else docs.select(row, F.col("text").cast("string").cast(kind).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            column = rows.field("text") if own else batch.column("text")
            for i, j in wordhash.chunks(wordhash.utf8(column)[1], SLICE):
                at = i
                for n, columns in score(column.slice(i, j - i).to_pylist()):
                    yield pa.record_batch({"row": rows.slice(at, n)} | columns)
                    at += n

    schema = f"row {sent.schema['row'].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in new.items())
    return shared.map_arrow(sent, run, schema).select(*[F.col(f"row.`{c}`").alias(c) for c in keep], *new)
