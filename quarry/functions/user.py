"""User functions: scalar, table and mergeable aggregate functions, for SQL and for DataFrames.

Scalar functions get Arrow batches as pandas series.  An aggregate is folded in each task first and its states are
merged afterwards, so that no group's rows are gathered in one place.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: States that a task holds before it passes them on.
STATES = 50_000


class Aggregate(Protocol):
    """A fold: ``zero`` is its first state, ``step`` adds a value, ``merge`` unites two states, ``finish`` gives the result."""

    def zero(self) -> Any: ...
    def step(self, state: Any, value: Any) -> Any: ...
    def merge(self, a: Any, b: Any) -> Any: ...
    def finish(self, state: Any) -> Any: ...


def scalar(spark: SparkSession, name: str, f: Callable[..., pd.Series], returns: str) -> Callable:
    """Registers a function of series, with their types as hints, under ``name``; the result also takes columns."""
    return spark.udf.register(name, F.pandas_udf(f, returns))


def table(spark: SparkSession, name: str, handler: type, returns: str) -> Callable:
    """Registers a table function: a class whose ``eval`` yields rows."""
    made = F.udtf(handler, returnType=returns)
    spark.udtf.register(name, made)
    return made


def aggregate(df: DataFrame, groups: list[str], column: str, fold: Aggregate, returns: str, name: str) -> DataFrame:
    """For each group the ``fold`` of the non-null values of ``column``; groups may hold nulls."""
    kinds = dict(df.dtypes)
    keys = ", ".join(f"`{g}` {kinds[g]}" for g in groups)

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, tuple[tuple, Any]] = {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(*key, pickle.dumps(state)) for key, state in held.values()], columns=[*groups, "_state"])

        for batch in batches:
            for *key, value in batch.itertuples(index=False, name=None):
                at = repr(key)
                own, state = held.get(at) or (tuple(None if pd.isna(k) else k for k in key), fold.zero())
                held[at] = own, state if value is None or value != value else fold.step(state, value)
            if len(held) >= STATES:
                yield rows()
                held.clear()
        if held:
            yield rows()

    def finished(rows: pd.DataFrame) -> pd.DataFrame:
        state = fold.zero()
        for s in rows["_state"]:
            state = fold.merge(state, pickle.loads(s))
        return rows[groups].head(1).assign(**{name: fold.finish(state)})

    partial = df.select(*groups, column).mapInPandas(states, f"{keys}, _state binary")
    return partial.groupBy(*groups).applyInPandas(finished, f"{keys}, `{name}` {returns}")
