"""Where users hang in their own code: column functions first, Arrow kernels second."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Resource(Protocol):
    """What a data source offers: parse what was fetched, read it, store it."""

    def read(self) -> DataFrame: ...

    def parse(self) -> DataFrame: ...

    def dump(self, path: str) -> None: ...


def apply_columns(df: DataFrame, **exprs: Callable[[DataFrame], Column]) -> DataFrame:
    """New columns from functions of the table; stays in the JVM."""
    return df.withColumns({k: f(df) for k, f in exprs.items()})


def apply_series(df: DataFrame, into: str, kind: str, f: Callable[[pd.Series], pd.Series], column: str) -> DataFrame:
    """A column from a vectorised function over Arrow batches."""
    return df.withColumn(into, F.pandas_udf(f, kind)(F.col(column)))


def apply_rows(df: DataFrame, f: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """Any number of rows from each, batch by batch; an error becomes a row only if
    ``f`` makes it one."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for row in batch.to_dict("records") for r in f(row)], columns=names)

    return df.mapInPandas(run, schema)


def fold(df: DataFrame, callbacks: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Callbacks one after the other, as a left fold."""
    for f in callbacks:
        df = df.transform(f)
    return df


def has_schema(df: DataFrame, expected: dict[str, str]) -> bool:
    """Whether columns are there with their types."""
    have: dict[str, Any] = dict(df.dtypes)
    return all(have.get(k) == v for k, v in expected.items())


#: Columns that make a table one of chains of a kind.
CHAIN_TABLES = {"sequence": {"seq_id", "s"}, "structure": {"structure_id", "chain_id", "atom_idx"}, "chain": {"id", "chain_type", "level"}}


def chain_kind(df: DataFrame) -> str | None:
    """The kind of chains a table holds, by its columns; none if it holds no chains."""
    return next((k for k, names in CHAIN_TABLES.items() if names <= set(df.columns)), None)
