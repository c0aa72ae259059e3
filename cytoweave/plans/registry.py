"""Named queries with, where SQL can say it, the same answer in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``covers`` is the inventory id, ``sql`` its oracle."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        OPERATORS[name] = covers
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column: sums are added in a different order by each engine."""
    return df.select(
        [
            F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def load_all() -> None:
    """Import every query module (each registers its queries)."""
    from . import (  # noqa: F401
        evaluation_queries,
        graph_queries,
        integration_queries,
        preparation_queries,
        prototype_queries,
        source_queries,
        stream_queries,
        table_queries,
        view_queries,
    )
