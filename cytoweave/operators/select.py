"""Projection, filter and predicate operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_labels(df: DataFrame, labels: Sequence[str], column: str = "cell_type") -> DataFrame:
    """Rows whose label is listed (reaches the scan as an ``In`` filter)."""
    return df.where(F.col(column).isin(list(labels)))


def drop_singletons(df: DataFrame, column: str = "cell_type") -> DataFrame:
    """Remove labels seen once.

    Counting is a partial aggregate; the semi join is against one row per label,
    so a hot label is never gathered as a window would.
    """
    repeated = df.groupBy(column).agg(F.count("*").alias("_n")).where("_n > 1").select(column)
    return df.join(repeated, column, "left_semi")


def select_genes(counts: DataFrame, genes: DataFrame, names: Sequence[str]) -> DataFrame:
    """Stored entries of the named genes that exist."""
    wanted = genes.where(F.col("gene_name").isin(list(names))).select("gene_id", "gene_name")
    return counts.join(wanted, "gene_id")


def derive_column(df: DataFrame, target: str, source: str) -> DataFrame:
    """``target := source``."""
    return df.withColumn(target, F.col(source))


def combine_conditions(df: DataFrame, keys: Sequence[str], out: str = "conditions_combined") -> DataFrame:
    """Join condition columns with ``_``."""
    return df.withColumn(out, F.concat_ws("_", *[F.col(k).cast("string") for k in keys]))


def missing_to_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL and NaN become 0."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in columns})


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to double, non-numbers to NULL; rows with nothing left are dropped."""
    cast = df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in columns})
    return cast.na.drop(how="all", subset=list(columns))


def prefix_columns(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rename every column to ``prefix_name`` except those in ``keep``."""
    return df.select([F.col(c) if c in keep else F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def select_cells(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose ``cell_id`` is in ``ids``."""
    return df.join(ids.select("cell_id"), "cell_id", "left_semi")


def lookup_cells(df: DataFrame, positions: DataFrame) -> DataFrame:
    """Ordered fetch: ``positions(pos, cell_id)`` may repeat a cell."""
    return positions.select("pos", "cell_id").join(df, "cell_id")


def head(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """First ``n`` rows by an explicit order."""
    return df.orderBy(*order).limit(n)


def text_contains(df: DataFrame, column: str, part: str) -> DataFrame:
    return df.where(F.col(column).contains(part))


def text_prefix(df: DataFrame, column: str, prefix: str, out: str) -> DataFrame:
    """Boolean flag column: does the text start with ``prefix``."""
    return df.withColumn(out, F.col(column).startswith(prefix))


def filter_folds(df: DataFrame, below: int, column: str = "fold") -> DataFrame:
    return df.where(F.col(column) < below)
