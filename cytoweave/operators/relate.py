"""Joins and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_metrics(left: DataFrame, right: DataFrame, on: str = "model") -> DataFrame:
    """Equi inner join of metric frames."""
    return left.join(right, on, "inner")


def outer_by_class(frames: dict[str, DataFrame], on: str = "class", value: str = "f1") -> DataFrame:
    """One column per model, classes from any of them."""
    long = [df.select(on, F.lit(name).alias("_m"), F.col(value).alias("_v")) for name, df in frames.items()]
    stacked = reduce(DataFrame.unionAll, long)
    return stacked.groupBy(on).pivot("_m", list(frames)).agg(F.first("_v"))


def side_by_side(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """Column concat of one-row frames: long metrics pivoted to one wide row per model."""
    return long.groupBy("model").pivot("metric", list(names)).agg(F.first("value"))


def stack_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Row concat; a missing column becomes NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def partner_pools(cells: DataFrame) -> DataFrame:
    """Same-label partners of each (label, study): how many in other studies, how many in all.

    The label self-join with ``study <>`` is quadratic inside a label.  Every
    consumer needs either the pool size (here) or a sample of it (``views``), so
    no pair is ever formed.
    """
    sizes = cells.groupBy("cell_type", "study").agg(F.count("*").alias("n_same_study"))
    totals = sizes.groupBy("cell_type").agg(F.sum("n_same_study").alias("n_type"))
    return sizes.join(totals, "cell_type").withColumn(
        "n_other_study", F.col("n_type") - F.col("n_same_study")
    )


def unseen_values(query: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``query`` missing from ``reference`` (empty: it is covered)."""
    return query.select(column).distinct().join(reference.select(column).distinct(), column, "left_anti")


def value_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def value_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def distinct_rounded(df: DataFrame, columns: Sequence[str], digits: int = 5) -> DataFrame:
    """Round, then drop duplicates."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns}).dropDuplicates()


def stack_tagged(parts: dict[str, tuple[DataFrame, str]], tag: str = "type") -> DataFrame:
    """Rows of several id/vec tables with a literal tag: ``{tag: (df, id_column)}``."""
    frames = [
        df.select(F.lit(name).alias(tag), F.col(key).cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
        for name, (df, key) in parts.items()
    ]
    return reduce(DataFrame.unionAll, frames)
