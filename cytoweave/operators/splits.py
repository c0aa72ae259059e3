"""Splits and samples.  All randomness is keyed (see ``functions.rand``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rand import uniform
from ..functions.ranks import uniform_rank

# up to here a sorted limit keeps one bounded heap per task
TOP_LIMIT = 100_000


def split_by_study(df: DataFrame, held_out: Sequence[str], column: str = "study") -> DataFrame:
    """Flag whole studies as ``query``, the rest as ``ref``."""
    return df.withColumn("split", F.when(F.col(column).isin(list(held_out)), "query").otherwise("ref"))


def _draw(op: str, seed: int) -> Column:
    return uniform(seed, op, F.col("cell_id"))


def split_random(df: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Exactly ``ceil(n * test_size)`` rows are ``test``."""
    n = df.agg(F.count("*")).scalar()
    ranked = uniform_rank(df.withColumn("_u", _draw("split", seed)), "_u", "cell_id", out="_rn")
    test = F.col("_rn") <= F.ceil(n * F.lit(test_size))
    return ranked.withColumn("split", F.when(test, "test").otherwise("train")).drop("_u", "_rn")


def split_stratified(df: DataFrame, column: str = "cell_type", test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Per label ``floor(n * test_size + 0.5)`` rows are ``test``."""
    quota = df.groupBy(column).agg(F.floor(F.count("*") * F.lit(test_size) + 0.5).alias("_q"))
    ranked = uniform_rank(df.withColumn("_u", _draw("strat", seed)), "_u", "cell_id", [column], "_rn")
    return (
        ranked.join(quota, column)
        .withColumn("split", F.when(F.col("_rn") <= F.col("_q"), "test").otherwise("train"))
        .drop("_u", "_rn", "_q")
    )


def fraction_subset(df: DataFrame, listed: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Keep rows named in an id list; the class is the part before the first ``_``."""
    return df.join(listed.select(id_col), id_col, "left_semi").withColumn(
        "class", F.split_part(F.col(id_col), F.lit("_"), F.lit(1))
    )


def sample_ids(df: DataFrame, n: int, seed: int = 0, op: str = "sample") -> DataFrame:
    """``n`` cells, uniformly without replacement."""
    drawn = df.withColumn("_u", _draw(op, seed))
    if n <= TOP_LIMIT:
        return drawn.orderBy("_u", "cell_id").limit(n).drop("_u")
    return uniform_rank(drawn, "_u", "cell_id", out="_rn").where(F.col("_rn") <= n).drop("_u", "_rn")


def random_ids(df: DataFrame, n: int, must_include: int, seed: int = 0) -> DataFrame:
    """``n`` ids including ``must_include``; fails if the table is smaller than ``n``."""
    others = sample_ids(
        df.select("cell_id").where(F.col("cell_id") != must_include), n - 1, seed, "include"
    )
    kept = df.select("cell_id").where(F.col("cell_id") == must_include)
    total = df.agg(F.count("*")).scalar()
    enough = F.when(total < n, F.raise_error(F.lit("n is larger than the table")).cast("bigint"))
    return others.unionAll(kept).select(F.coalesce(enough, F.col("cell_id")).alias("cell_id"))


def max_sample_size(df: DataFrame, requested: int, column: str = "cell_type") -> DataFrame:
    """Requested size, at most the smallest class."""
    sizes = df.groupBy(column).agg(F.count("*").alias("_n"))
    return sizes.agg(F.least(F.min("_n"), F.lit(requested).cast("bigint")).alias("sample_size"))


def fold_means(metrics: DataFrame, group: str = "model", fold: str = "fold") -> DataFrame:
    """Mean of every metric column over folds."""
    values = [c for c in metrics.columns if c not in (group, fold)]
    return metrics.groupBy(group).agg(*[F.avg(c).alias(c) for c in values])
