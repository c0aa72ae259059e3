"""Exact ranks and running sums that never need a whole group in one task.

A plain window sorts each group inside one task; with one key holding a third of
the rows that task is the job.  Here the order key is cut into buckets first:
bucket totals are pre-aggregated, their (small) running total gives each bucket
an offset, and only (group, bucket) slices are sorted.  The result is exact for any
buckets; slices are even only where the buckets are, so callers fold equal values first
or take quantiles as borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    value: Column,
    out: str,
) -> DataFrame:
    """Inclusive running sum of ``value`` along ``order`` inside ``keys``.

    ``bucket`` must be non-decreasing along ``order``.
    """
    keys = list(keys)
    cut = df.withColumn("_b", bucket).withColumn("_v", value)
    totals = cut.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
    # one row per (group, bucket): small, whatever the group sizes are
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_b").alias("_ob"),
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"),
    )
    inside = (
        Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    local = cut.withColumn("_run", F.sum("_v").over(inside))
    on = F.col("_b").eqNullSafe(F.col("_ob"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        local.join(offsets, on)
        .withColumn(out, F.col("_run") + F.col("_off"))
        .select(*df.columns, out)
    )


def uniform_rank(
    df: DataFrame,
    u: str,
    tie: str,
    keys: Sequence[str] = (),
    out: str = "rn",
    buckets: int = 1024,
) -> DataFrame:
    """1-based rank by a uniform draw ``u`` (ties by ``tie``) inside ``keys``.

    The draw is uniform, so equal-width buckets are balanced even in a hot group.
    """
    bucket = F.floor(F.col(u) * buckets).cast("int")
    ranked = running_sum(df, keys, bucket, [u, tie], F.lit(1), out)
    return ranked.withColumn(out, F.col(out).cast("bigint"))


def quantile_buckets(df: DataFrame, column: str, out: str, rows_per_bucket: int = 10_000, most: int = 4096) -> DataFrame:
    """``df`` with a bucket number that is monotone in ``column``; borders are quantiles of the column.

    Buckets hold about ``rows_per_bucket`` rows whatever the distribution, if no value repeats: fold
    equal values first.  ``most`` bounds the borders that are sent to the tasks.
    """
    from pyspark.ml.feature import Bucketizer

    n = min(most, df.count() // rows_per_bucket + 1)
    shares = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(column, shares, 4 * most)).first()[0] if shares else []
    borders = sorted(set(float(b) for b in found or []))
    cut = Bucketizer(splits=[float("-inf"), *borders, float("inf")], inputCol=column, outputCol=out) if borders else None
    return cut.transform(df) if cut else df.withColumn(out, F.lit(0.0))


def width_bucket(x: str, low: Column, high: Column, buckets: int = 1024) -> Column:
    """Equal-width bucket of ``x`` between ``low`` and ``high`` (monotone in ``x``)."""
    span = high - low
    raw = F.floor((F.col(x) - low) / span * buckets)
    return F.when(span > 0, F.least(F.lit(buckets - 1), raw)).otherwise(F.lit(0)).cast("int")
