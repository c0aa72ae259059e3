"""Aggregations and label statistics over labels, counts and embeddings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import running_sum
from ..functions.vec import mean_vector, variance_vector


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def nunique(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    fn = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(*[fn(c).alias(f"n_{c}") for c in columns])


def gene_means(counts: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """Dense mean per gene: absent entries are zeros, so divide by all cells."""
    n = cells.agg(F.count("*")).scalar()
    sums = counts.groupBy("gene_id").agg(F.sum("x").alias("_s"))
    return genes.select("gene_id").join(sums, "gene_id", "left").select(
        "gene_id", (F.coalesce(F.col("_s"), F.lit(0.0)) / n).alias("mean")
    )


def group_profiles(
    counts: DataFrame, cells: DataFrame, genes: DataFrame, group: str = "cell_type", centre: bool = True
) -> DataFrame:
    """Mean profile per group over every gene, optionally minus the gene mean over groups.

    The group list is a small array (one entry per label) exploded per gene, so
    the dense grid is made locally: (groups x genes) rows, no cross join.
    """
    groups = (
        cells.groupBy(group)
        .agg(F.count("*").alias("n"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), "n"))))
        .scalar()
    )
    sums = (
        counts.join(cells.select("cell_id", group), "cell_id")
        .groupBy("gene_id", group)
        .agg(F.sum("x").alias("s"))
        .groupBy("gene_id")
        .agg(F.map_from_entries(F.collect_list(F.struct(group, "s"))).alias("m"))
    )
    per_gene = genes.select("gene_id").join(sums, "gene_id", "left").withColumn("groups", groups)
    filled = per_gene.select(
        "gene_id",
        F.transform(
            "groups",
            lambda g: F.struct(
                g["g"].alias("g"),
                (F.coalesce(F.try_element_at(F.col("m"), g["g"]), F.lit(0.0)) / g["n"]).alias("v"),
            ),
        ).alias("p"),
    )
    mean = F.aggregate("p", F.lit(0.0), lambda a, e: a + e["v"]) / F.size("p")
    base = filled.withColumn("_c", mean if centre else F.lit(0.0))
    return base.select("gene_id", "_c", F.explode("p").alias("e")).select(
        F.col("e.g").alias(group), "gene_id", (F.col("e.v") - F.col("_c")).alias("value")
    )


def profile_correlation(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """Pearson correlation over genes of every profile in ``a`` with every one in ``b``."""
    left = a.select("gene_id", a_key, F.col("value").alias("_x"))
    right = b.select("gene_id", b_key, F.col("value").alias("_y"))
    return left.join(right, "gene_id").groupBy(a_key, b_key).agg(F.corr("_x", "_y").alias("corr"))


def vector_moments(df: DataFrame, by: str | None = None, vec: str = "vec") -> DataFrame:
    """Element-wise mean and sample variance, overall or per label, one row per dimension."""
    grouped = df.groupBy(by) if by else df.groupBy()
    packed = grouped.agg(mean_vector(vec).alias("m"), variance_vector(vec).alias("v"))
    keys = [by] if by else []
    return packed.select(*keys, F.posexplode(F.arrays_zip("m", "v")).alias("dim", "_e")).select(
        *keys, "dim", F.col("_e.m").alias("mean"), F.col("_e.v").alias("var")
    )


def weighted_average(df: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """sum(v * n) / sum(n) per group."""
    return df.groupBy(by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("avg"))


def running_average(
    df: DataFrame, by: str, order: Sequence[str], bucket, value: str, weight: str
) -> DataFrame:
    """Running sum(v * n) / sum(n) along ``order``; ``bucket`` is monotone in the order."""
    first = running_sum(df, [by], bucket, order, F.col(value) * F.col(weight), "_s")
    both = running_sum(first, [by], bucket, order, F.col(weight).cast("double"), "_w")
    return both.withColumn("running_avg", F.col("_s") / F.col("_w")).drop("_s", "_w")


def batch_averages(per_batch: DataFrame, metric: str, size: str) -> DataFrame:
    """Batch-wise metric averaged plainly and weighted by batch size."""
    return per_batch.agg(
        F.avg(metric).alias("plain"),
        (F.sum(F.col(metric) * F.col(size)) / F.sum(size)).alias("weighted"),
    )


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence[str] | None = None) -> DataFrame:
    """Counts of rows x columns, absent pairs as 0."""
    return df.groupBy(rows).pivot(columns, list(values) if values else None).agg(F.count(F.lit(1))).na.fill(0)


def marker_axes(counts: DataFrame, cells: DataFrame, x_gene: int, y_gene: int, group: str = "cell_type") -> DataFrame:
    """Dense mean of two chosen genes per group."""
    sizes = cells.groupBy(group).agg(F.count("*").alias("_n"))
    pair = counts.where(F.col("gene_id").isin(x_gene, y_gene)).join(cells.select("cell_id", group), "cell_id")
    sums = pair.groupBy(group).agg(
        F.sum(F.when(F.col("gene_id") == x_gene, F.col("x"))).alias("_x"),
        F.sum(F.when(F.col("gene_id") == y_gene, F.col("x"))).alias("_y"),
    )
    return sizes.join(sums, group, "left").select(
        group,
        (F.coalesce("_x", F.lit(0.0)) / F.col("_n")).alias("x_mean"),
        (F.coalesce("_y", F.lit(0.0)) / F.col("_n")).alias("y_mean"),
    )
