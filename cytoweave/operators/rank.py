"""Ranking and top-k.

Top-k is always written as ``row_number <= k``: Spark then keeps only k rows per
group in each task before the shuffle (WindowGroupLimit), so hot groups stay small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def top_per_prototype(scores: DataFrame, k: int) -> DataFrame:
    """k most similar cells per prototype; ties by cell id."""
    return top_k(scores, ["proto_id"], [F.desc("s"), F.asc("cell_id")], k)


def top_genes_by_difference(
    types: DataFrame, protos: DataFrame, k: int, type_key: str = "cell_type", proto_key: str = "proto", sign: int = 1
) -> DataFrame:
    """Top genes of ``sign * (type - prototype)`` for each (type, prototype)."""
    a = types.select("gene_id", type_key, F.col("value").alias("_a"))
    b = protos.select("gene_id", proto_key, F.col("value").alias("_b"))
    diff = a.join(b, "gene_id").withColumn("diff", F.lit(sign) * (F.col("_a") - F.col("_b"))).drop("_a", "_b")
    return top_k(diff, [type_key, proto_key], [F.desc("diff"), F.asc("gene_id")], k)


def top_markers(ranked: DataFrame, group: str, score: str, n: int) -> DataFrame:
    """Top ``n`` genes per group, flattened to distinct genes."""
    return top_k(ranked, [group], [F.desc(score), F.asc("gene_id")], n).select("gene_id").dropDuplicates()


def order_groups(df: DataFrame, key: str, value: str, out: str = "position") -> DataFrame:
    """Position of each group by descending value; one row per group, so one sort task is enough."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(F.desc(value), F.asc(key))))


def leaderboard(wide: DataFrame, sort_by: str, metrics: Sequence[str], baseline: Column) -> DataFrame:
    """Sort descending and flag every cell above the best baseline row.

    The best row is found in the same evaluation as the rows: means summed once more in another order would lie above themselves.
    """
    order = F.when(baseline, F.struct(F.negative(sort_by), "model"))
    flagged = wide.withColumn("_best", F.min_by(F.struct(*metrics), order).over(Window.partitionBy()))
    return (
        flagged.withColumns({f"{m}_above": F.col(m) > F.col("_best")[m] for m in metrics})
        .drop("_best")
        .orderBy(F.desc(sort_by), F.asc("model"))
    )


def majority_of_array(df: DataFrame, array: str, out: str) -> DataFrame:
    """Most frequent element of an array; the first seen wins a tie (all row-local)."""
    a = F.col(array)
    counts = F.transform(
        F.array_distinct(a),
        lambda v: F.struct(
            F.size(F.filter(a, lambda x: x.eqNullSafe(v))).alias("n"),
            F.negative(F.array_position(a, v)).alias("first"),
            v.alias("v"),
        ),
    )
    return df.withColumn(out, F.array_max(counts)["v"])


def rows_by_majority(df: DataFrame, array: str, out: str = "majority") -> DataFrame:
    """Group rows by the majority key of their array: size and row ids per key."""
    keyed = majority_of_array(df, array, out)
    return keyed.groupBy(out).agg(F.count("*").alias("n"), F.min("anchor_id").alias("first_anchor"))


def log_scaled(df: DataFrame, value: str, out: str) -> DataFrame:
    """log1p divided by its maximum over the table."""
    top = df.agg(F.max(F.log1p(F.col(value)))).scalar()
    return df.withColumn(out, F.log1p(F.col(value)) / top)


def label_index(df: DataFrame, column: str, out: str = "label_id") -> DataFrame:
    """Index over sorted distinct labels; ranking happens on the label table only."""
    labels = df.select(column).where(F.col(column).isNotNull()).distinct()
    index = labels.withColumn(out, (F.row_number().over(Window.orderBy(column)) - 1).cast("bigint"))
    return df.join(index, column)
