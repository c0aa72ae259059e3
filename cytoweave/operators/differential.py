"""Differential expression on sparse counts with dense semantics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import running_sum, width_bucket
from ..functions.special import normal_p, t_p
from ..session import cut_lineage


def adjust_p(df: DataFrame, by: Sequence[str], p: str = "p", out: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg inside ``by``; groups are gene tables."""
    up = Window.partitionBy(*by).orderBy(F.asc_nulls_last(p), "gene_id")
    n = F.count(p).over(Window.partitionBy(*by))
    raw = df.withColumn("_r", F.row_number().over(up)).withColumn("_a", F.col(p) * n / F.col("_r"))
    down = Window.partitionBy(*by).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn(out, F.least(F.min("_a").over(down), F.lit(1.0))).drop("_r", "_a")


def rank_sum(counts: DataFrame, cells: DataFrame, genes: DataFrame, a: str, b: str, label: str = "cell_type") -> DataFrame:
    """Wilcoxon rank-sum of group ``a`` against ``b`` for every gene.

    Values are first counted per (gene, value, group); absent entries join as one
    block at zero, known by its size.  Ranks (average over ties) are running sums
    over these distinct values, so even a gene stored in every cell is split.  The
    counted values are written once; the cells are read in one pass.
    z has no tie correction; p is two-sided normal, adjusted over genes.
    """
    pick = cells.where(F.col(label).isin(a, b)).select("cell_id", (F.col(label) == a).alias("_a"))
    size = pick.agg(F.struct(F.sum(F.col("_a").cast("bigint")).alias("na"), F.sum((~F.col("_a")).cast("bigint")).alias("nb"))).scalar()
    stored = (
        counts.join(pick, "cell_id")
        .groupBy("gene_id", "x")
        .agg(F.sum(F.col("_a").cast("bigint")).alias("a"), F.sum((~F.col("_a")).cast("bigint")).alias("b"))
    )
    stored = cut_lineage(stored)
    seen = stored.groupBy("gene_id").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    blocks = genes.select("gene_id").join(seen, "gene_id", "left").withColumn("_n", size).select(
        "gene_id", F.lit(0.0).alias("x"), (F.col("_n.na") - F.coalesce("sa", F.lit(0))).alias("a"), (F.col("_n.nb") - F.coalesce("sb", F.lit(0))).alias("b")
    )
    values = stored.unionAll(blocks).groupBy("gene_id", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    span = values.groupBy("gene_id").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    values = values.join(span, "gene_id")
    both = F.col("a") + F.col("b")
    ranked = running_sum(values, ["gene_id"], width_bucket("x", F.col("_lo"), F.col("_hi")), ["x"], both, "_cum")
    average = F.col("_cum") - (both - 1) / 2.0
    sums = ranked.groupBy("gene_id").agg(F.sum(average * F.col("a")).alias("_w")).withColumn("_n", size)
    # as doubles: the product of three cell numbers is beyond 64 bits from about two million cells a group
    na, nb = F.col("_n.na").cast("double"), F.col("_n.nb").cast("double")
    z = (F.col("_w") - na * (na + nb + 1) / 2.0) / F.sqrt(na * nb * (na + nb + 1) / 12.0)
    scored = sums.select("gene_id", F.col("_w").alias("rank_sum"), z.alias("score")).withColumn("p", normal_p("score"))
    return adjust_p(scored.withColumn("grp", F.lit(a)), ["grp"])


def welch_markers(logged: DataFrame, cells: DataFrame, genes: DataFrame, label: str = "cell_type") -> DataFrame:
    """Every group against the rest: Welch t, p, adjusted p and log2 fold change.

    Group sums come from one aggregate; "rest" is total minus group.  The fold
    change compares expm1 of the two log means.
    """
    sizes = cells.groupBy(label).agg(F.count("*").alias("n"))
    groups = sizes.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("g"), "n")))).scalar()
    sums = (
        logged.join(cells.select("cell_id", label), "cell_id")
        .groupBy("gene_id", label)
        .agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
        .groupBy("gene_id")
        .agg(
            F.map_from_entries(F.collect_list(F.struct(F.col(label), F.struct("s", "q")))).alias("m"),
            F.sum("s").alias("ts"),
            F.sum("q").alias("tq"),
        )
    )
    base = genes.select("gene_id").join(sums, "gene_id").withColumn("_g", groups)
    total = F.aggregate("_g", F.lit(0).cast("bigint"), lambda t, g: t + g["n"])
    rows = base.withColumn("tn", total).withColumn("e", F.explode("_g"))
    own = F.try_element_at(F.col("m"), F.col("e.g"))
    zero = F.lit(0.0)
    rows = rows.select(
        F.col("e.g").alias(label),
        "gene_id",
        F.col("e.n").alias("n1"),
        (F.col("tn") - F.col("e.n")).alias("n2"),
        F.coalesce(own["s"], zero).alias("s1"),
        F.coalesce(own["q"], zero).alias("q1"),
        (F.col("ts") - F.coalesce(own["s"], zero)).alias("s2"),
        (F.col("tq") - F.coalesce(own["q"], zero)).alias("q2"),
    )
    m1, m2 = F.col("s1") / F.col("n1"), F.col("s2") / F.col("n2")
    rows = rows.withColumn("m1", m1).withColumn("m2", m2)
    v = lambda i: F.greatest((F.col(f"q{i}") - F.col(f"n{i}") * F.col(f"m{i}") * F.col(f"m{i}")) / (F.col(f"n{i}") - 1), zero)
    rows = rows.withColumn("e1", v(1) / F.col("n1")).withColumn("e2", v(2) / F.col("n2"))
    se2 = F.col("e1") + F.col("e2")
    t = F.when(se2 > 0, (F.col("m1") - F.col("m2")) / F.sqrt(se2)).otherwise(0.0)
    df = F.when(se2 > 0, se2 * se2 / (F.col("e1") * F.col("e1") / (F.col("n1") - 1) + F.col("e2") * F.col("e2") / (F.col("n2") - 1))).otherwise(1.0)
    fold = F.log2((F.expm1("m1") + 1e-9) / (F.expm1("m2") + 1e-9))
    scored = rows.select(label, "gene_id", t.alias("score"), df.alias("df"), fold.alias("log_fold")).withColumn("p", t_p("score", "df"))
    return adjust_p(scored, [label])


def significant_genes(markers: DataFrame, label: str = "cell_type", p: float = 1e-4, fold: float = 0.5, column: str = "p") -> DataFrame:
    """Ordered gene list per group with ``p`` below and |fold| above the limits."""
    kept = markers.where((F.col(column) < p) & (F.abs("log_fold") > fold))
    order = F.array_sort(F.collect_list(F.struct(F.negative("score").alias("k"), "gene_id")))
    return kept.groupBy(label).agg(F.transform(order, lambda e: e["gene_id"]).alias("genes"))
