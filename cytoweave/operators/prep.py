"""Matrix preparation on sparse counts ``(cell_id, gene_id, x)``; an absent row is zero.

Nothing here stores the dense matrix unless dense rows are the answer: zeros are
counted (n_cells - stored), and a centred matrix is kept as its stored entries plus
one value per gene for all absent entries.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vec as V
from ..functions.bounds import MAX_ELEMENTS
from ..session import cut_lineage

# genes of one block of a dense grid
GENE_BLOCK = 4096


def _n_cells(cells: DataFrame) -> Column:
    return cells.agg(F.count("*")).scalar()


# --- filters and quality ---------------------------------------------------------------------


def filter_cells(counts: DataFrame, min_genes: int = 200) -> DataFrame:
    """Cells with at least ``min_genes`` expressed genes."""
    rich = counts.where("x > 0").groupBy("cell_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_genes)
    return counts.join(rich.select("cell_id"), "cell_id", "left_semi")


def filter_genes(counts: DataFrame, min_cells: int = 3) -> DataFrame:
    """Genes expressed in at least ``min_cells`` cells."""
    seen = counts.where("x > 0").groupBy("gene_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_cells)
    return counts.join(seen.select("gene_id"), "gene_id", "left_semi")


def qc_metrics(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """Per cell: expressed genes, total counts, percent from ``mt`` genes (NULL without counts)."""
    tagged = counts.join(genes.select("gene_id", "mt"), "gene_id", "left")
    return tagged.groupBy("cell_id").agg(
        F.sum((F.col("x") > 0).cast("bigint")).alias("n_genes"),
        F.sum("x").alias("total_counts"),
        F.try_divide(F.sum(F.when(F.col("mt"), F.col("x")).otherwise(0.0)) * 100.0, F.sum("x")).alias("pct_counts_mt"),
    )


def qc_filter(qc: DataFrame, max_genes: int = 2500, max_pct_mt: float = 5.0) -> DataFrame:
    return qc.where((F.col("n_genes") < max_genes) & (F.col("pct_counts_mt") < max_pct_mt))


# --- scaling -----------------------------------------------------------------------------------


def normalize_total(counts: DataFrame, target: float = 1e4) -> DataFrame:
    """Scale each cell to ``target``; a cell holds at most one row per gene, so its window is bounded."""
    total = F.sum("x").over(Window.partitionBy("cell_id"))
    return counts.withColumn("_t", total).withColumn(
        "x", F.col("x") * target / F.when(F.col("_t") == 0, 1.0).otherwise(F.col("_t"))
    ).drop("_t")


def log1p(counts: DataFrame) -> DataFrame:
    """log(1 + x); zeros stay zero, so the matrix stays sparse."""
    return counts.withColumn("x", F.log1p("x"))


def gene_moments(counts: DataFrame, cells: DataFrame, value: Column | None = None) -> DataFrame:
    """Dense mean and sample variance of every stored gene."""
    v = F.col("x") if value is None else value
    n = _n_cells(cells)
    s = counts.groupBy("gene_id").agg(F.sum(v).alias("_s"), F.sum(v * v).alias("_q"))
    mean = F.col("_s") / n
    return s.select("gene_id", mean.alias("mean"), F.greatest((F.col("_q") - n * mean * mean) / (n - 1), F.lit(0.0)).alias("var"))


def dispersion_scores(logged: DataFrame, cells: DataFrame, bins: int = 20) -> DataFrame:
    """Normalised dispersion per gene of log1p data.

    mean and variance of expm1(x) over all cells; dispersion = var / mean; both
    logged (mean as log1p); genes fall into ``bins`` equal-width bins of log mean;
    score = (dispersion - bin mean) / bin sample deviation.  A bin of one gene scores
    1.  The moments are one pass over the counts, written as a gene-sized table that
    the range, the bins and the scores all read.
    """
    m = cut_lineage(gene_moments(logged, cells, F.expm1("x")))
    mean = F.when(F.col("mean") == 0, 1e-12).otherwise(F.col("mean"))
    d = m.select("gene_id", F.log1p(mean).alias("mean"), F.when(F.col("var") > 0, F.log(F.col("var") / mean)).alias("disp"))
    span = d.agg(F.struct(F.min("mean").alias("lo"), F.max("mean").alias("hi"))).scalar()
    d = d.withColumn("_s", span)
    pos = F.ceil((F.col("mean") - F.col("_s.lo")) / (F.col("_s.hi") - F.col("_s.lo")) * bins) - 1
    d = d.withColumn("bin", F.when(F.col("_s.hi") > F.col("_s.lo"), F.greatest(pos, F.lit(0))).otherwise(0).cast("int"))
    stats = d.groupBy("bin").agg(F.avg("disp").alias("_m"), F.stddev_samp("disp").alias("_d"))
    scored = d.join(stats, "bin")
    norm = F.when(F.col("_d").isNull() | (F.col("_d") == 0), F.when(F.col("disp").isNotNull(), 1.0)).otherwise(
        (F.col("disp") - F.col("_m")) / F.col("_d")
    )
    return scored.select("gene_id", "mean", "disp", "bin", norm.alias("disp_norm"))


def highly_variable(scores: DataFrame, min_mean: float = 0.0125, max_mean: float = 3.0, min_disp: float = 0.5) -> DataFrame:
    """Flag genes inside the mean range with a high normalised dispersion."""
    ok = (F.col("mean") > min_mean) & (F.col("mean") < max_mean) & (F.coalesce("disp_norm", F.lit(0.0)) > min_disp)
    return scores.withColumn("highly_variable", ok)


def top_variable(scores: DataFrame, n: int, column: str = "disp_norm") -> DataFrame:
    """Top ``n`` genes by score; a bounded sort of the gene table."""
    return scores.where(F.col(column).isNotNull()).orderBy(F.desc(column), "gene_id").limit(n)


def _global_fit(m: DataFrame) -> DataFrame:
    """``m`` with ``_v``, the variance that one quadratic over all genes expects (normal equations in closed form)."""
    fit = m.where((F.col("var") > 0) & (F.col("mean") > 0)).select(F.log10("mean").alias("x"), F.log10("var").alias("y"))
    centre = fit.agg(F.avg("x")).scalar()
    c = fit.withColumn("x", F.col("x") - centre)
    x, y = F.col("x"), F.col("y")
    sums = c.agg(
        F.struct(
            F.count("*").alias("n"),
            F.sum(x * x).alias("s2"),
            F.sum(x * x * x).alias("s3"),
            F.sum(x * x * x * x).alias("s4"),
            F.sum(y).alias("y0"),
            F.sum(x * y).alias("y1"),
            F.sum(x * x * y).alias("y2"),
        )
    ).scalar()
    g = m.withColumn("_f", sums).withColumn("_x", F.log10("mean") - centre)
    s2, s3, s4 = F.col("_f.s2"), F.col("_f.s3"), F.col("_f.s4")
    y0, y1, y2, k = F.col("_f.y0"), F.col("_f.y1"), F.col("_f.y2"), F.col("_f.n")
    quad = (y2 - s2 * y0 / k - s3 * y1 / s2) / (s4 - s2 * s2 / k - s3 * s3 / s2)
    g = g.withColumn("_c", quad)
    fitted = (y0 - s2 * F.col("_c")) / k + (y1 - s3 * F.col("_c")) / s2 * F.col("_x") + F.col("_c") * F.col("_x") * F.col("_x")
    return g.select("gene_id", "mean", "var", F.pow(F.lit(10.0), fitted).alias("_v"))


NEARLY_SINGULAR = 1e-9  # determinants below this share of their size leave the degree out


def _nearest_distance(x: np.ndarray, ends: np.ndarray, p: float, right: int, low: int, high: int, q: int) -> float:
    """Distance of the ``q``-th nearest x, each as often as it counts."""
    far = np.abs(x[low:high] - p)
    order = np.argsort(far, kind="stable")
    counts = np.diff(ends[low:high], prepend=ends[low - 1] if low else 0)
    return float(far[order[np.searchsorted(np.cumsum(counts[order]), q)]])


def local_quadratic(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float, times: np.ndarray | None = None) -> np.ndarray:
    """Local regression of ``y`` on ``x`` (ascending) at the points ``at``.

    The bandwidth at a point is the distance of its ``ceil(span * n)``-th nearest x; weights are tricube, the fit is a
    quadratic around the point, a line where the x with weight are too few or too close for it, and their mean where
    they do not even make a line.  A point that stands for several counts ``times``.
    """
    counts = np.ones(len(x), dtype=np.int64) if times is None else times
    ends = np.cumsum(counts)
    n = int(ends[-1]) if len(x) else 0
    q = min(n, max(1, int(np.ceil(span * n - 1e-9))))
    out = np.empty(len(at))
    for i, p in enumerate(at):
        right = int(np.searchsorted(x, p))
        before = int(ends[right - 1]) if right else 0
        # the points that hold the q nearest on either side
        low = int(np.searchsorted(ends, before - q, "right"))
        high = min(len(x), int(np.searchsorted(ends, before + q)) + 1)
        h = _nearest_distance(x, ends, p, right, low, high, q)
        # all within the bandwidth, however many share a distance
        low, high = (np.searchsorted(x, p - h, "left"), np.searchsorted(x, p + h, "right"))
        d = x[low:high] - p
        own = np.abs(d) < h
        if not own.any():  # a bandwidth of no width, or one that ends at the first x: those at its edge, alike
            own, u = np.abs(d) == h, np.zeros((np.abs(d) == h).sum())
        else:
            u = d[own] / h
        w, v = counts[low:high][own] * (1 - np.abs(u) ** 3) ** 3, y[low:high][own]
        s0, s1, s2, s3, s4 = (float((w * u**k).sum()) for k in range(5))
        t0, t1, t2 = (float((w * u**k * v).sum()) for k in range(3))
        det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
        line = s0 * s2 - s1 * s1
        if det > NEARLY_SINGULAR * s0**3:
            out[i] = (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / det
        elif line > NEARLY_SINGULAR * s0**2:
            out[i] = (t0 * s2 - t1 * s1) / line
        else:
            out[i] = t0 / s0
    return out


def _local_fit(m: DataFrame, span: float) -> DataFrame:
    """``m`` with ``_v``, the variance that genes of a similar mean lead one to expect.

    Genes of one mean and variance are one point that counts as often, and every different mean is fitted once.
    Three numbers per point go to the tasks, counted first; each task fits its own means.
    """
    fit = m.where((F.col("var") > 0) & (F.col("mean") > 0)).select(F.log10("mean").alias("x"), F.log10("var").alias("y"))
    fit = cut_lineage(fit.groupBy("x", "y").agg(F.count("*").alias("n")))
    n = fit.count()
    if 3 * n > MAX_ELEMENTS:
        raise ValueError(f"{n} genes are beyond what a local fit sends to every task; select genes first")
    found = fit.toArrow()
    x, y, times = (found.column(c).to_numpy() for c in ("x", "y", "n"))
    order = np.lexsort((y, x))
    x, y, times = x[order], y[order], times[order]

    def expected(column: pa.Array) -> pa.Array:
        mean = column.to_numpy(zero_copy_only=False)
        out = np.full(len(mean), np.nan)
        known = (mean > 0) & bool(len(x))
        out[known] = 10.0 ** local_quadratic(x, y, np.log10(mean[known]), span, times)
        return pa.array(out, mask=~known)

    means = m.select("mean").distinct().repartition(max(8, n // 250), "mean")
    fitted = means.select(F.col("mean").alias("_m"), F.arrow_udf(expected, T.DoubleType())("mean").alias("_v"))
    return m.join(cut_lineage(fitted), F.col("mean").eqNullSafe(F.col("_m"))).select("gene_id", "mean", "var", "_v")


def stabilised_variance(counts: DataFrame, cells: DataFrame, span: float | None = 0.3) -> DataFrame:
    """Variance of standardised, clipped counts per gene.

    The expected log10 variance comes from the genes with a similar log10 mean: a quadratic by local weighted least squares
    (:func:`local_quadratic`) over the ``span`` nearest share of genes, or one quadratic over all genes if ``span`` is None.
    Counts are clipped at mean + sqrt(n) * expected deviation.  Zeros enter through their number only.
    Two passes over the counts: moments (written, gene-sized), then clipped sums.
    """
    n = _n_cells(cells)
    m = cut_lineage(gene_moments(counts, cells))
    g = _global_fit(m) if span is None else _local_fit(m, span)
    limit = F.col("mean") + F.sqrt(n * F.col("_v"))
    clipped = counts.join(g, "gene_id").withColumn("_x", F.least("x", limit))
    per = clipped.groupBy("gene_id").agg(
        F.first("mean").alias("mean"), F.first("var").alias("var"), F.first("_v").alias("_v"),
        F.sum("_x").alias("_s"), F.sum(F.col("_x") * F.col("_x")).alias("_q"),
    )
    norm = (n * F.col("mean") * F.col("mean") + F.col("_q") - 2 * F.col("mean") * F.col("_s")) / ((n - 1) * F.col("_v"))
    return per.select("gene_id", "mean", "var", norm.alias("var_norm"))


# --- dense steps -----------------------------------------------------------------------------------


def dense_vectors(counts: DataFrame, gene: str, genes: Sequence, cells: DataFrame) -> DataFrame:
    """``(cell_id, vec)`` over an explicit gene list: one row for every cell of ``cells``, zeros included."""
    entries = F.map_from_entries(F.collect_list(F.struct(gene, "x")))
    own = counts.where(F.col(gene).isin(list(genes))).groupBy("cell_id").agg(entries.alias("_m"))
    value = lambda g: F.coalesce(F.try_element_at(F.col("_m"), g), F.lit(0.0))
    full = cells.select("cell_id").join(own, "cell_id", "left")
    return full.select("cell_id", F.transform(F.lit(list(genes)), value).alias("vec"))


def dense_rows(counts: DataFrame, cells: DataFrame, per_gene: DataFrame, gene: str, columns: Sequence[str], block: int = GENE_BLOCK) -> DataFrame:
    """One row per (cell, gene) of ``per_gene``, zeros included, with the gene's columns.

    Genes are dealt into blocks of about ``block``; a cell is exploded over the block numbers, joined
    with each block's array and its own entries of that block, and exploded once more.  So no array
    grows with the number of genes.
    """
    n_blocks = int(per_gene.count() // block) + 1
    number = F.pmod(F.xxhash64(gene), F.lit(n_blocks)).cast("int")
    blocks = per_gene.groupBy(number.alias("_block")).agg(F.array_sort(F.collect_list(F.struct(gene, *columns))).alias("_list"))
    own = counts.groupBy("cell_id", number.alias("_block")).agg(F.map_from_entries(F.collect_list(F.struct(gene, "x"))).alias("_m"))
    grid = cells.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    grid = grid.join(own, ["cell_id", "_block"], "left").join(blocks, "_block").withColumn("_g", F.explode("_list"))
    value = F.coalesce(F.try_element_at(F.col("_m"), F.col("_g")[gene]), F.lit(0.0))
    return grid.select(
        *cells.columns, F.col("_g")[gene].alias(gene), value.alias("x"), *[F.col("_g")[c].alias(c) for c in columns]
    )


def regression_coefficients(counts: DataFrame, covariates: DataFrame, z1: str, z2: str, gene: str = "gene_id") -> DataFrame:
    """Least squares of every gene on two shared covariates, from grouped sums only.

    Covariates are centred, so absent entries add nothing to the cross sums and the
    normal equations are 2 x 2.  Output: gene, mean, b1, b2, c1, c2 (covariate means).
    """
    centre = covariates.agg(F.struct(F.avg(z1).alias("c1"), F.avg(z2).alias("c2"), F.count("*").alias("n"))).scalar()
    z = covariates.select("cell_id", F.col(z1).alias("_z1"), F.col(z2).alias("_z2")).withColumn("_c", centre)
    z = z.select("cell_id", (F.col("_z1") - F.col("_c.c1")).alias("_z1"), (F.col("_z2") - F.col("_c.c2")).alias("_z2"))
    shape = z.agg(
        F.struct(
            F.sum(F.col("_z1") * F.col("_z1")).alias("s11"),
            F.sum(F.col("_z2") * F.col("_z2")).alias("s22"),
            F.sum(F.col("_z1") * F.col("_z2")).alias("s12"),
        )
    ).scalar()
    sums = counts.join(z, "cell_id").groupBy(gene).agg(
        F.sum("x").alias("_s"), F.sum(F.col("x") * F.col("_z1")).alias("_t1"), F.sum(F.col("x") * F.col("_z2")).alias("_t2")
    )
    s = sums.withColumn("_h", shape).withColumn("_c", centre)
    s11, s22, s12 = F.col("_h.s11"), F.col("_h.s22"), F.col("_h.s12")
    det = s11 * s22 - s12 * s12
    good = det > 1e-12 * s11 * s22
    b1 = F.when(good, (F.col("_t1") * s22 - F.col("_t2") * s12) / det).otherwise(F.coalesce(F.try_divide("_t1", s11), F.lit(0.0)))
    b2 = F.when(good, (F.col("_t2") * s11 - F.col("_t1") * s12) / det).otherwise(F.lit(0.0))
    return s.select(
        gene, (F.col("_s") / F.col("_c.n")).alias("mean"), b1.alias("b1"), b2.alias("b2"),
        F.col("_c.c1").alias("c1"), F.col("_c.c2").alias("c2"),
    )


def regress_out(counts: DataFrame, covariates: DataFrame, z1: str, z2: str, gene: str = "gene_id") -> DataFrame:
    """Dense residuals after removing two covariates from every gene."""
    coef = regression_coefficients(counts, covariates, z1, z2, gene)
    rows = dense_rows(counts, covariates.select("cell_id", z1, z2), coef, gene, ["mean", "b1", "b2", "c1", "c2"])
    fitted = F.col("mean") + F.col("b1") * (F.col(z1) - F.col("c1")) + F.col("b2") * (F.col(z2) - F.col("c2"))
    return rows.select("cell_id", gene, (F.col("x") - fitted).alias("x"))


def scale_parameters(counts: DataFrame, cells: DataFrame, max_value: float = 10.0, gene: str = "gene_id") -> DataFrame:
    """Per gene mean, deviation (0 becomes 1) and the scaled value of an absent entry."""
    m = gene_moments(counts.withColumnRenamed(gene, "gene_id"), cells).withColumnRenamed("gene_id", gene)
    sd = F.when(F.col("var") > 0, F.sqrt("var")).otherwise(1.0)
    return m.select(gene, "mean", sd.alias("sd"), F.least(-F.col("mean") / sd, F.lit(max_value)).alias("zero_value"))


def scale_sparse(counts: DataFrame, parameters: DataFrame, max_value: float = 10.0, gene: str = "gene_id") -> DataFrame:
    """Stored entries z-scored and clipped above; absent ones are ``zero_value`` of their gene."""
    z = F.least((F.col("x") - F.col("mean")) / F.col("sd"), F.lit(max_value))
    return counts.join(parameters, gene).select("cell_id", gene, z.alias("x"), "zero_value")


def scale_dense(counts: DataFrame, cells: DataFrame, max_value: float = 10.0, gene: str = "gene_id") -> DataFrame:
    """Dense z-scores per gene, clipped above (use after gene selection)."""
    p = scale_parameters(counts, cells, max_value, gene)
    rows = dense_rows(counts, cells.select("cell_id"), p, gene, ["mean", "sd"])
    return rows.select("cell_id", gene, F.least((F.col("x") - F.col("mean")) / F.col("sd"), F.lit(max_value)).alias("x"))


def pca(df: DataFrame, k: int, vec: str = "vec") -> tuple[DataFrame, list[float]]:
    """``k`` principal component scores of ``(cell_id, vec)`` and their variance shares.

    Vectors are centred; the largest loading of each component (by absolute value)
    is made positive.  The covariance is a tree-aggregated d x d matrix.
    """
    from pyspark.ml.feature import PCA

    mean = df.agg(V.mean_vector(vec).alias("m")).first()["m"]
    mu = np.array(mean)
    feats = df.withColumn("_f", array_to_vector(F.col(vec)))
    model = PCA(k=k, inputCol="_f", outputCol="_o").fit(feats)
    load = model.pc.toArray()
    load = load * np.where(load[np.abs(load).argmax(0), np.arange(load.shape[1])] < 0, -1.0, 1.0)

    def project(col: pa.Array) -> pa.Array:
        x = V.matrix(col)
        return V.row_lists((x - mu) @ load if len(x) else np.zeros((0, load.shape[1])))

    scores = df.withColumn(vec, F.arrow_udf(project, T.ArrayType(T.DoubleType()))(vec))
    return scores, [float(v) for v in model.explainedVariance.toArray()]


def marker_matrix(counts: DataFrame, cells: DataFrame, genes: DataFrame, names: Sequence[str], centre: bool = False) -> DataFrame:
    """Cells x named genes (zeros filled), optionally minus the column mean."""
    picked = counts.join(genes.where(F.col("gene_name").isin(list(names))).select("gene_id", "gene_name"), "gene_id")
    wide = picked.groupBy("cell_id").pivot("gene_name", list(names)).agg(F.sum("x"))
    full = cells.select("cell_id").join(wide, "cell_id", "left").na.fill(0.0)
    if not centre:
        return full
    means = full.agg(F.struct(*[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(names)])).scalar()
    full = full.withColumn("_m", means)
    return full.select("cell_id", *[(F.col(f"`{c}`") - F.col("_m")[f"m{i}"]).alias(c) for i, c in enumerate(names)])


# --- the conditional chain --------------------------------------------------------------------------


@dataclass(frozen=True)
class Prepared:
    """Scaled matrix in sparse form with the log of what was done.

    ``counts(cell_id, gene_id, x)`` are stored entries, ``genes`` carries
    ``zero_value`` for absent ones and ``highly_variable``.
    """

    counts: DataFrame
    cells: DataFrame
    genes: DataFrame
    log: DataFrame


def preprocess(
    counts: DataFrame,
    cells: DataFrame,
    genes: DataFrame,
    order: str = "reference",
    min_genes: int = 200,
    min_cells: int = 3,
    max_value: float = 10.0,
    scaled: bool = False,
) -> Prepared:
    """Look at the data once, then clean, normalise, log, select, scale and filter as needed.

    ``order='reference'`` never logs data that has a zero and filters after scaling;
    ``order='standard'`` filters first and logs counts.
    """
    log: list[str] = []
    missing = F.col("x").isNull() | F.isnan("x")
    clean = counts.withColumn("x", F.when(missing, 0.0).otherwise(F.col("x")))
    if order == "standard":
        # every later look reads the filtered matrix: write it once
        clean = cut_lineage(filter_genes(filter_cells(clean, min_genes), min_cells))
        cells = cells.join(clean.select("cell_id").distinct(), "cell_id", "left_semi")
        genes = genes.join(clean.select("gene_id").distinct(), "gene_id", "left_semi")
    facts = clean.agg(
        F.sum("x").alias("total"), F.max("x").alias("top"), F.sum((F.col("x") <= 0).cast("bigint")).alias("low"), F.count("*").alias("stored")
    ).first()
    complete = counts.where(missing).isEmpty()
    n, g = cells.count(), genes.count()
    log.append("missing: none" if complete else "missing: filled with 0")
    if order == "standard":
        log.append("filter: first")
    mean_total, top = (facts["total"] or 0.0) / max(n, 1), facts["top"] or 0.0
    if abs(mean_total - 1e4) <= 500 + 1e-5 * 1e4:
        log.append("normalize: already")
    elif top > 100 or order == "standard":
        clean = normalize_total(clean)
        top = clean.agg(F.max("x")).first()[0] or 0.0
        log.append("normalize: to 10000")
    else:
        log.append("normalize: skipped, looks logged")
    has_zero = (facts["low"] or 0) > 0 or facts["stored"] < n * g
    if order == "reference" and has_zero:
        log.append("log1p: skipped, zero or negative values")
    elif top > 100:
        clean = log1p(clean)
        log.append("log1p: applied")
    else:
        log.append("log1p: already")
    if "highly_variable" in genes.columns:
        log.append("variable genes: already")
        flagged = genes
    else:
        hv = highly_variable(dispersion_scores(clean, cells)).select("gene_id", "highly_variable")
        flagged = genes.join(hv, "gene_id", "left").withColumn("highly_variable", F.coalesce("highly_variable", F.lit(False)))
        log.append("variable genes: found")
    if scaled:
        log.append("scale: already")
        out = clean
        flagged = flagged.withColumn("zero_value", F.lit(0.0))
    else:
        par = scale_parameters(clean, cells, max_value)
        out = scale_sparse(clean, par, max_value).select("cell_id", "gene_id", "x")
        flagged = flagged.join(par.select("gene_id", "zero_value"), "gene_id", "left").withColumn(
            "zero_value", F.coalesce("zero_value", F.lit(0.0))
        )
        log.append("scale: applied")
    if order == "reference":
        out, cells, flagged = _filter_scaled(out, cells, flagged, min_genes, min_cells)
        log.append("filter: last")
    rows = [(i, a) for i, a in enumerate(log)]
    return Prepared(out, cells, flagged, counts.sparkSession.createDataFrame(rows, "step int, action string"))


def _filter_scaled(counts, cells, genes, min_genes, min_cells):
    """Cell and gene filters on a scaled matrix: positive entries, absent ones by ``zero_value``."""
    zero = genes.select("gene_id", (F.col("zero_value") > 0).cast("bigint").alias("_z"))
    lifted = zero.agg(F.sum("_z")).scalar()
    tagged = counts.join(zero, "gene_id").withColumn("_p", (F.col("x") > 0).cast("bigint") - F.col("_z"))
    per_cell = tagged.groupBy("cell_id").agg(F.sum("_p").alias("_d"))
    kept = cells.join(per_cell, "cell_id", "left").where(F.coalesce("_d", F.lit(0)) + lifted >= min_genes).drop("_d")
    counts = counts.join(kept.select("cell_id"), "cell_id", "left_semi")
    n = kept.agg(F.count("*")).scalar()
    per_gene = counts.groupBy("gene_id").agg(F.count("*").alias("_n"), F.sum((F.col("x") > 0).cast("bigint")).alias("_p"))
    expressed = F.coalesce("_p", F.lit(0)) + F.when(F.col("zero_value") > 0, n - F.coalesce("_n", F.lit(0))).otherwise(0)
    good = genes.join(per_gene, "gene_id", "left").where(expressed >= min_cells).drop("_n", "_p")
    return counts.join(good.select("gene_id"), "gene_id", "left_semi"), kept, good
