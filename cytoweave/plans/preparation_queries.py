"""Matrix preparation and differential expression."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import differential, prep, principal
from . import tables as t
from .registry import query, rounded

WC = t.WITH_COUNTS


def z6(x: str) -> str:
    """Round in SQL without a negative zero."""
    return f"CASE WHEN abs({x}) < 5e-7 THEN 0.0 ELSE round({x}, 6) END"


@query("filter_cells", "G1", f"{WC} SELECT * FROM counts WHERE cell_id IN (SELECT cell_id FROM counts WHERE x > 0 GROUP BY 1 HAVING count(*) >= 4)")
def filter_cells(spark, sf):
    return prep.filter_cells(t.counts(spark, sf), 4)


@query("filter_genes", "G2", f"{WC} SELECT * FROM counts WHERE gene_id IN (SELECT gene_id FROM counts WHERE x > 0 GROUP BY 1 HAVING count(*) >= 30)")
def filter_genes(spark, sf):
    return prep.filter_genes(t.counts(spark, sf), 30)


QC = """qc AS (SELECT cell_id, count(*) FILTER (x > 0) AS n_genes, sum(x) AS total_counts,
  coalesce(sum(x) FILTER (mt), 0) * 100 / sum(x) AS pct_counts_mt FROM counts LEFT JOIN genes USING (gene_id) GROUP BY 1)"""


@query("qc_metrics", "G3", f"{WC}, {QC} SELECT cell_id, n_genes, total_counts, round(pct_counts_mt, 6) AS pct_counts_mt FROM qc")
def qc_metrics(spark, sf):
    return rounded(prep.qc_metrics(t.counts(spark, sf), t.genes(spark, sf)))


@query("qc_filter", "G4", f"{WC}, {QC} SELECT cell_id, n_genes, total_counts, round(pct_counts_mt, 6) AS pct_counts_mt FROM qc WHERE n_genes < 6 AND pct_counts_mt < 50")
def qc_filter(spark, sf):
    return rounded(prep.qc_filter(prep.qc_metrics(t.counts(spark, sf), t.genes(spark, sf)), 6, 50.0))


NORM = "nrm AS (SELECT cell_id, gene_id, x * 10000 / sum(x) OVER (PARTITION BY cell_id) AS x FROM counts)"
LOGGED = f"{NORM}, lg AS (SELECT cell_id, gene_id, ln(1 + x) AS x FROM nrm)"


@query("normalize_total", "G5", f"{WC}, {NORM} SELECT cell_id, gene_id, round(x, 6) AS x FROM nrm")
def normalize_total(spark, sf):
    return rounded(prep.normalize_total(t.counts(spark, sf)))


def _logged(spark, sf):
    return prep.log1p(prep.normalize_total(t.counts(spark, sf)))


@query("log1p", "G6", f"{WC}, {LOGGED} SELECT cell_id, gene_id, round(x, 6) AS x FROM lg")
def log1p(spark, sf):
    return rounded(_logged(spark, sf))


def moments_sql(src: str, name: str, expr: str = "x", cells: str = "cells") -> str:
    n = f"(SELECT count(*) FROM {cells})"
    return f"""{name} AS (SELECT gene_id, sum({expr}) / {n} AS mean,
      greatest((sum({expr} * {expr}) - {n} * (sum({expr}) / {n}) ** 2) / ({n} - 1), 0) AS var FROM {src} GROUP BY 1)"""


HVG = f"""{LOGGED}, {moments_sql('lg', 'mo', '(exp(x) - 1)')},
dd AS (SELECT gene_id, ln(1 + CASE WHEN mean = 0 THEN 1e-12 ELSE mean END) AS mean, CASE WHEN var > 0 THEN ln(var / mean) END AS disp FROM mo),
bb AS (SELECT *, greatest(ceil((mean - min(mean) OVER ()) / (max(mean) OVER () - min(mean) OVER ()) * 20) - 1, 0)::INT AS bin FROM dd),
st AS (SELECT bin, avg(disp) AS m, stddev_samp(disp) AS d FROM bb GROUP BY 1),
hv AS (SELECT gene_id, mean, disp, bin, CASE WHEN d IS NULL OR d = 0 THEN CASE WHEN disp IS NOT NULL THEN 1.0::DOUBLE END ELSE (disp - m) / d END AS disp_norm
       FROM bb JOIN st USING (bin))"""


def _scores(spark, sf):
    return prep.dispersion_scores(_logged(spark, sf), t.count_cells(spark, sf))


@query(
    "variable_genes",
    "G7",
    f"""{WC}, {HVG} SELECT gene_id, round(mean, 6) AS mean, {z6('disp')} AS disp, bin, {z6('disp_norm')} AS disp_norm,
        mean > 0.0125 AND mean < 3 AND coalesce(disp_norm, 0) > 0.5 AS highly_variable FROM hv""",
)
def variable_genes(spark, sf):
    return rounded(prep.highly_variable(_scores(spark, sf)))


@query("top_variable_genes", "G8", f"{WC}, {HVG} SELECT gene_id, round(disp_norm, 6) AS disp_norm FROM hv WHERE disp_norm IS NOT NULL ORDER BY hv.disp_norm DESC, gene_id LIMIT 100")
def top_variable_genes(spark, sf):
    return rounded(prep.top_variable(_scores(spark, sf), 100).select("gene_id", "disp_norm"))


@query(
    "stabilised_variance",
    "G9",
    f"""{WC}, {moments_sql('counts', 'mo')},
        ft AS (SELECT gene_id, log10(mean) AS x0, log10(var) AS y FROM mo WHERE var > 0 AND mean > 0),
        ct AS (SELECT avg(x0) AS c FROM ft),
        sm AS (SELECT count(*) AS n, sum((x0 - c) ** 2) AS s2, sum((x0 - c) ** 3) AS s3, sum((x0 - c) ** 4) AS s4, sum(y) AS y0,
               sum((x0 - c) * y) AS y1, sum((x0 - c) ** 2 * y) AS y2, any_value(c) AS c FROM ft, ct),
        qd AS (SELECT *, (y2 - s2 * y0 / n - s3 * y1 / s2) / (s4 - s2 * s2 / n - s3 * s3 / s2) AS q FROM sm),
        ev AS (SELECT gene_id, mean, var, pow(10, (y0 - s2 * q) / n + (y1 - s3 * q) / s2 * (log10(mean) - c) + q * (log10(mean) - c) ** 2) AS v FROM mo, qd),
        cl AS (SELECT gene_id, mean, var, v, least(x, mean + sqrt((SELECT count(*) FROM cells) * v)) AS x FROM counts JOIN ev USING (gene_id)),
        nn AS (SELECT (SELECT count(*) FROM cells) AS n)
        SELECT gene_id, round(any_value(mean), 6) AS mean, round(any_value(var), 6) AS var,
               round((any_value(n) * any_value(mean) ** 2 + sum(x * x) - 2 * any_value(mean) * sum(x)) / ((any_value(n) - 1) * any_value(v)), 6) AS var_norm
        FROM cl, nn GROUP BY 1""",
)
def stabilised_variance(spark, sf):
    return rounded(prep.stabilised_variance(t.counts(spark, sf), t.count_cells(spark, sf), span=None))


_U = "(x - p) / h"
_LOCAL = f"""ft AS (SELECT log10(mean) AS x, log10(var) AS y FROM mo WHERE var > 0 AND mean > 0),
        pt AS (SELECT DISTINCT log10(mean) AS p FROM mo WHERE mean > 0),
        nr AS (SELECT p, x, y, abs(x - p) AS d, row_number() OVER (PARTITION BY p ORDER BY abs(x - p)) AS r FROM pt, ft),
        bw AS (SELECT p, max(d) AS h FROM nr WHERE r <= ceil(0.3 * (SELECT count(*) FROM ft) - 1e-9) GROUP BY 1),
        wt AS (SELECT p, CASE WHEN h > 0 THEN {_U} ELSE 0 END AS u, y, CASE WHEN h > 0 THEN (1 - abs({_U}) ** 3) ** 3 ELSE 1 END AS w
               FROM nr JOIN bw USING (p) WHERE d < h OR (h = 0 AND d = 0)),
        sm AS (SELECT p, sum(w) AS s0, sum(w * u) AS s1, sum(w * u ** 2) AS s2, sum(w * u ** 3) AS s3, sum(w * u ** 4) AS s4,
               sum(w * y) AS t0, sum(w * u * y) AS t1, sum(w * u ** 2 * y) AS t2 FROM wt GROUP BY 1),
        dt AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det, s0 * s2 - s1 * s1 AS line FROM sm),
        lf AS (SELECT p, pow(10, CASE WHEN det > 1e-9 * s0 ** 3 THEN (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / det
               WHEN line > 1e-9 * s0 ** 2 THEN (t0 * s2 - t1 * s1) / line ELSE t0 / s0 END) AS v FROM dt)"""


@query(
    "local_stabilised_variance",
    "G9",
    f"""{WC}, {moments_sql('counts', 'mo')}, {_LOCAL},
        cl AS (SELECT gene_id, mean, var, v, least(x, mean + sqrt((SELECT count(*) FROM cells) * v)) AS x
               FROM counts JOIN mo USING (gene_id) LEFT JOIN lf ON p = log10(mean)),
        nn AS (SELECT (SELECT count(*) FROM cells) AS n)
        SELECT gene_id, round(any_value(mean), 6) AS mean, round(any_value(var), 6) AS var,
               round((any_value(n) * any_value(mean) ** 2 + sum(x * x) - 2 * any_value(mean) * sum(x)) / ((any_value(n) - 1) * any_value(v)), 6) AS var_norm
        FROM cl, nn GROUP BY 1""",
)
def local_stabilised_variance(spark, sf):
    """Expected variances from the three tenths of genes with the nearest means."""
    return rounded(prep.stabilised_variance(t.counts(spark, sf), t.count_cells(spark, sf)))


def _event_covariates(spark, sf):
    """Per user: total events and percent errors."""
    return (
        t.table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("cell_id"))
        .agg(
            F.count("*").cast("double").alias("total"),
            (F.sum((F.col("event_type") == "error").cast("double")) * 100 / F.count("*")).alias("pct"),
        )
    )


@query(
    "regress_out",
    "G10",
    f"""WITH {t.EVENT_GRID},
        cv AS (SELECT user_id AS cell_id, count(*)::DOUBLE AS z1, count(*) FILTER (event_type = 'error') * 100.0::DOUBLE / count(*) AS z2 FROM events GROUP BY 1),
        j AS (SELECT g.cell_id, gene, x, z1 - (SELECT avg(z1) FROM cv) AS z1, z2 - (SELECT avg(z2) FROM cv) AS z2 FROM grid g JOIN cv USING (cell_id)),
        s AS (SELECT gene, avg(x) AS m, sum(z1 * z1) AS s11, sum(z2 * z2) AS s22, sum(z1 * z2) AS s12, sum(x * z1) AS t1, sum(x * z2) AS t2 FROM j GROUP BY 1)
        SELECT cell_id, gene, {z6('x - m - (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) * z1 - (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) * z2')} AS x
        FROM j JOIN s USING (gene)""",
)
def regress_out(spark, sf):
    ec = t.event_counts(spark, sf)
    return rounded(prep.regress_out(ec, _event_covariates(spark, sf), "total", "pct", gene="gene"))


@query(
    "scale_dense",
    "G11",
    f"""WITH {t.EVENT_GRID}, s AS (SELECT gene, avg(x) AS m, stddev_samp(x) AS d FROM grid GROUP BY 1)
        SELECT cell_id, gene, {z6('least((x - m) / CASE WHEN d > 0 THEN d ELSE 1 END, 10)')} AS x FROM grid JOIN s USING (gene)""",
)
def scale_dense(spark, sf):
    ec = t.event_counts(spark, sf)
    return rounded(prep.scale_dense(ec, ec.select("cell_id").distinct(), gene="gene"))


@query(
    "scale_sparse",
    "G11",
    f"""{WC}, {LOGGED}, {moments_sql('lg', 'mo')}, p AS (SELECT gene_id, mean, CASE WHEN var > 0 THEN sqrt(var) ELSE 1 END AS sd FROM mo)
        SELECT cell_id, gene_id, round(least((x - mean) / sd, 10), 6) AS x, round(least(-mean / sd, 10), 6) AS zero_value FROM lg JOIN p USING (gene_id)""",
)
def scale_sparse(spark, sf):
    logged = _logged(spark, sf)
    return rounded(prep.scale_sparse(logged, prep.scale_parameters(logged, t.count_cells(spark, sf))))


@query("pca_scores", "G12")
def pca_scores(spark, sf):
    scores, _ = prep.pca(t.emb(spark, sf).select("cell_id", "vec"), 10)
    return rounded(scores.select("cell_id", F.posexplode("vec").alias("component", "value")), 5)


@query("pca_variable_genes", "G12")
def pca_variable_genes(spark, sf):
    """Components of the log counts on the most variable genes."""
    logged = _logged(spark, sf)
    top = [r[0] for r in prep.top_variable(prep.dispersion_scores(logged, t.count_cells(spark, sf)), 50).select("gene_id").collect()]
    scores, _ = prep.pca(prep.dense_vectors(logged, "gene_id", top, t.count_cells(spark, sf)), 5)
    return rounded(scores.select("cell_id", F.posexplode("vec").alias("component", "value")), 5)


@query(
    "component_moments",
    "G12",
    f"""WITH {t.EVENT_GRID}, mu AS (SELECT gene, avg(x) AS m FROM grid GROUP BY 1), ct AS (SELECT cell_id, gene, x - m AS x FROM grid JOIN mu USING (gene)),
        cv AS (SELECT a.gene AS g, b.gene AS h, sum(a.x * b.x) / (count(*) - 1) AS c FROM ct a JOIN ct b USING (cell_id) GROUP BY 1, 2),
        sq AS (SELECT a.g, b.h, sum(a.c * b.c) AS c FROM cv a JOIN cv b ON a.h = b.g GROUP BY 1, 2)
        SELECT (SELECT count(DISTINCT gene) FROM grid) AS n_components, round(sum(c) FILTER (WHERE g = h), 6) AS total,
               round(sum(c * c), 6) AS squares, (SELECT round(sum(sq.c * cv.c), 4) FROM sq JOIN cv ON sq.g = cv.g AND sq.h = cv.h) AS cubes FROM cv""",
)
def component_moments(spark, sf):
    """Sums of the first three powers of all component variances; the covariance matrix has the same traces."""
    counts = t.event_counts(spark, sf)
    found = principal.principal_components(counts, counts.select("cell_id").distinct(), 64, gene="gene")
    v = found.variances
    row = (len(v), *[round(sum(x**p for x in v), digits) for p, digits in ((1, 6), (2, 6), (3, 4))])
    return spark.createDataFrame([row], "n_components bigint, total double, squares double, cubes double")


@query(
    "component_scores",
    "G12",
    f"""{t.WITH_COUNTS}, n AS (SELECT count(*) AS n FROM cells), lg AS (SELECT cell_id, gene_id, ln(1 + x) AS x FROM counts),
        v AS (SELECT (sum(x * x) - sum(x) ** 2 / (SELECT n FROM n)) / ((SELECT n FROM n) - 1) AS v FROM lg GROUP BY gene_id)
        SELECT (SELECT n FROM n) AS n_cells, 3::BIGINT AS n_components, (SELECT round(sum(v), 4) FROM v) AS total_variance, true AS orthonormal, true AS captured""",
)
def component_scores(spark, sf):
    """Components of the log counts over all genes: the scores' variances are those of the components, without correlation."""
    logged = prep.log1p(t.counts(spark, sf))
    cells = t.count_cells(spark, sf).select("cell_id")
    found = principal.principal_components(logged, cells, 3, tolerance=1e-6)
    load = found.loadings.select(*[F.col("loading")[i].alias(f"l{i}") for i in range(3)])
    dots = load.agg(*[F.sum(F.col(f"l{i}") * F.col(f"l{j}")).alias(f"d{i}{j}") for i in range(3) for j in range(i, 3)])
    unit = F.lit(True)
    for i in range(3):
        for j in range(i, 3):
            unit = unit & (F.abs(F.col(f"d{i}{j}") - float(i == j)) < 1e-9)
    scores = found.scores(cells).select(*[F.col("vec")[i].alias(f"s{i}") for i in range(3)])
    same = F.lit(True)
    for i, v in enumerate(found.variances):
        same = same & (F.abs(F.var_samp(f"s{i}") / v - 1) < 1e-9) & (F.abs(F.avg(f"s{i}")) < 1e-6)
    facts = scores.agg(F.count("*").alias("n_cells"), same.alias("captured"))
    return rounded(
        facts.withColumn("orthonormal", dots.select(unit.alias("u")).scalar()).select(
            "n_cells", F.lit(len(found.variances)).cast("bigint").alias("n_components"), F.lit(found.total_variance).alias("total_variance"), "orthonormal", "captured"
        ),
        4,
    )


_STD = f"""{t.WITH_COUNTS}, fc AS (SELECT * FROM counts WHERE cell_id IN (SELECT cell_id FROM counts WHERE x > 0 GROUP BY 1 HAVING count(*) >= 2)),
fg AS (SELECT * FROM fc WHERE gene_id IN (SELECT gene_id FROM fc WHERE x > 0 GROUP BY 1 HAVING count(*) >= 3)),
kept AS (SELECT DISTINCT cell_id FROM fg),
nrm AS (SELECT cell_id, gene_id, x * 10000 / sum(x) OVER (PARTITION BY cell_id) AS x FROM fg),
lg AS (SELECT cell_id, gene_id, ln(1 + x) AS x FROM nrm), {moments_sql('lg', 'mo', cells='kept')},
p AS (SELECT gene_id, mean, CASE WHEN var > 0 THEN sqrt(var) ELSE 1 END AS sd FROM mo)"""


@query("preprocess_standard", "G13", f"{_STD} SELECT cell_id, gene_id, round(least((x - mean) / sd, 10), 6) AS x FROM lg JOIN p USING (gene_id)")
def preprocess_standard(spark, sf):
    out = prep.preprocess(t.counts(spark, sf), t.count_cells(spark, sf), t.genes(spark, sf), "standard", min_genes=2, min_cells=3)
    return rounded(out.counts)


@query(
    "preprocess_reference",
    "G13",
    f"""{WC}, {moments_sql('counts', 'mo')},
        p AS (SELECT gene_id, mean, CASE WHEN var > 0 THEN sqrt(var) ELSE 1 END AS sd FROM mo),
        sc AS (SELECT cell_id, gene_id, least((x - mean) / sd, 10) AS x FROM counts JOIN p USING (gene_id)),
        kc AS (SELECT cell_id FROM sc WHERE x > 0 GROUP BY 1 HAVING count(*) >= 2),
        s2 AS (SELECT * FROM sc WHERE cell_id IN (SELECT cell_id FROM kc)),
        kg AS (SELECT gene_id FROM s2 WHERE x > 0 GROUP BY 1 HAVING count(*) >= 3)
        SELECT cell_id, gene_id, round(x, 6) AS x FROM s2 WHERE gene_id IN (SELECT gene_id FROM kg)""",
)
def preprocess_reference(spark, sf):
    """Small counts pass for logged data: only scaled, then filtered."""
    out = prep.preprocess(t.counts(spark, sf), t.count_cells(spark, sf), t.genes(spark, sf), "reference", min_genes=2, min_cells=3)
    return rounded(out.counts)


@query(
    "preprocess_log",
    "G13",
    f"""{WC}, f AS (SELECT sum(x) AS total, max(x) AS top, count(*) AS stored FROM counts)
        SELECT 0 AS step, 'missing: none' AS action UNION ALL
        SELECT 1, CASE WHEN abs(total / (SELECT count(*) FROM cells) - 10000) <= 500.1 THEN 'normalize: already'
                       WHEN top > 100 THEN 'normalize: to 10000' ELSE 'normalize: skipped, looks logged' END FROM f UNION ALL
        SELECT 2, 'log1p: skipped, zero or negative values' FROM f WHERE stored < (SELECT count(*) FROM cells) * (SELECT count(*) FROM genes) UNION ALL
        SELECT 3, 'variable genes: found' UNION ALL SELECT 4, 'scale: applied' UNION ALL SELECT 5, 'filter: last'""",
)
def preprocess_log(spark, sf):
    return prep.preprocess(t.counts(spark, sf), t.count_cells(spark, sf), t.genes(spark, sf), "reference").log


@query(
    "marker_matrix",
    "G15",
    f"""{WC} SELECT c.cell_id, coalesce(sum(x) FILTER (gene_name = 'small ring_0'), 0) AS "small ring_0",
        coalesce(sum(x) FILTER (gene_name = 'red widget_1'), 0) AS "red widget_1"
        FROM cells c LEFT JOIN counts USING (cell_id) LEFT JOIN genes USING (gene_id) GROUP BY 1""",
)
def marker_matrix(spark, sf):
    return prep.marker_matrix(t.counts(spark, sf), t.count_cells(spark, sf), t.genes(spark, sf), ["small ring_0", "red widget_1"])


@query(
    "marker_matrix_centred",
    "G15",
    f"""{WC}, m AS (SELECT c.cell_id, coalesce(sum(x) FILTER (gene_name = 'small ring_0'), 0) AS a,
        coalesce(sum(x) FILTER (gene_name = 'red widget_1'), 0) AS b
        FROM cells c LEFT JOIN counts USING (cell_id) LEFT JOIN genes USING (gene_id) GROUP BY 1)
        SELECT cell_id, {z6('a - avg(a) OVER ()')} AS "small ring_0", {z6('b - avg(b) OVER ()')} AS "red widget_1" FROM m""",
)
def marker_matrix_centred(spark, sf):
    return rounded(prep.marker_matrix(t.counts(spark, sf), t.count_cells(spark, sf), t.genes(spark, sf), ["small ring_0", "red widget_1"], centre=True))


# --- differential expression ---------------------------------------------------------------------------


RANKS = f"""pk AS (SELECT cell_id, cell_type = '1-URGENT' AS a FROM cells WHERE cell_type IN ('1-URGENT', '5-LOW')),
full_grid AS (SELECT gene_id, a, cell_id, coalesce(x, 0) AS x FROM pk CROSS JOIN genes LEFT JOIN counts USING (cell_id, gene_id)),
rk AS (SELECT gene_id, a, rank() OVER (PARTITION BY gene_id ORDER BY x) + (count(*) OVER (PARTITION BY gene_id, x) - 1) / 2 AS r FROM full_grid),
nn AS (SELECT count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb FROM pk)"""


@query(
    "rank_sum",
    "K27",
    f"""{WC}, {RANKS} SELECT gene_id, sum(r) FILTER (a) AS rank_sum,
        {z6('(sum(r) FILTER (a) - any_value(na * (na + nb + 1) / 2)) / any_value(sqrt(na * nb * (na + nb + 1) / 12))')} AS score
        FROM rk, nn GROUP BY 1""",
)
def rank_sum(spark, sf):
    out = differential.rank_sum(t.counts(spark, sf), t.count_cells(spark, sf), t.genes(spark, sf), "1-URGENT", "5-LOW")
    return rounded(out.select("gene_id", "rank_sum", "score"))


@query("rank_sum_p", "K27")
def rank_sum_p(spark, sf):
    out = differential.rank_sum(t.counts(spark, sf), t.count_cells(spark, sf), t.genes(spark, sf), "1-URGENT", "5-LOW")
    return rounded(out.select("gene_id", "score", "p", "p_adj"))


WELCH = f"""{LOGGED}, sz AS (SELECT cell_type, count(*) AS n1, (SELECT count(*) FROM cells) - count(*) AS n2 FROM cells GROUP BY 1),
gs AS (SELECT cell_type, gene_id, sum(x) AS s, sum(x * x) AS q FROM lg JOIN cells USING (cell_id) GROUP BY 1, 2),
gt AS (SELECT gene_id, sum(s) AS ts, sum(q) AS tq FROM gs GROUP BY 1),
wg AS (SELECT sz.cell_type, gt.gene_id, n1, n2, coalesce(s, 0) / n1 AS m1, (ts - coalesce(s, 0)) / n2 AS m2, coalesce(q, 0) AS q1, tq - coalesce(q, 0) AS q2
       FROM sz CROSS JOIN gt LEFT JOIN gs ON gs.cell_type = sz.cell_type AND gs.gene_id = gt.gene_id),
we AS (SELECT *, greatest((q1 - n1 * m1 * m1) / (n1 - 1), 0) / n1 AS e1, greatest((q2 - n2 * m2 * m2) / (n2 - 1), 0) / n2 AS e2 FROM wg),
wt AS (SELECT cell_type, gene_id, (m1 - m2) / sqrt(e1 + e2) AS score, (e1 + e2) ** 2 / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)) AS df,
       log2((exp(m1) - 1 + 1e-9) / (exp(m2) - 1 + 1e-9)) AS log_fold FROM we)"""


def _welch(spark, sf):
    return differential.welch_markers(_logged(spark, sf), t.count_cells(spark, sf), t.genes(spark, sf))


@query("welch_markers", "K28", f"{WC}, {WELCH} SELECT cell_type, gene_id, {z6('score')} AS score, {z6('log_fold')} AS log_fold FROM wt")
def welch_markers(spark, sf):
    out = rounded(_welch(spark, sf).select("cell_type", "gene_id", "score", "log_fold"))
    return out


@query("welch_p", "K28")
def welch_p(spark, sf):
    return rounded(_welch(spark, sf).select("cell_type", "gene_id", "p", "p_adj"))


@query(
    "strong_genes",
    "K29",
    f"""{WC}, {WELCH} SELECT cell_type, string_agg(gene_id, ',' ORDER BY score DESC, gene_id) AS genes FROM wt
        WHERE abs(score) > 2.5 AND abs(log_fold) > 0.5 GROUP BY 1""",
)
def strong_genes(spark, sf):
    """The limit is on |t| here: SQL has no t tail to check a p limit with."""
    strong = _welch(spark, sf).withColumn("p", F.when(F.abs("score") > 2.5, 0.0).otherwise(1.0))
    out = differential.significant_genes(strong)
    return out.select("cell_type", F.array_join(F.col("genes").cast("array<string>"), ",").alias("genes"))


@query("significant_genes", "K29")
def significant_genes(spark, sf):
    out = differential.significant_genes(_welch(spark, sf), p=0.01, fold=0.5)
    return out.select("cell_type", F.array_join(F.col("genes").cast("array<string>"), ",").alias("genes"))
