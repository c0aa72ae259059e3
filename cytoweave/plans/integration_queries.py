"""Label conservation and batch mixing of embeddings."""

from __future__ import annotations


from ..operators import assign, integration, neighbors, proto
from . import tables as t
from .evaluation_queries import keys
from .graph_queries import knn
from .prototype_queries import WITH_ASSIGNED
from .registry import query, rounded

WE = f"WITH {t.EMB}"


def _clustered(spark, sf):
    return proto.nearest_prototype(t.emb(spark, sf), t.protos(spark, sf)).withColumnRenamed("proto_id", "cluster")


@query(
    "nmi_ari",
    "K12",
    f"""{WITH_ASSIGNED}, c AS (SELECT cell_type AS a, proto_id AS b, count(*) AS n FROM assigned GROUP BY 1, 2),
        ra AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c),
        ha AS (SELECT -sum(na / t * ln(na / t)) AS h, sum(na * (na - 1) / 2) AS s FROM ra, t),
        hb AS (SELECT -sum(nb / t * ln(nb / t)) AS h, sum(nb * (nb - 1) / 2) AS s FROM rb, t),
        j AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi, sum(n * (n - 1) / 2) AS i FROM c JOIN ra USING (a) JOIN rb USING (b), t)
        SELECT round(mi / ((ha.h + hb.h) / 2), 6) AS nmi,
               round((i - ha.s * hb.s / (t * (t - 1) / 2)) / ((ha.s + hb.s) / 2 - ha.s * hb.s / (t * (t - 1) / 2)), 6) AS ari FROM j, ha, hb, t""",
)
def nmi_ari(spark, sf):
    return rounded(integration.nmi_ari(_clustered(spark, sf), "cell_type", "cluster"))


def _kmeans(cells):
    return assign.kmeans_prototypes(cells, 10, seed=3)[1].withColumnRenamed("proto_id", "cluster")


@query("kmeans_nmi_ari", "K12")
def kmeans_nmi_ari(spark, sf):
    return rounded(integration.nmi_ari(_kmeans(t.emb(spark, sf)), "cell_type", "cluster"))


SIL = """pd AS (SELECT a.cell_id, a.cell_type AS own, b.cell_type AS g, sum(list_distance(a.vec, b.vec)) AS d, count(*) AS n
  FROM emb a, emb b GROUP BY ALL),
sl AS (SELECT cell_id, own, max(d / (n - 1)) FILTER (g = own AND n > 1) AS a, min(d / n) FILTER (g <> own) AS b FROM pd GROUP BY ALL),
si AS (SELECT cell_id, own AS cell_type, CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM sl)"""


@query("silhouette_per_cell", "K13", f"{WE}, {SIL} SELECT cell_id, cell_type, CASE WHEN abs(s) < 5e-7 THEN 0.0 ELSE round(s, 6) END AS s FROM si")
def silhouette_per_cell(spark, sf):
    return rounded(integration.silhouette(t.emb(spark, sf), "cell_type"))


@query("label_silhouette", "K13", f"{WE}, {SIL} SELECT round((avg(s) + 1) / 2, 6) AS label_silhouette FROM si")
def label_silhouette(spark, sf):
    return rounded(integration.label_silhouette(t.emb(spark, sf)))


@query(
    "batch_silhouette",
    "K14",
    f"""{WE}, ok AS (SELECT cell_type FROM emb GROUP BY 1 HAVING count(DISTINCT batch) > 1 AND count(DISTINCT batch) < count(*)),
        pd AS (SELECT a.cell_id, a.cell_type, a.batch AS own, b.batch AS g, sum(list_distance(a.vec, b.vec)) AS d, count(*) AS n
               FROM emb a JOIN emb b USING (cell_type) WHERE cell_type IN (FROM ok) GROUP BY ALL),
        sl AS (SELECT cell_id, cell_type, max(d / (n - 1)) FILTER (g = own AND n > 1) AS a, min(d / n) FILTER (g <> own) AS b FROM pd GROUP BY ALL),
        si AS (SELECT cell_type, avg(1 - abs(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END)) AS s FROM sl GROUP BY 1)
        SELECT round(avg(s), 6) AS batch_silhouette FROM si""",
)
def batch_silhouette(spark, sf):
    return rounded(integration.batch_silhouette(t.emb(spark, sf)))


@query(
    "isolated_label_silhouette",
    "K15",
    f"""{WE}, {SIL}, nb AS (SELECT cell_type, count(DISTINCT batch) AS b FROM emb GROUP BY 1)
        SELECT round(avg(m), 6) AS isolated_silhouette FROM (SELECT cell_type, (avg(s) + 1) / 2 AS m FROM si
          WHERE cell_type IN (SELECT cell_type FROM nb WHERE b = (SELECT min(b) FROM nb)) GROUP BY 1)""",
)
def isolated_label_silhouette(spark, sf):
    return rounded(integration.isolated_label_silhouette(t.emb(spark, sf)))


def _knn_l2(cells, k=30):
    return neighbors.knn_graph(cells.select("cell_id", "vec"), k, "l2")


@query("neighbour_diversity", "K16")
def neighbour_diversity(spark, sf):
    return rounded(integration.neighbour_diversity(_knn_l2(t.emb(spark, sf)), t.emb_cells(spark, sf), "batch", 10.0))


@query("mixing_scores", "K16")
def mixing_scores(spark, sf):
    return rounded(integration.mixing_scores(_knn_l2(t.emb(spark, sf)), t.emb_cells(spark, sf)))


@query(
    "batch_chi_square",
    "K17",
    f"""{WE}, {t.knn_sql(30)}, sh AS (SELECT cell_type, batch, count(*) / sum(count(*)) OVER (PARTITION BY cell_type) AS f,
          count(*) OVER (PARTITION BY cell_type) AS k FROM emb GROUP BY 1, 2),
        ob AS (SELECT src, x.cell_type, y.batch, count(*) AS o FROM knn JOIN emb x ON x.cell_id = src JOIN emb y ON y.cell_id = dst
               WHERE x.cell_type = y.cell_type GROUP BY ALL),
        ch AS (SELECT src, sum(o * o / f) / sum(o) - sum(o) AS c FROM ob JOIN sh USING (cell_type, batch) WHERE k > 1 GROUP BY 1)
        SELECT cell_type, round(avg(coalesce(c, 0)), 6) AS mean_chi2, count(*) AS n_cells FROM emb LEFT JOIN ch ON src = cell_id GROUP BY 1""",
)
def batch_chi_square(spark, sf):
    return rounded(_acceptance(spark, sf).select("cell_type", "mean_chi2", "n_cells"))


def _acceptance(spark, sf):
    return integration.batch_acceptance(knn(spark, sf, 30), t.emb_cells(spark, sf))


@query("batch_acceptance", "K17")
def batch_acceptance(spark, sf):
    return rounded(_acceptance(spark, sf).select("cell_type", "acceptance"))


@query(
    "graph_connectivity",
    "K18",
    f"""WITH RECURSIVE {t.EMB}, {t.knn_sql(5)}, ed AS (SELECT src, dst FROM knn JOIN emb x ON x.cell_id = src JOIN emb y ON y.cell_id = dst WHERE x.cell_type = y.cell_type),
        bi AS MATERIALIZED (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed),
        re AS (SELECT cell_id AS a, cell_id AS b FROM emb UNION SELECT a, dst FROM re JOIN bi ON b = src),
        cp AS (SELECT a AS cell_id, min(b) AS c FROM re GROUP BY 1),
        sz AS (SELECT cell_type, c, count(*) AS n FROM cp JOIN emb USING (cell_id) GROUP BY 1, 2)
        SELECT cell_type, round(max(n) / sum(n), 6) AS connectivity FROM sz GROUP BY 1""",
)
def graph_connectivity(spark, sf):
    return rounded(integration.graph_connectivity(knn(spark, sf, 5), t.emb_cells(spark, sf)))


def _r2(src: str, name: str) -> str:
    return f"""{name} AS (SELECT sum(gb) / sum(tt) AS r FROM (SELECT dim, sum(s * s / n) - any_value(gs * gs / gn) AS gb, any_value(gq - gs * gs / gn) AS tt FROM
      (SELECT dim, study, sum(v) AS s, count(*) AS n FROM {src} GROUP BY 1, 2) JOIN
      (SELECT dim, sum(v) AS gs, count(*) AS gn, sum(v * v) AS gq FROM {src} GROUP BY 1) USING (dim) GROUP BY 1))"""


@query("batch_variance", "K19", f"{WE}, {t.DIMS}, {_r2('dims', 'b')} SELECT round(r, 6) AS batch_r2 FROM b")
def batch_variance(spark, sf):
    return rounded(integration.batch_variance(t.emb(spark, sf)))


@query(
    "batch_variance_drop",
    "K19",
    f"{WE}, {t.DIMS}, {t.PROTOS}, {t.DISTS}, far AS (SELECT study, proto_id AS dim, d AS v FROM dists), {_r2('dims', 'b')}, {_r2('far', 'h')} SELECT round(greatest((b.r - h.r) / b.r, 0), 6) AS pcr_comparison FROM b, h",
)
def batch_variance_drop(spark, sf):
    k = keys(spark, sf)
    return rounded(integration.batch_variance_drop(k["X"], k["X_proto"]))


@query(
    "metric_totals",
    "K20",
    f"""WITH {t.RUNS} SELECT model, fold, round(bio, 6) AS bio, round(batch_mix, 6) AS batch_mix, round(size, 6) AS size,
        round(batch_mix, 6) AS batch_correction, round((bio + size) / 2, 6) AS bio_conservation,
        round(0.4 * batch_mix + 0.6 * (bio + size) / 2, 6) AS total FROM runs""",
)
def metric_totals(spark, sf):
    return rounded(integration.totals(t.metric_runs(spark, sf), ["bio", "size"], ["batch_mix"]))


@query("integration_benchmark", "K11")
def integration_benchmark(spark, sf):
    k = keys(spark, sf)
    return rounded(integration.integration_benchmark(k, lambda c: _knn_l2(c, 30), _kmeans, before=k["X"]))


def _trimmed(keys_: str, src: str, name: str) -> str:
    return f"""{name}r AS (SELECT {keys_}, dim, v, row_number() OVER (PARTITION BY {keys_}, dim ORDER BY v, cell_id) AS r, count(*) OVER (PARTITION BY {keys_}, dim) AS n FROM {src}),
{name} AS (SELECT {keys_}, dim, avg(v) AS v FROM {name}r WHERE r > floor(0.05::DOUBLE * n) AND r <= n - floor(0.05::DOUBLE * n) GROUP BY ALL)"""


CONSENSUS = f"""sz AS (SELECT study, cell_type, count(*) AS n FROM emb GROUP BY 1, 2),
us AS (SELECT study, cell_type FROM sz WHERE n >= 10 AND study IN (SELECT study FROM sz GROUP BY 1 HAVING sum(n) >= 100)),
kd AS (SELECT dims.* FROM dims JOIN us USING (study, cell_type)), {_trimmed('study, cell_type', 'kd', 'ct')},
bd AS (SELECT a.study, a.cell_type AS i, b.cell_type AS j, sqrt(sum((a.v - b.v) ** 2)) AS d FROM ct a JOIN ct b ON a.study = b.study AND a.dim = b.dim GROUP BY ALL),
bn AS (SELECT study, i, j, coalesce(d / nullif(max(d) OVER (PARTITION BY study, j), 0), 0) AS d FROM bd),
av AS (SELECT i, j, avg(d) AS d FROM bn GROUP BY ALL),
cs AS (SELECT i, j, coalesce(d / nullif(max(d) OVER (PARTITION BY j), 0), 0) AS d FROM av)"""


@query("label_graph_consensus", "K21", f"{WE}, {t.DIMS}, {CONSENSUS} SELECT i, j, round(d, 6) AS d FROM cs")
def label_graph_consensus(spark, sf):
    return rounded(integration.label_graph_consensus(t.emb(spark, sf)))


@query(
    "label_graph_scores",
    "K21",
    f"""{WE}, {t.DIMS}, {CONSENSUS}, {t.PROTOS}, {t.DISTS}, hd AS (SELECT cell_id, cell_type, study, label, proto_id AS dim, d AS v FROM dists), {_trimmed('cell_type', 'hd', 'oc')},
        od AS (SELECT a.cell_type AS i, b.cell_type AS j, sqrt(sum((a.v - b.v) ** 2)) AS d FROM oc a JOIN oc b ON a.dim = b.dim GROUP BY ALL),
        ow AS (SELECT i, j, coalesce(d / nullif(max(d) OVER (PARTITION BY j), 0), 0) AS x FROM od),
        bo AS (SELECT i, j, x, cs.d AS y, CASE WHEN cs.d > 0 THEN 1 / cs.d ELSE 0 END AS w FROM ow JOIN cs USING (i, j) WHERE i <> j),
        rk AS (SELECT *, rank() OVER (PARTITION BY j ORDER BY x) + (count(*) OVER (PARTITION BY j, x) - 1) / 2 AS rx,
               rank() OVER (PARTITION BY j ORDER BY y) + (count(*) OVER (PARTITION BY j, y) - 1) / 2 AS ry FROM bo),
        wm AS (SELECT *, sum(w * x) OVER (PARTITION BY j) / sum(w) OVER (PARTITION BY j) AS mx, sum(w * y) OVER (PARTITION BY j) / sum(w) OVER (PARTITION BY j) AS my FROM rk),
        pj AS (SELECT j, corr(rx, ry) AS r, corr(x, y) AS c, sum(w * (x - mx) * (y - my)) / sqrt(sum(w * (x - mx) ** 2) * sum(w * (y - my) ** 2)) AS cw FROM wm GROUP BY 1)
        SELECT round(avg(r), 6) AS rank_pca, round(avg(c), 6) AS corr_pca, round(avg(cw), 6) AS corr_weighted FROM pj""",
)
def label_graph_scores(spark, sf):
    k = keys(spark, sf)
    return rounded(integration.label_graph_scores(k["X_proto"], integration.label_graph_consensus(k["X"])))
