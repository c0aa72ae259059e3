"""Classifiers, F1 tables, leaderboards, projections and density."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import evaluate, prep, proto, relate
from . import tables as t
from .prototype_queries import _COS
from .registry import query, rounded

_U = t.u_sql("'42'", "'strat'", "cell_id")
SPLIT = f"""sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY cell_type ORDER BY {_U}, cell_id)
  <= floor(count(*) OVER (PARTITION BY cell_type) * 0.2::DOUBLE + 0.5::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM emb)"""
PRED = f"""{SPLIT},
nn AS (SELECT a.cell_id, a.cell_type AS y_true, b.cell_type AS l FROM sp a, sp b WHERE a.split = 'test' AND b.split = 'train'
       QUALIFY row_number() OVER (PARTITION BY a.cell_id ORDER BY list_distance(a.vec, b.vec), b.cell_id) <= 5),
pred AS (SELECT cell_id, y_true, l AS y_pred FROM nn GROUP BY cell_id, y_true, l QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY count(*) DESC, l) = 1)"""
F1 = """tc AS (SELECT y_true AS class, count(*) AS support, sum((y_true = y_pred)::INT) AS tp FROM pred GROUP BY 1),
pc AS (SELECT y_pred AS class, count(*) AS predicted FROM pred GROUP BY 1),
f1 AS (SELECT class, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(tp, 0) AS tp,
  coalesce(tp / nullif(predicted, 0), 0) AS "precision", coalesce(tp / nullif(support, 0), 0) AS recall,
  2 * coalesce(tp, 0) / (coalesce(support, 0) + coalesce(predicted, 0)) AS f1 FROM tc FULL JOIN pc USING (class))"""
WITH_PRED = f"WITH {t.EMB}, {PRED}"
WITH_F1 = f"{WITH_PRED}, {F1}"
_QUERY = "study IN ('study_1', 'study_3')"
_REF = f"NOT {_QUERY}"
SUMMARY = "2 * sum(tp) / (sum(support) + sum(predicted))", "avg(f1)", "sum(f1 * support) / sum(support)"


def _pred(spark, sf):
    return evaluate.knn_evaluation(t.emb(spark, sf).select("cell_id", "cell_type", "vec"))


@query("knn_predictions", "K1", f"{WITH_PRED} SELECT cell_id, y_true, y_pred FROM pred")
def knn_predictions(spark, sf):
    return _pred(spark, sf)


@query(
    "f1_per_class",
    "K2",
    f"""{WITH_F1} SELECT "class", round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support, predicted::BIGINT AS predicted, tp::BIGINT AS tp FROM f1""",
)
def f1_per_class(spark, sf):
    return rounded(evaluate.f1_per_class(_pred(spark, sf)))


@query(
    "f1_summary",
    "K2",
    f"{WITH_F1} SELECT round({SUMMARY[0]}, 6) AS f1_micro, round({SUMMARY[1]}, 6) AS f1_macro, round({SUMMARY[2]}, 6) AS f1_weighted FROM f1",
)
def f1_summary(spark, sf):
    return rounded(evaluate.f1_summary(evaluate.f1_per_class(_pred(spark, sf))))


@query(
    "named_f1",
    "K3",
    f"""{WITH_F1} SELECT 'X' AS model, round({SUMMARY[1]}, 6) AS "knn f1 macro", round({SUMMARY[0]}, 6) AS "knn f1 micro",
        round({SUMMARY[2]}, 6) AS "knn f1 weighted" FROM f1""",
)
def named_f1(spark, sf):
    return rounded(evaluate.named_f1(evaluate.f1_summary(evaluate.f1_per_class(_pred(spark, sf))), "X", "knn f1"))


def _label_pred(spark, sf):
    return t.table(spark, sf, "labels").select(F.col("doc_id").alias("cell_id"), F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))


@query("accuracy", "K4", "SELECT round(avg((quality = toxic)::INT), 6) AS accuracy FROM labels")
def accuracy(spark, sf):
    return rounded(evaluate.accuracy(_label_pred(spark, sf)))


@query("accuracy_per_class", "K4", """SELECT quality AS "class", round(avg((quality = toxic)::INT), 6) AS accuracy, count(*) AS n FROM labels GROUP BY 1""")
def accuracy_per_class(spark, sf):
    return rounded(evaluate.accuracy_per_class(_label_pred(spark, sf)))


@query(
    "classification_report",
    "K5",
    f"""WITH pred AS (SELECT doc_id AS cell_id, quality AS y_true, toxic AS y_pred FROM labels), {F1}
        SELECT "class", round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f1""",
)
def classification_report(spark, sf):
    return rounded(evaluate.classification_report(_label_pred(spark, sf)))


@query(
    "top_k_accuracy",
    "K6",
    f"""{t.WITH_SIMS}, r AS (SELECT cell_id, proto_id, label, row_number() OVER (PARTITION BY cell_id ORDER BY s DESC, proto_id) AS r FROM scores)
        SELECT round(avg((r <= 1)::INT), 6) AS top1, round(avg((r <= 5)::INT), 6) AS top5 FROM r WHERE proto_id = label""",
)
def top_k_accuracy(spark, sf):
    return rounded(evaluate.top_k_accuracy(proto.score_arrays(t.emb(spark, sf), t.protos(spark, sf)), "label"))


@query("linear_predictions", "K7")
def linear_predictions(spark, sf):
    return evaluate.linear_evaluation(t.emb(spark, sf).select("cell_id", "cell_type", "vec"))


@query("linear_f1", "K7")
def linear_f1(spark, sf):
    return rounded(evaluate.f1_summary(evaluate.f1_per_class(linear_predictions(spark, sf))))


@query("classify_marker_genes", "K8")
def classify_marker_genes(spark, sf):
    """Features: counts of the 20 most counted genes; label: cell type of the count table."""
    c = t.counts(spark, sf)
    top = c.groupBy("gene_id").agg(F.sum("x").alias("s")).orderBy(F.desc("s"), "gene_id").limit(20)
    genes = [r[0] for r in top.select("gene_id").collect()]
    feats = prep.dense_vectors(c, "gene_id", genes, t.count_cells(spark, sf)).join(t.count_cells(spark, sf).select("cell_id", "cell_type", "study"), "cell_id")
    held = F.col("study").isin("BUILDING", "FURNITURE")
    return rounded(evaluate.f1_summary(evaluate.f1_per_class(evaluate.reference_evaluation(feats.where(~held), feats.where(held)))))


@query("classify_prototype_profiles", "K8")
def classify_prototype_profiles(spark, sf):
    """Features: the vector of the cell's most similar prototype."""
    best = proto.nearest_prototype_vector(t.emb(spark, sf), t.protos(spark, sf))
    feats = best.select("cell_id", F.col("proto_vec").alias("vec")).join(t.emb_cells(spark, sf).select("cell_id", "cell_type", "study"), "cell_id")
    return rounded(evaluate.f1_summary(evaluate.f1_per_class(evaluate.reference_evaluation(feats.where(_REF), feats.where(_QUERY)))))


def keys(spark, sf):
    """Two embedding keys: the vectors, and the distances to all prototypes."""
    e = t.emb(spark, sf)
    far = proto.score_arrays(e, t.protos(spark, sf), "l2", out="_d")
    return {"X": e, "X_proto": far.drop("vec").withColumnRenamed("_d", "vec")}


@query("evaluate_keys", "K9")
def evaluate_keys(spark, sf):
    """Fitted on the reference studies, tested on the query studies."""
    subsets = {"pair": ["type_0", "type_1"], "triple": ["type_2", "type_3", "type_4"], "all": None}
    parts = {k: (c.where(_REF), c.where(_QUERY)) for k, c in keys(spark, sf).items()}
    return rounded(evaluate.evaluate_keys(parts, subsets))


FAR = f"""{t.DIMS}, {t.PROTOS}, {t.DISTS}, embh AS (SELECT cell_id, cell_type, list(d ORDER BY proto_id) AS vec FROM dists GROUP BY ALL)"""
_HALF = PRED.replace("FROM emb)", "FROM embh)").replace("sp AS", "sph AS").replace("sp a, sp b", "sph a, sph b").replace("nn AS", "nnh AS").replace("FROM nn ", "FROM nnh ").replace("pred AS", "predh AS")
_F1H = F1.replace("FROM pred ", "FROM predh ").replace("tc AS", "tch AS").replace("pc AS", "pch AS").replace("FROM tc FULL JOIN pc", "FROM tch FULL JOIN pch").replace("f1 AS (SELECT", "f1h AS (SELECT")


@query(
    "results_by_key",
    "K10",
    f"""{WITH_PRED}, {FAR}, {_HALF}
        SELECT 'X' AS model, round(avg((y_true = y_pred)::INT), 6) AS accuracy FROM pred UNION ALL
        SELECT 'X_proto', round(avg((y_true = y_pred)::INT), 6) FROM predh""",
)
def results_by_key(spark, sf):
    score = lambda cells: evaluate.accuracy(evaluate.knn_evaluation(cells.select("cell_id", "cell_type", "vec")))
    return rounded(evaluate.results_by_key(keys(spark, sf), score))


@query(
    "outer_by_class",
    "D2",
    f"""{WITH_F1}, {FAR}, {_HALF}, {_F1H} SELECT coalesce(f1.class, f1h.class) AS "class", round(f1.f1, 6) AS x, round(f1h.f1, 6) AS x_proto
        FROM f1 FULL OUTER JOIN f1h ON f1.class = f1h.class""",
)
def outer_by_class(spark, sf):
    """Per-class F1 of two keys, side by side."""
    k = keys(spark, sf)
    f1 = lambda cells: evaluate.f1_per_class(evaluate.knn_evaluation(cells.select("cell_id", "cell_type", "vec"))).select("class", "f1")
    return rounded(relate.outer_by_class({"x": f1(k["X"]), "x_proto": f1(k["X_proto"])}))




def _triple(value: str, src: str) -> str:
    return f"""SELECT 'ref' AS split, {value} FROM {src} WHERE NOT {_QUERY} UNION ALL SELECT 'query', {value} FROM {src} WHERE {_QUERY}
        UNION ALL SELECT 'all', {value} FROM {src}"""


@query(
    "coverage_by_split",
    "K22",
    f"""{t.WITH_PROTOS}, {_COS}, m AS (SELECT cell_id, study, min(d) AS d FROM cosd GROUP BY 1, 2)
        SELECT CASE WHEN {_QUERY} THEN 'query' ELSE 'ref' END AS split, round(max(d), 6) AS coverage FROM m GROUP BY 1""",
)
def coverage_by_split(spark, sf):
    split = F.when(F.col("study").isin("study_1", "study_3"), "query").otherwise("ref")
    return rounded(proto.coverage_by(t.emb(spark, sf).withColumn("split", split), t.protos(spark, sf), "split"))


@query(
    "split_metrics",
    "K23",
    f"""{t.WITH_PROTOS}, {_COS}, m AS (SELECT cell_id, study, min(d) AS d FROM cosd GROUP BY 1, 2)
        {_triple('round(max(d), 6) AS coverage', 'm')}""",
)
def split_metrics(spark, sf):
    split = F.when(F.col("study").isin("study_1", "study_3"), "query").otherwise("ref")
    p = t.protos(spark, sf)
    return rounded(evaluate.split_metrics(t.emb(spark, sf), split, lambda c: proto.coverage(c, p)))


@query(
    "compare_models",
    "K24",
    f"""WITH {t.RUNS}, m AS (SELECT model, round(avg(bio), 5) AS bio, round(avg(batch_mix), 5) AS batch_mix FROM runs GROUP BY 1)
        SELECT DISTINCT model, bio, batch_mix FROM m""",
)
def compare_models(spark, sf):
    return evaluate.compare_models(t.metric_runs(spark, sf), "fold", ["bio", "batch_mix"])


@query("joint_projection", "K25")
def joint_projection(spark, sf):
    return rounded(evaluate.joint_projection(t.emb(spark, sf), t.protos(spark, sf)), 5)


# a fixed plane through all 64 dimensions
_PLANE = ([math.cos(i) for i in range(t.DIM)], [math.sin(i) for i in range(t.DIM)])
_PTS = f"pts AS (SELECT cell_id, list_inner_product(vec, {_PLANE[0]}::DOUBLE[]) AS x, list_inner_product(vec, {_PLANE[1]}::DOUBLE[]) AS y FROM emb)"


def _points(spark, sf):
    along = lambda axis: F.aggregate(F.zip_with("vec", F.lit(axis), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return t.emb(spark, sf).select("cell_id", along(_PLANE[0]).alias("x"), along(_PLANE[1]).alias("y"))


@query(
    "point_density",
    "K26",
    f"""WITH {t.EMB}, {_PTS}, st AS (SELECT count(*) AS n, var_samp(x) * pow(count(*), -1.0 / 3) AS a, var_samp(y) * pow(count(*), -1.0 / 3) AS b,
          covar_samp(x, y) * pow(count(*), -1.0 / 3) AS c FROM pts)
        SELECT p.cell_id, round(sum(exp(-0.5 * (b * (p.x - q.x) ** 2 - 2 * c * (p.x - q.x) * (p.y - q.y) + a * (p.y - q.y) ** 2) / (a * b - c * c)))
          / (any_value(n) * 2 * pi() * sqrt(any_value(a * b - c * c))), 6) AS density
        FROM pts p, pts q, st GROUP BY 1""",
)
def point_density(spark, sf):
    return rounded(evaluate.point_density(_points(spark, sf)).select("cell_id", "density"))


@query(
    "point_density_mesh",
    "K26",
    f"""WITH {t.EMB}, {_PTS}, st AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) * pow(count(*), -1.0 / 3) AS a,
          var_samp(y) * pow(count(*), -1.0 / 3) AS b, covar_samp(x, y) * pow(count(*), -1.0 / 3) AS c FROM pts),
        uv AS (SELECT cell_id, (x - mx) / sqrt(a) / 0.0625 AS u, ((y - my) - c / a * (x - mx)) / sqrt(b - c * c / a) / 0.0625 AS v,
          1 / (n * 2 * pi() * sqrt(a * b - c * c)) AS s FROM pts, st),
        nd AS (SELECT cell_id, s, floor(u) + di AS i, floor(v) + dj AS j,
          (CASE WHEN di = 1 THEN u - floor(u) ELSE 1 - u + floor(u) END) * (CASE WHEN dj = 1 THEN v - floor(v) ELSE 1 - v + floor(v) END) AS w
          FROM uv, (VALUES (0), (1)) a(di), (VALUES (0), (1)) b(dj)),
        us AS (SELECT i, j, sum(w) AS c FROM nd GROUP BY 1, 2),
        sm AS (SELECT p.i, p.j, sum(q.c * exp(-0.5 * 0.0625 * 0.0625 * ((p.i - q.i) ** 2 + (p.j - q.j) ** 2))) AS d
          FROM us p JOIN us q ON abs(p.i - q.i) <= 92 AND abs(p.j - q.j) <= 92 GROUP BY 1, 2)
        SELECT cell_id, round(sum(w * d * s), 6) AS density FROM nd JOIN sm USING (i, j) GROUP BY 1""",
)
def point_density_mesh(spark, sf):
    """The linear form."""
    return rounded(evaluate.mesh_density(_points(spark, sf)).select("cell_id", "density"))


@query("duplicate_categories", "K30", "SELECT n_chars, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_categories(spark, sf):
    return evaluate.duplicate_categories(t.table(spark, sf, "documents"), "n_chars")
