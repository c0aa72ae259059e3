"""Prototype scores, assignment, purity, balanced assignment and batch scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec as V
from ..functions.rand import uniform
from ..operators import assign, proto
from ..session import cut_lineage
from . import tables as t
from .registry import query, rounded

EPS = 0.05  # sharpness of the balanced assignment
TEMP = 0.1


def _scores(spark, sf):
    """cell_id, cell_type, study, s = array of similarities in prototype order."""
    return proto.score_arrays(t.emb(spark, sf), t.protos(spark, sf), "dot").select("cell_id", "cell_type", "study", "s")


def _long(df, value, keys=("cell_id",)):
    """Explode a prototype-ordered array; prototype ids of the fixture are 0, 1, 2, ..."""
    return rounded(df.select(*keys, F.posexplode(value).alias("proto_id", value)))


@query("cell_prototype_distances", "D5", f"{t.WITH_DISTS} SELECT cell_id, proto_id, round(d, 6) AS d FROM dists")
def cell_prototype_distances(spark, sf):
    return rounded(proto.pair_scores(t.emb(spark, sf), t.protos(spark, sf), "l2").withColumnRenamed("s", "d"))


@query(
    "prototype_pairs",
    "D6",
    f"{t.WITH_PROTOS} SELECT a.proto_id AS i, b.proto_id AS j, round(list_distance(a.vec, b.vec), 6) AS d FROM protos a, protos b WHERE a.proto_id <> b.proto_id",
)
def prototype_pairs(spark, sf):
    return rounded(proto.prototype_pairs(t.protos(spark, sf)))


@query("similarity_scores", "J1", f"{t.WITH_SIMS} SELECT cell_id, proto_id, round(s, 6) AS s FROM scores")
def similarity_scores(spark, sf):
    return rounded(proto.pair_scores(t.emb(spark, sf), t.protos(spark, sf), "dot"))


_ARG = "row_number() OVER (PARTITION BY cell_id ORDER BY {v}, proto_id) = 1"
ASSIGNED = f"assigned AS (SELECT * FROM dists QUALIFY {_ARG.format(v='d')})"
WITH_ASSIGNED = f"{t.WITH_DISTS}, {ASSIGNED}"


@query(
    "best_and_worst_prototype",
    "F1",
    f"""{t.WITH_SIMS} SELECT cell_id, arg_max(proto_id, s)::INT AS best, round(max(s), 6) AS best_s,
        arg_min(proto_id, s)::INT AS worst, round(min(s), 6) AS worst_s FROM scores GROUP BY 1""",
)
def best_and_worst_prototype(spark, sf):
    s = _scores(spark, sf)
    hi, lo = F.array_max("s"), F.array_min("s")
    return rounded(
        s.select(
            "cell_id",
            (F.array_position("s", hi) - 1).cast("int").alias("best"),
            hi.alias("best_s"),
            (F.array_position("s", lo) - 1).cast("int").alias("worst"),
            lo.alias("worst_s"),
        )
    )


@query("nearest_prototype", "J2", f"{WITH_ASSIGNED} SELECT cell_id, proto_id, round(d, 6) AS score FROM assigned")
def nearest_prototype(spark, sf):
    return rounded(_assigned(spark, sf).select("cell_id", "proto_id", "score"))


def _assigned(spark, sf):
    return proto.nearest_prototype(t.emb(spark, sf), t.protos(spark, sf), "l2")


@query(
    "nearest_prototype_vector",
    "J3",
    f"""{t.WITH_SIMS} SELECT cell_id, proto_id, round(s, 6) AS score, round(p.vec[1], 6) AS v0, round(p.vec[64], 6) AS v63
        FROM (SELECT * FROM scores QUALIFY {_ARG.format(v='s DESC')}) JOIN protos p USING (proto_id)""",
)
def nearest_prototype_vector(spark, sf):
    best = proto.nearest_prototype_vector(t.emb(spark, sf), t.protos(spark, sf))
    return rounded(best.select("cell_id", "proto_id", "score", F.col("proto_vec")[0].alias("v0"), F.col("proto_vec")[63].alias("v63")))


@query(
    "top_cells_per_prototype",
    "F2",
    f"""{t.WITH_SIMS} SELECT proto_id, cell_id, round(s, 6) AS s, rank::INT AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY proto_id ORDER BY s DESC, cell_id) AS rank FROM scores) WHERE rank <= 10""",
)
def top_cells_per_prototype(spark, sf):
    return rounded(proto.top_cells(t.emb(spark, sf), t.protos(spark, sf), 10).select("cell_id", "proto_id", "s", "rank"))


@query(
    "nearest_cell_of_prototype",
    "F4",
    f"""{t.WITH_DISTS} SELECT proto_id, cell_id, cell_type, study, round(d, 6) AS dist FROM dists
        QUALIFY row_number() OVER (PARTITION BY proto_id ORDER BY d, cell_id) = 1""",
)
def nearest_cell_of_prototype(spark, sf):
    return rounded(proto.nearest_cell(t.emb(spark, sf).drop("label", "batch"), t.protos(spark, sf)))


PURITY = """purity AS (
  SELECT proto_id, coalesce(sum(n), 0)::BIGINT AS n, max(n) / sum(n) AS purity FROM protos LEFT JOIN
    (SELECT proto_id, cell_type, count(*) AS n FROM assigned GROUP BY 1, 2) USING (proto_id) GROUP BY 1)"""


@query("prototype_purity", "J4", f"{WITH_ASSIGNED}, {PURITY} SELECT proto_id, n, round(purity, 6) AS purity FROM purity")
def prototype_purity(spark, sf):
    return rounded(proto.prototype_purity(_assigned(spark, sf), t.protos(spark, sf)))


@query(
    "purity_summary",
    "J5",
    f"""{WITH_ASSIGNED}, {PURITY} SELECT round(min(purity), 6) AS min_purity, round(max(purity), 6) AS max_purity,
        round(avg(purity), 6) AS avg_purity, round(sum(purity * n) / sum(n), 6) AS weighted_purity,
        min(n) AS min_count, max(n) AS max_count, round(avg(n), 6) AS avg_count FROM purity""",
)
def purity_summary(spark, sf):
    return rounded(proto.purity_summary(proto.prototype_purity(_assigned(spark, sf), t.protos(spark, sf))))


_PP = "pp AS (SELECT a.proto_id AS i, b.proto_id AS j, list_distance(a.vec, b.vec) AS d FROM protos a, protos b WHERE a.proto_id <> b.proto_id)"


@query(
    "nearest_prototype_distance",
    "J6",
    f"""{t.WITH_PROTOS}, {_PP} SELECT round(min(d), 6) AS min_d, round(avg(d), 6) AS avg_d, round(max(d), 6) AS max_d
        FROM (SELECT i, min(d) AS d FROM pp GROUP BY 1)""",
)
def nearest_prototype_distance(spark, sf):
    return rounded(proto.nearest_prototype_distance(t.protos(spark, sf)))


@query("mean_pairwise_distance", "J7", f"{t.WITH_PROTOS}, {_PP} SELECT round(avg(d), 6) AS mean_d FROM pp")
def mean_pairwise_distance(spark, sf):
    return rounded(proto.mean_pairwise_distance(t.protos(spark, sf)))


TOPLAB = """topc AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY proto_id ORDER BY s DESC, cell_id) <= 10),
lab AS (SELECT proto_id, cell_type AS proto_label, count(*) / 10 AS confidence FROM topc GROUP BY proto_id, cell_type
        QUALIFY row_number() OVER (PARTITION BY proto_id ORDER BY count(*) DESC, cell_type) = 1)"""


@query("label_by_top_cells", "J8", f"{t.WITH_SIMS}, {TOPLAB} SELECT proto_id, proto_label, round(confidence, 6) AS confidence FROM lab")
def label_by_top_cells(spark, sf):
    return rounded(_top_labels(spark, sf))


def _top_labels(spark, sf):
    return proto.label_by_top_cells(proto.top_cells(t.emb(spark, sf), t.protos(spark, sf), 10), t.emb_cells(spark, sf))


@query(
    "label_by_assigned",
    "J9",
    f"""{WITH_ASSIGNED}, c AS (SELECT proto_id, cell_type, count(*) AS n FROM assigned GROUP BY 1, 2)
        SELECT proto_id, coalesce(cell_type, 'none') AS proto_label, round(coalesce(n / t, 0), 6) AS certainty, coalesce(t, 0)::BIGINT AS n
        FROM protos LEFT JOIN (SELECT *, sum(n) OVER (PARTITION BY proto_id) AS t FROM c
          QUALIFY row_number() OVER (PARTITION BY proto_id ORDER BY n DESC, cell_type) = 1) USING (proto_id)""",
)
def label_by_assigned(spark, sf):
    return rounded(proto.label_by_assigned(_assigned(spark, sf), t.protos(spark, sf)))


@query(
    "labelled_prototypes",
    "J10",
    f"""{t.WITH_SIMS}, {TOPLAB} SELECT proto_id, coalesce(proto_label, 'Unknown') AS proto_label,
        round(coalesce(confidence, 0), 6) AS confidence, round(vec[1], 6) AS v0 FROM protos LEFT JOIN lab USING (proto_id)""",
)
def labelled_prototypes(spark, sf):
    out = proto.labelled_prototypes(t.protos(spark, sf), _top_labels(spark, sf))
    return rounded(out.select("proto_id", "proto_label", "confidence", F.col("vec")[0].alias("v0")))


# --- balanced assignment ------------------------------------------------------------------------


def sinkhorn_sql(src: str, name: str, by: str = "", rounds: int = 3, key: str = "cell_id") -> str:
    """Unrolled rounds over long scores (key, proto_id, s)."""
    part = f"{by}, " if by else ""
    keep = f"{key}, {part}proto_id"
    out = [f"{name}0 AS (SELECT {keep}, exp((s - (SELECT max(s) FROM {src})) / {EPS}) AS q FROM {src})"]
    for i in range(1, rounds + 1):
        out.append(f"{name}r{i} AS (SELECT {keep}, q / sum(q) OVER (PARTITION BY {part}proto_id) AS q FROM {name}{i - 1})")
        out.append(f"{name}{i} AS (SELECT {keep}, q / sum(q) OVER (PARTITION BY {part}{key}) AS q FROM {name}r{i})")
    out.append(f"{name} AS (SELECT * FROM {name}{rounds})")
    return ", ".join(out)


@query("sinkhorn", "J11", f"{t.WITH_SIMS}, {sinkhorn_sql('scores', 'sk')} SELECT cell_id, proto_id, round(q, 6) AS q FROM sk")
def sinkhorn(spark, sf):
    return _long(assign.sinkhorn(_scores(spark, sf), EPS), "q")


@query("sinkhorn_by_batch", "J12", f"{t.WITH_SIMS}, {sinkhorn_sql('scores', 'sk', 'study')} SELECT cell_id, study, proto_id, round(q, 6) AS q FROM sk")
def sinkhorn_by_batch(spark, sf):
    return _long(assign.sinkhorn(_scores(spark, sf), EPS, by=["study"]), "q", ("cell_id", "study"))


@query("soft_weights", "J13", f"{t.WITH_SIMS} SELECT cell_id, proto_id, round(exp(s / 0.1), 6) AS q FROM scores")
def soft_weights(spark, sf):
    return _long(assign.soft_weights(_scores(spark, sf), 0.1), "q")


@query(
    "hard_assignment",
    "J14",
    f"{t.WITH_SIMS} SELECT cell_id, proto_id, CASE WHEN {_ARG.format(v='s DESC')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS q FROM scores",
)
def hard_assignment(spark, sf):
    return _long(assign.hard_assignment(_scores(spark, sf)), "q")


_SOFT = "soft AS (SELECT cell_id, proto_id, exp(s / 0.1) / sum(exp(s / 0.1)) OVER (PARTITION BY cell_id) AS p FROM scores)"


@query("softmax", "J15", f"{t.WITH_SIMS}, {_SOFT} SELECT cell_id, proto_id, round(p, 6) AS p FROM soft")
def softmax(spark, sf):
    return _long(assign.softmax(_scores(spark, sf), TEMP), "p")


# two views of each cell: dimensions masked by a keyed draw
def _views(spark, sf):
    e = t.emb(spark, sf)
    keep = lambda x, i: F.when(uniform(5, "mask", F.col("anchor_id"), F.col("view_no"), i) >= 0.2, x).otherwise(0.0)
    doubled = e.select(F.col("cell_id").alias("anchor_id"), F.explode(F.lit([0, 1])).alias("view_no"), "vec")
    return doubled.withColumn("vec", F.transform("vec", keep))


def _view_scores(spark, sf):
    views = _views(spark, sf).withColumn("vec", V.unit_kernel()("vec"))
    return proto.score_arrays(views, t.protos(spark, sf)).select("anchor_id", "view_no", "s")


VIEWS = f"""vdims AS (
  SELECT cell_id AS anchor_id, view_no, dim,
         CASE WHEN {t.u_sql("'5'", "'mask'", 'cell_id', 'view_no', 'dim')} >= 0.2 THEN v ELSE 0.0 END AS v
  FROM dims, (VALUES (0), (1)) w(view_no)),
views AS (SELECT anchor_id, view_no, list(v ORDER BY dim) AS vec FROM vdims GROUP BY ALL),
scores AS (SELECT anchor_id, view_no, proto_id, list_cosine_similarity(v.vec, p.vec) AS s FROM views v, protos p)"""
VIEW_Q = f"{t.WITH_PROTOS}, {VIEWS}, {sinkhorn_sql('scores', 'sk', 'view_no', key='anchor_id')}"
VIEW_P = """lp AS (SELECT *, s / 0.1 - ln(sum(exp(s / 0.1)) OVER (PARTITION BY anchor_id, view_no)) AS logp FROM scores),
pr AS (SELECT sk.anchor_id, sk.view_no AS i, lp.view_no AS v, sk.q, exp(logp) AS p, logp FROM sk JOIN lp
       ON sk.anchor_id = lp.anchor_id AND sk.proto_id = lp.proto_id AND sk.view_no <> lp.view_no)"""


def _crops(value: str, out: str) -> str:
    return f"""SELECT round(avg(m), 6) AS {out} FROM (SELECT i, avg(m) AS m FROM (SELECT i, v, avg(x) AS m FROM (
        SELECT anchor_id, i, v, sum({value}) AS x FROM pr GROUP BY ALL) GROUP BY ALL) GROUP BY ALL)"""


def _q_and_scores(spark, sf):
    """Assignments and the scores they come from; scores are written once."""
    scores = cut_lineage(_view_scores(spark, sf))
    return assign.sinkhorn(scores, EPS, by=["view_no"]), scores


@query("swapped_cross_entropy", "J16", f"{VIEW_Q}, {VIEW_P} {_crops('-q * logp', 'loss')}")
def swapped_cross_entropy(spark, sf):
    return rounded(assign.swapped_cross_entropy(*_q_and_scores(spark, sf), TEMP))


@query("swapped_kl", "J17", f"{VIEW_Q}, {VIEW_P} {_crops('q * (ln(q + 1e-9) - ln(p + 1e-9))', 'kl')}")
def swapped_kl(spark, sf):
    return rounded(assign.swapped_kl(*_q_and_scores(spark, sf), TEMP))


@query("swapped_kl_reverse", "J17", f"{VIEW_Q}, {VIEW_P} {_crops('p * (ln(p + 1e-9) - ln(q + 1e-9))', 'kl')}")
def swapped_kl_reverse(spark, sf):
    return rounded(assign.swapped_kl(*_q_and_scores(spark, sf), TEMP, reverse=True))


@query(
    "pair_matching",
    "J18",
    f"""{t.WITH_PROTOS}, {VIEWS}, b AS (SELECT anchor_id, view_no, arg_max(proto_id, s) AS k FROM scores GROUP BY ALL)
        SELECT sum((x.k = y.k)::INT)::BIGINT AS matches, round(avg((x.k = y.k)::INT), 6) AS ratio
        FROM b x JOIN b y USING (anchor_id) WHERE x.view_no = 0 AND y.view_no = 1""",
)
def pair_matching(spark, sf):
    s = _view_scores(spark, sf)
    return rounded(assign.pair_matching(s.where("view_no = 0"), s.where("view_no = 1")))


@query(
    "usage_entropy",
    "J19",
    f"""{t.WITH_SIMS}, {_SOFT}, u AS (SELECT proto_id, sum(p) AS w FROM soft GROUP BY 1), n AS (SELECT w / sum(w) OVER () AS w FROM u)
        SELECT round((SELECT -sum(w * ln(w)) FROM n), 6) AS usage_entropy,
               round((SELECT avg(h) FROM (SELECT -sum(p * ln(p + 1e-9)) AS h FROM soft GROUP BY cell_id)), 6) AS row_entropy""",
)
def usage_entropy(spark, sf):
    return rounded(assign.usage_entropy(assign.softmax(_scores(spark, sf), TEMP)))


_COS = "cosd AS (SELECT cell_id, study, proto_id, 1 - list_cosine_similarity(e.vec, p.vec) AS d FROM emb e, protos p)"


@query("coverage", "J20", f"{t.WITH_PROTOS}, {_COS} SELECT round(max(d), 6) AS coverage FROM (SELECT min(d) AS d FROM cosd GROUP BY cell_id)")
def coverage(spark, sf):
    return rounded(proto.coverage(t.emb(spark, sf), t.protos(spark, sf)))


@query(
    "prototype_coverage",
    "J21",
    f"{t.WITH_PROTOS}, {_COS} SELECT round(max(d), 6) AS prototype_coverage FROM (SELECT min(d) AS d FROM cosd GROUP BY proto_id)",
)
def prototype_coverage(spark, sf):
    return rounded(proto.prototype_coverage(t.emb(spark, sf), t.protos(spark, sf)))


@query(
    "prototype_cost",
    "J22",
    f"""{t.WITH_DISTS} SELECT round(0.05 * (SELECT avg(m) FROM (SELECT min(d) AS m FROM dists GROUP BY cell_id))
        + 0.05 * (SELECT avg(m) FROM (SELECT min(d) AS m FROM dists GROUP BY proto_id)), 6) AS cost""",
)
def prototype_cost(spark, sf):
    return rounded(proto.prototype_cost(t.emb(spark, sf), t.protos(spark, sf)))


@query("repulsion", "J23", f"{t.WITH_PROTOS}, {_PP} SELECT round(sum(1 / (d + 1e-5)), 6) AS repulsion FROM pp WHERE i < j")
def repulsion(spark, sf):
    return rounded(proto.repulsion(t.protos(spark, sf)))


@query(
    "contrastive_score",
    "J24",
    f"""{t.WITH_PROTOS}, {VIEWS}, w AS (SELECT anchor_id // 128 AS batch_no, anchor_id, view_no, vec FROM views),
        s AS (SELECT a.batch_no, a.anchor_id, a.view_no, b.anchor_id = a.anchor_id AS pos, list_cosine_similarity(a.vec, b.vec) / 0.5 AS x
              FROM w a JOIN w b ON a.batch_no = b.batch_no AND NOT (a.anchor_id = b.anchor_id AND a.view_no = b.view_no)),
        l AS (SELECT batch_no, anchor_id, view_no, ln(sum(exp(x))) - max(x) FILTER (pos) AS loss FROM s GROUP BY ALL)
        SELECT batch_no, round(avg(loss), 6) AS loss FROM l GROUP BY 1""",
)
def contrastive_score(spark, sf):
    views = _views(spark, sf).withColumn("batch_no", F.floor(F.col("anchor_id") / 128))
    return rounded(assign.contrastive_score(views))


@query(
    "redundancy_score",
    "J25",
    f"""{t.WITH_PROTOS}, {VIEWS}, st AS (SELECT view_no, dim, avg(v) AS m, var_pop(v) AS s2 FROM vdims GROUP BY ALL),
        z AS (SELECT anchor_id, view_no, dim, (v - m) / sqrt(s2 + 1e-5) AS z FROM vdims JOIN st USING (view_no, dim)),
        c AS (SELECT a.dim AS i, b.dim AS j, avg(a.z * b.z) AS c FROM z a JOIN z b ON a.anchor_id = b.anchor_id
              WHERE a.view_no = 0 AND b.view_no = 1 GROUP BY ALL)
        SELECT round(sum(CASE WHEN i = j THEN (1 - c) ** 2 ELSE 0.0051 * c * c END), 6) AS redundancy FROM c""",
)
def redundancy_score(spark, sf):
    v = _views(spark, sf)
    a = v.where("view_no = 0").select("anchor_id", F.col("vec").alias("a"))
    b = v.where("view_no = 1").select("anchor_id", F.col("vec").alias("b"))
    return rounded(assign.redundancy_score(a.join(b, "anchor_id")))


@query("kmeans_prototypes", "J27")
def kmeans_prototypes(spark, sf):
    centres, assigned = assign.kmeans_prototypes(t.emb(spark, sf), 16, seed=7)
    return proto.prototype_purity(assigned, centres)


def spherical_sql(k: int, rounds: int = 10, seed: int = 0) -> str:
    out = [
        f"""ud AS MATERIALIZED (SELECT cell_id, dim, v / sqrt(sum(v * v) OVER (PARTITION BY cell_id)) AS v FROM dims)""",
        "ue AS MATERIALIZED (SELECT cell_id, list(v ORDER BY dim) AS vec FROM ud GROUP BY 1)",
        f"""s0 AS (SELECT cell_id, vec FROM ue ORDER BY {t.u_sql(f"'{seed}'", "'centroid'", 'cell_id')}, cell_id LIMIT {k})""",
        "c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY cell_id) - 1)::INT AS proto_id, vec FROM s0)",
    ]
    for i in range(rounds + 1):
        out.append(
            f"""a{i} AS MATERIALIZED (SELECT cell_id, proto_id, s FROM (SELECT cell_id, proto_id, list_inner_product(e.vec, c.vec) AS s FROM ue e, c{i} c)
                QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY s DESC, proto_id) = 1)"""
        )
        if i < rounds:
            out.append(f"m{i} AS (SELECT proto_id, dim, avg(v) AS v FROM a{i} JOIN ud USING (cell_id) GROUP BY ALL)")
            out.append(f"n{i} AS (SELECT proto_id, sqrt(sum(v * v)) AS n FROM m{i} GROUP BY 1)")
            out.append(f"l{i} AS (SELECT proto_id, list(v / n ORDER BY dim) AS vec FROM m{i} JOIN n{i} USING (proto_id) GROUP BY 1)")
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT proto_id, coalesce(l{i}.vec, c{i}.vec) AS vec FROM c{i} LEFT JOIN l{i} USING (proto_id))")
    return ", ".join(out)


@query("spherical_kmeans", "J28", f"WITH {t.EMB}, {t.DIMS}, {spherical_sql(8)} SELECT cell_id, proto_id, round(s, 6) AS score FROM a10")
def spherical_kmeans(spark, sf):
    _, assigned = assign.spherical_kmeans(t.emb(spark, sf), 8)
    return rounded(assigned.select("cell_id", "proto_id", "score"))


@query("spherical_kmeans_banks", "J28")
def spherical_kmeans_banks(spark, sf):
    v = _views(spark, sf)
    banks = {i: v.where(F.col("view_no") == i).select(F.col("anchor_id").alias("cell_id"), "vec") for i in (0, 1)}
    return assign.spherical_kmeans_banks(banks, [8, 8, 16], rounds=3)


def _bank(spark, sf):
    return t.table(spark, sf, "events").select(
        (F.dayofmonth("ts") % 2).alias("bank_no"),
        F.col("user_id").alias("cell_id"),
        F.array(F.col("value"), F.col("event_id").cast("double")).alias("vec"),
        F.col("event_id").alias("step"),
    )


@query(
    "bank_latest",
    "J29",
    """SELECT (day(ts) % 2)::INT AS bank_no, user_id AS cell_id, arg_max(value, event_id) AS v0, max(event_id) AS step FROM events GROUP BY 1, 2""",
)
def bank_latest(spark, sf):
    return assign.bank_latest(_bank(spark, sf)).select("bank_no", "cell_id", F.col("vec")[0].alias("v0"), "step")


@query(
    "bank_update",
    "J29",
    """SELECT (day(ts) % 2)::INT AS bank_no, user_id AS cell_id, arg_max(value, event_id) AS v0, max(event_id) AS step
       FROM events GROUP BY 1, 2""",
)
def bank_update(spark, sf):
    all_rows = _bank(spark, sf)
    first = assign.bank_latest(all_rows.where("vec[0] < 20"))
    return assign.bank_update(first, all_rows.where("vec[0] >= 20")).select("bank_no", "cell_id", F.col("vec")[0].alias("v0"), "step")


@query(
    "queue_assignment",
    "J30",
    f"""{t.WITH_SIMS}, recent AS (SELECT DISTINCT cell_id FROM scores WHERE study <> 'study_3' ORDER BY cell_id DESC LIMIT 128),
        used AS (SELECT cell_id, proto_id, s FROM scores WHERE study = 'study_3' OR cell_id IN (SELECT cell_id FROM recent)),
        {sinkhorn_sql('used', 'sk')} SELECT cell_id, proto_id, round(q, 6) AS q FROM sk JOIN emb USING (cell_id) WHERE study = 'study_3'""",
)
def queue_assignment(spark, sf):
    s = _scores(spark, sf)
    queue = s.where("study <> 'study_3'").select("cell_id", F.col("cell_id").alias("step"), "s")
    return _long(assign.queue_assignment(queue, s.where("study = 'study_3'"), 128, epsilon=EPS), "q")


@query("distance_embedding", "J32", f"{t.WITH_DISTS} SELECT cell_id, 'X_proto' AS key, proto_id AS dim, round(d, 6) AS v FROM dists")
def distance_embedding(spark, sf):
    out = proto.distance_embedding(t.emb(spark, sf), t.protos(spark, sf))
    return rounded(out.select("cell_id", "key", F.posexplode("vec").alias("dim", "v")))


@query(
    "unit_vectors",
    "G14",
    f"WITH {t.EMB}, {t.DIMS} SELECT cell_id, dim::INT AS dim, CASE WHEN abs(x) < 5e-7 THEN 0.0 ELSE round(x, 6) END AS v FROM (SELECT cell_id, dim, v / sqrt(sum(v * v) OVER (PARTITION BY cell_id)) AS x FROM dims)",
)
def unit_vectors(spark, sf):
    u = t.emb(spark, sf).select("cell_id", V.unit_kernel()("vec").alias("vec"))
    return rounded(u.select("cell_id", F.posexplode("vec").alias("dim", "v")))
