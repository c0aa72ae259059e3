"""Filters, splits, set operations, statistics and rankings on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rank, relate, select, splits, stats
from . import tables as t
from .registry import query, rounded

# --- projection, filter, predicate ------------------------------------------------------


@query("filter_labels", "B1", f"WITH {t.EMB} SELECT cell_id, cell_type FROM emb WHERE cell_type IN ('type_1', 'type_3', 'type_7')")
def filter_labels(spark, sf):
    return select.filter_labels(t.emb_cells(spark, sf), ["type_1", "type_3", "type_7"]).select("cell_id", "cell_type")


@query(
    "drop_singletons",
    "B2",
    """SELECT n_chars, count(*) AS n FROM documents
       WHERE n_chars IN (SELECT n_chars FROM documents GROUP BY n_chars HAVING count(*) > 1) GROUP BY n_chars""",
)
def drop_singletons(spark, sf):
    kept = select.drop_singletons(t.table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars")
    return kept.groupBy("n_chars").agg(F.count("*").alias("n"))


# gene_name values used as markers below
MARKERS = ["small ring_0", "red widget_1", "no such gene"]


@query(
    "select_genes",
    "B3",
    f"""{t.WITH_COUNTS} SELECT cell_id, gene_id, x, gene_name FROM counts JOIN genes USING (gene_id)
        WHERE gene_name IN ('small ring_0', 'red widget_1', 'no such gene')""",
)
def select_genes(spark, sf):
    return select.select_genes(t.counts(spark, sf), t.genes(spark, sf), MARKERS).select("cell_id", "gene_id", "x", "gene_name")


@query("derive_batch", "B4", f"{t.WITH_COUNTS} SELECT cell_id, study, study AS batch FROM cells")
def derive_batch(spark, sf):
    return select.derive_column(t.count_cells(spark, sf), "batch", "study").select("cell_id", "study", "batch")


@query(
    "combine_conditions",
    "B5",
    f"{t.WITH_COUNTS} SELECT study || '_' || batch AS conditions_combined, count(*) AS n FROM cells GROUP BY ALL",
)
def combine_conditions(spark, sf):
    return select.combine_conditions(t.count_cells(spark, sf), ["study", "batch"]).groupBy("conditions_combined").agg(F.count("*").alias("n"))


@query(
    "missing_to_zero",
    "B6",
    """SELECT d.doc_id, coalesce(quality, 0)::DOUBLE AS quality, coalesce(toxic, 0)::DOUBLE AS toxic
       FROM documents d LEFT JOIN labels USING (doc_id)""",
)
def missing_to_zero(spark, sf):
    docs = t.table(spark, sf, "documents").select("doc_id")
    lab = t.table(spark, sf, "labels").withColumns({c: F.col(c).cast("double") for c in ("quality", "toxic")})
    return select.missing_to_zero(docs.join(lab, "doc_id", "left"), ["quality", "toxic"])


@query(
    "coerce_numeric",
    "B7",
    r"""SELECT event_id, a, b FROM (
          SELECT event_id, try_cast(nullif(regexp_replace(event_type, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS a,
                 try_cast(CASE WHEN value > 20 THEN event_type ELSE value::VARCHAR END AS DOUBLE) AS b FROM events)
        WHERE a IS NOT NULL OR b IS NOT NULL""",
)
def coerce_numeric(spark, sf):
    raw = t.table(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("a"),
        F.when(F.col("value") > 20, F.col("event_type")).otherwise(F.col("value").cast("string")).alias("b"),
    )
    return select.coerce_numeric(raw, ["a", "b"])


@query("prefix_columns", "B8", "SELECT doc_id, quality AS label_quality, toxic AS label_toxic FROM labels")
def prefix_columns(spark, sf):
    return select.prefix_columns(t.table(spark, sf, "labels"), "label", keep=["doc_id"])


@query(
    "select_cells",
    "B9",
    f"""{t.WITH_COUNTS} SELECT * FROM cells
        WHERE cell_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)""",
)
def select_cells(spark, sf):
    ids = t.table(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("cell_id"))
    return select.select_cells(t.count_cells(spark, sf), ids)


@query(
    "lookup_cells",
    "B9",
    f"""{t.WITH_COUNTS} SELECT event_id AS pos, c.cell_id, cell_type, study, batch
        FROM events e JOIN cells c ON c.cell_id = e.user_id""",
)
def lookup_cells(spark, sf):
    positions = t.table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("cell_id"))
    return select.lookup_cells(t.count_cells(spark, sf), positions)


@query("head_rows", "B10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def head_rows(spark, sf):
    o = t.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return select.head(o, [F.desc("o_totalprice"), F.asc("o_orderkey")], 20)


@query("text_contains", "B11", f"{t.WITH_COUNTS} SELECT gene_id, gene_name FROM genes WHERE contains(gene_name, 'ring')")
def text_contains(spark, sf):
    return select.text_contains(t.genes(spark, sf), "gene_name", "ring").select("gene_id", "gene_name")


@query("text_prefix", "B11", f"{t.WITH_COUNTS} SELECT gene_id, starts_with(gene_name, 'red') AS red FROM genes")
def text_prefix(spark, sf):
    return select.text_prefix(t.genes(spark, sf), "gene_name", "red", "red").select("gene_id", "red")


@query("filter_folds", "B12", f"WITH {t.RUNS} SELECT model, fold, round(bio, 6) AS bio FROM runs WHERE fold < 5")
def filter_folds(spark, sf):
    return rounded(select.filter_folds(t.metric_runs(spark, sf), 5).select("model", "fold", "bio"))


# --- splits and samples -------------------------------------------------------------------


@query(
    "split_by_study",
    "C1",
    f"""WITH {t.EMB} SELECT cell_id, study, CASE WHEN study IN ('study_1', 'study_3') THEN 'query' ELSE 'ref' END AS split
        FROM emb""",
)
def split_by_study(spark, sf):
    return splits.split_by_study(t.emb_cells(spark, sf), ["study_1", "study_3"]).select("cell_id", "study", "split")


@query(
    "split_random",
    "C2",
    f"""{t.WITH_COUNTS}, r AS (
          SELECT cell_id, row_number() OVER (ORDER BY {t.u_sql("'42'", "'split'", "cell_id")}, cell_id) AS rn,
                 count(*) OVER () AS n FROM cells)
        SELECT cell_id, CASE WHEN rn <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r""",
)
def split_random(spark, sf):
    return splits.split_random(t.count_cells(spark, sf).select("cell_id"))


@query(
    "split_stratified",
    "C3",
    f"""{t.WITH_COUNTS}, r AS (
          SELECT cell_id, cell_type, count(*) OVER (PARTITION BY cell_type) AS n,
                 row_number() OVER (PARTITION BY cell_type ORDER BY {t.u_sql("'42'", "'strat'", "cell_id")}, cell_id) AS rn
          FROM cells)
        SELECT cell_id, cell_type, CASE WHEN rn <= floor(n * 0.2::DOUBLE + 0.5::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r""",
)
def split_stratified(spark, sf):
    return splits.split_stratified(t.count_cells(spark, sf).select("cell_id", "cell_type"))


@query(
    "fraction_subset",
    "C4",
    f"""WITH s AS (SELECT lang || '_' || doc_id AS sample_id, doc_id AS cell_id FROM documents),
        r AS (SELECT *, row_number() OVER (ORDER BY {t.u_sql("'42'", "'split'", "cell_id")}, cell_id) AS rn, count(*) OVER () AS n FROM s)
        SELECT sample_id, split_part(sample_id, '_', 1) AS "class" FROM r WHERE rn <= ceil(n * 0.1::DOUBLE)""",
)
def fraction_subset(spark, sf):
    docs = t.table(spark, sf, "documents").select(
        F.concat_ws("_", "lang", F.col("doc_id").cast("string")).alias("sample_id"), F.col("doc_id").alias("cell_id")
    )
    listed = splits.split_random(docs, 0.1).where("split = 'test'")
    return splits.fraction_subset(docs, listed).select("sample_id", "class")


@query(
    "random_ids",
    "C5",
    f"""{t.WITH_COUNTS} (SELECT cell_id FROM cells WHERE cell_id <> 7
        ORDER BY {t.u_sql("'0'", "'include'", "cell_id")}, cell_id LIMIT 49) UNION ALL SELECT cell_id FROM cells WHERE cell_id = 7""",
)
def random_ids(spark, sf):
    return splits.random_ids(t.count_cells(spark, sf), 50, 7)


@query(
    "sample_anchors",
    "C6",
    f"{t.WITH_COUNTS} SELECT cell_id FROM cells ORDER BY {t.u_sql(chr(39) + '3' + chr(39), chr(39) + 'sample' + chr(39), 'cell_id')}, cell_id LIMIT 100",
)
def sample_anchors(spark, sf):
    return splits.sample_ids(t.count_cells(spark, sf).select("cell_id"), 100, seed=3)


@query(
    "max_sample_size",
    "C7",
    f"WITH {t.EMB} SELECT least(min(n), 1000) AS sample_size FROM (SELECT count(*) AS n FROM emb GROUP BY cell_type)",
)
def max_sample_size(spark, sf):
    return splits.max_sample_size(t.emb_cells(spark, sf), 1000)


@query(
    "fold_means",
    "C8",
    f"""WITH {t.RUNS} SELECT model, round(avg(bio), 6) AS bio, round(avg(batch_mix), 6) AS batch_mix, round(avg(size), 6) AS size
        FROM runs GROUP BY model""",
)
def fold_means(spark, sf):
    return rounded(splits.fold_means(t.metric_runs(spark, sf)))


# --- joins and set operations -------------------------------------------------------------


@query(
    "join_metrics",
    "D1",
    """SELECT a.model, round(a.bio, 6) AS bio, round(b.price, 6) AS price FROM
         (SELECT l_returnflag AS model, avg(l_discount) AS bio FROM lineitem GROUP BY 1) a JOIN
         (SELECT l_returnflag AS model, avg(l_extendedprice) AS price FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) b USING (model)""",
)
def join_metrics(spark, sf):
    li = t.table(spark, sf, "lineitem")
    a = li.groupBy(F.col("l_returnflag").alias("model")).agg(F.avg("l_discount").alias("bio"))
    b = li.where("l_linestatus = 'O'").groupBy(F.col("l_returnflag").alias("model")).agg(F.avg("l_extendedprice").alias("price"))
    return rounded(relate.join_metrics(a, b))



def _long(spark, sf):
    runs = t.metric_runs(spark, sf)
    mean = runs.groupBy("model").agg(F.avg("bio").alias("bio"), F.avg("size").alias("size"))
    return mean.select("model", F.expr("stack(2, 'bio', bio, 'size', size) as (metric, value)"))


@query("side_by_side", "D3", f"WITH {t.RUNS} SELECT model, round(avg(bio), 6) AS bio, round(avg(size), 6) AS size FROM runs GROUP BY 1")
def side_by_side(spark, sf):
    return rounded(relate.side_by_side(_long(spark, sf), ["bio", "size"]))


@query(
    "stack_rows",
    "D4",
    """SELECT doc_id, lang, NULL AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels""",
)
def stack_rows(spark, sf):
    return relate.stack_rows(
        [t.table(spark, sf, "documents").select("doc_id", "lang"), t.table(spark, sf, "labels").select("doc_id", "quality")]
    )


@query(
    "partner_pools",
    "D7",
    f"""WITH {t.EMB} SELECT cell_type, study, count(*) AS n_same_study,
          sum(count(*)) OVER (PARTITION BY cell_type)::BIGINT AS n_type,
          (sum(count(*)) OVER (PARTITION BY cell_type) - count(*))::BIGINT AS n_other_study FROM emb GROUP BY 1, 2""",
)
def partner_pools(spark, sf):
    return relate.partner_pools(t.emb_cells(spark, sf))


@query(
    "unseen_values",
    "D9",
    """SELECT DISTINCT n_chars FROM documents WHERE lang = 'de'
       AND n_chars NOT IN (SELECT n_chars FROM documents WHERE lang <> 'de')""",
)
def unseen_values(spark, sf):
    docs = t.table(spark, sf, "documents")
    return relate.unseen_values(docs.where("lang = 'de'"), docs.where("lang <> 'de'"), "n_chars")


@query(
    "value_difference",
    "D10",
    """SELECT l_partkey AS gene_id FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 5""",
)
def value_difference(spark, sf):
    li = t.table(spark, sf, "lineitem")
    pick = lambda cond: li.where(cond).select(F.col("l_partkey").alias("gene_id"))
    return relate.value_difference(pick("l_quantity > 45"), pick("l_quantity < 5"))


@query(
    "value_intersection",
    "D10",
    """SELECT l_partkey AS gene_id FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity < 5""",
)
def value_intersection(spark, sf):
    li = t.table(spark, sf, "lineitem")
    pick = lambda cond: li.where(cond).select(F.col("l_partkey").alias("gene_id"))
    return relate.value_intersection(pick("l_quantity > 45"), pick("l_quantity < 5"))


@query("distinct_rounded", "D11", "SELECT DISTINCT round(l_discount * l_tax, 5) AS v, l_returnflag FROM lineitem")
def distinct_rounded(spark, sf):
    li = t.table(spark, sf, "lineitem").select((F.col("l_discount") * F.col("l_tax")).alias("v"), "l_returnflag")
    return relate.distinct_rounded(li, ["v"])


@query(
    "stack_tagged",
    "D12",
    f"""{t.WITH_PROTOS}, st AS (SELECT 'cell' AS type, cell_id AS id, vec FROM emb UNION ALL SELECT 'prototype', proto_id, vec FROM protos)
        SELECT type, id, round(list_sum(list_transform(vec, lambda v: v * v)), 6) AS norm2, round(vec[1], 6) AS first FROM st""",
)
def stack_tagged(spark, sf):
    stacked = relate.stack_tagged({"cell": (t.emb(spark, sf), "cell_id"), "prototype": (t.protos(spark, sf), "proto_id")})
    sq = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)
    return rounded(stacked.select("type", "id", sq.alias("norm2"), F.col("vec")[0].alias("first")))


# --- aggregations and label statistics -------------------------------------------------------


@query("value_counts", "E1", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def value_counts(spark, sf):
    return stats.value_counts(t.table(spark, sf, "documents"), ["lang", "source"])


@query("nunique", "E2", "SELECT count(DISTINCT l_partkey) AS n_l_partkey, count(DISTINCT l_suppkey) AS n_l_suppkey FROM lineitem")
def nunique(spark, sf):
    return stats.nunique(t.table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])


@query(
    "gene_means",
    "E3",
    f"""{t.WITH_COUNTS} SELECT g.gene_id, round(coalesce(sum(x), 0) / (SELECT count(*) FROM cells), 6) AS mean
        FROM genes g LEFT JOIN counts c USING (gene_id) GROUP BY 1""",
)
def gene_means(spark, sf):
    return rounded(stats.gene_means(t.counts(spark, sf), t.count_cells(spark, sf), t.genes(spark, sf)))


_PROFILE = """
, size AS (SELECT {k} AS g, count(*) AS n FROM cells GROUP BY 1)
, s AS (SELECT {k} AS g, gene_id, sum(x) AS s FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2)
, prof AS (SELECT size.g, genes.gene_id, coalesce(s.s, 0) / n AS v FROM size CROSS JOIN genes LEFT JOIN s ON s.g = size.g AND s.gene_id = genes.gene_id)
, cen AS (SELECT g, gene_id, v - avg(v) OVER (PARTITION BY gene_id) AS v FROM prof)
"""


@query(
    "type_profiles",
    "E4",
    f"""{t.WITH_COUNTS}{_PROFILE.format(k='cell_type')}
        SELECT g AS cell_type, gene_id, CASE WHEN abs(v) < 5e-7 THEN 0.0 ELSE round(v, 6) END AS value FROM cen""",
)
def type_profiles(spark, sf):
    return rounded(stats.group_profiles(t.counts(spark, sf), t.count_cells(spark, sf), t.genes(spark, sf)))


@query(
    "profile_correlation",
    "E5",
    f"""{t.WITH_COUNTS}{_PROFILE.format(k='cell_type')}
        {_PROFILE.format(k='study').replace(', size', ', size2').replace('FROM size ', 'FROM size2 ').replace('size.g', 'size2.g')
          .replace(', s AS', ', s2 AS').replace('LEFT JOIN s ON s.g', 'LEFT JOIN s2 ON s2.g').replace('s.gene_id = genes', 's2.gene_id = genes').replace('s.s', 's2.s')
          .replace(', prof AS', ', prof2 AS').replace('FROM prof)', 'FROM prof2)').replace(', cen AS', ', cen2 AS')}
        SELECT b.g AS study, a.g AS cell_type, round(corr(b.v, a.v), 6) AS corr FROM cen a JOIN cen2 b USING (gene_id) GROUP BY 1, 2""",
)
def profile_correlation(spark, sf):
    c, cells, g = t.counts(spark, sf), t.count_cells(spark, sf), t.genes(spark, sf)
    types = stats.group_profiles(c, cells, g, "cell_type")
    studies = stats.group_profiles(c, cells, g, "study")
    return rounded(stats.profile_correlation(studies, types, "study", "cell_type"))


@query(
    "vector_moments",
    "E6",
    f"""WITH {t.EMB}, {t.DIMS} SELECT dim::INT AS dim, CASE WHEN abs(avg(v)) < 5e-7 THEN 0.0 ELSE round(avg(v), 6) END AS mean, round(var_samp(v), 6) AS var FROM dims GROUP BY 1""",
)
def vector_moments(spark, sf):
    return rounded(stats.vector_moments(t.emb(spark, sf)))


@query(
    "vector_moments_by_label",
    "E6",
    f"""WITH {t.EMB}, {t.DIMS} SELECT cell_type, dim::INT AS dim, CASE WHEN abs(avg(v)) < 5e-7 THEN 0.0 ELSE round(avg(v), 6) END AS mean, round(var_samp(v), 6) AS var FROM dims GROUP BY 1, 2""",
)
def vector_moments_by_label(spark, sf):
    return rounded(stats.vector_moments(t.emb(spark, sf), "cell_type"))


@query(
    "weighted_average",
    "E9",
    "SELECT event_type, round(sum(value * user_id) / sum(user_id), 6) AS avg FROM events GROUP BY 1",
)
def weighted_average(spark, sf):
    return rounded(stats.weighted_average(t.table(spark, sf, "events"), "event_type", "value", "user_id"))


@query(
    "running_average",
    "E9",
    """SELECT event_id, event_type, round(sum(value * n) OVER w / sum(n) OVER w, 6) AS running_avg
       FROM (SELECT *, user_id + 1 AS n FROM events)
       WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def running_average(spark, sf):
    e = t.table(spark, sf, "events").select("event_id", "ts", "event_type", "value", (F.col("user_id") + 1).alias("n"))
    out = stats.running_average(e, "event_type", ["ts", "event_id"], F.date_trunc("hour", "ts"), "value", "n")
    return rounded(out.select("event_id", "event_type", "running_avg"))


@query(
    "batch_averages",
    "E11",
    """SELECT round(avg(m), 6) AS plain, round(sum(m * n) / sum(n), 6) AS weighted
       FROM (SELECT l_suppkey, avg(l_discount) AS m, count(*) AS n FROM lineitem GROUP BY 1)""",
)
def batch_averages(spark, sf):
    per = t.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("m"), F.count("*").alias("n"))
    return rounded(stats.batch_averages(per, "m", "n"))


@query(
    "crosstab",
    "E12",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
       count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""",
)
def crosstab(spark, sf):
    return stats.crosstab(t.table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query(
    "marker_axes",
    "E13",
    f"""{t.WITH_COUNTS} SELECT cell_type, round(coalesce(sum(x) FILTER (gene_id = 10), 0) / count(DISTINCT cell_id), 6) AS x_mean,
          round(coalesce(sum(x) FILTER (gene_id = 20), 0) / count(DISTINCT cell_id), 6) AS y_mean
        FROM cells LEFT JOIN counts USING (cell_id) GROUP BY 1""",
)
def marker_axes(spark, sf):
    return rounded(stats.marker_axes(t.counts(spark, sf), t.count_cells(spark, sf), 10, 20))


# --- ranking ------------------------------------------------------------------------------------


@query(
    "top_genes_by_difference",
    "F3",
    f"""{t.WITH_COUNTS}{_PROFILE.format(k='cell_type')}
        , st AS (SELECT study AS g, gene_id, sum(x) AS s FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2)
        , sz AS (SELECT study AS g, count(*) AS n FROM cells GROUP BY 1)
        , ps AS (SELECT sz.g, genes.gene_id, coalesce(s, 0) / n AS v FROM sz CROSS JOIN genes LEFT JOIN st ON st.g = sz.g AND st.gene_id = genes.gene_id)
        , d AS (SELECT p.g AS cell_type, ps.g AS study, gene_id, p.v - ps.v AS diff FROM prof p JOIN ps USING (gene_id))
        SELECT cell_type, study, gene_id, round(diff, 6) AS diff, rank::INT AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY cell_type, study ORDER BY diff DESC, gene_id) AS rank FROM d) WHERE rank <= 5""",
)
def top_genes_by_difference(spark, sf):
    c, cells, g = t.counts(spark, sf), t.count_cells(spark, sf), t.genes(spark, sf)
    types = stats.group_profiles(c, cells, g, "cell_type", centre=False)
    studies = stats.group_profiles(c, cells, g, "study", centre=False)
    return rounded(rank.top_genes_by_difference(types, studies, 5, "cell_type", "study"))


@query(
    "top_markers",
    "F5",
    f"""{t.WITH_COUNTS} SELECT DISTINCT gene_id FROM (
          SELECT gene_id, row_number() OVER (PARTITION BY cell_type ORDER BY sum(x) DESC, gene_id) AS rn
          FROM counts JOIN cells USING (cell_id) GROUP BY cell_type, gene_id) WHERE rn <= 5""",
)
def top_markers(spark, sf):
    ranked = (
        t.counts(spark, sf).join(t.count_cells(spark, sf).select("cell_id", "cell_type"), "cell_id")
        .groupBy("cell_type", "gene_id").agg(F.sum("x").alias("score"))
    )
    return rank.top_markers(ranked, "cell_type", "score", 5)


@query(
    "order_groups",
    "F6",
    """SELECT source, n, row_number() OVER (ORDER BY n DESC, source)::INT AS position
       FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)""",
)
def order_groups(spark, sf):
    return rank.order_groups(stats.value_counts(t.table(spark, sf, "documents"), ["source"]), "source", "n")


@query(
    "leaderboard",
    "F7",
    f"""WITH {t.RUNS}, w AS (SELECT model || '_' || fold AS model, bio, batch_mix, size FROM runs),
        best AS (SELECT * FROM w WHERE starts_with(model, 'N') ORDER BY bio DESC, model LIMIT 1)
        SELECT w.model, round(w.bio, 6) AS bio, round(w.batch_mix, 6) AS batch_mix, round(w.size, 6) AS size,
               w.bio > b.bio AS bio_above, w.batch_mix > b.batch_mix AS batch_mix_above, w.size > b.size AS size_above
        FROM w, best b""",
)
def leaderboard(spark, sf):
    runs = t.metric_runs(spark, sf).select(
        F.concat_ws("_", "model", F.col("fold").cast("string")).alias("model"), "bio", "batch_mix", "size"
    )
    return rounded(rank.leaderboard(runs, "bio", ["bio", "batch_mix", "size"], F.col("model").startswith("N")))


_ARR = """arr AS (
  SELECT l_orderkey AS anchor_id, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS views FROM lineitem GROUP BY 1),
  ex AS (SELECT anchor_id, unnest(views) AS v, unnest(range(1, len(views) + 1)) AS pos FROM arr),
  maj AS (SELECT anchor_id, v AS majority FROM (
    SELECT anchor_id, v, row_number() OVER (PARTITION BY anchor_id ORDER BY count(*) DESC, min(pos)) AS rn FROM ex GROUP BY 1, 2) WHERE rn = 1)"""


def _arrays(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")))
    return t.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("anchor_id")).agg(
        F.transform(ordered, lambda r: r["l_returnflag"]).alias("views")
    )


@query("majority_of_array", "F8", f"WITH {_ARR} SELECT anchor_id, majority FROM maj")
def majority_of_array(spark, sf):
    return rank.majority_of_array(_arrays(spark, sf), "views", "majority").select("anchor_id", "majority")


@query("rows_by_majority", "F9", f"WITH {_ARR} SELECT majority, count(*) AS n, min(anchor_id) AS first_anchor FROM maj GROUP BY 1")
def rows_by_majority(spark, sf):
    return rank.rows_by_majority(_arrays(spark, sf), "views")


@query(
    "log_scaled",
    "F10",
    """SELECT l_partkey, round(ln(1 + n) / max(ln(1 + n)) OVER (), 6) AS scaled FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)""",
)
def log_scaled(spark, sf):
    n = t.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return rounded(rank.log_scaled(n, "n", "scaled").select("l_partkey", "scaled"))


@query("label_index", "F11", "SELECT doc_id, source, dense_rank() OVER (ORDER BY source) - 1 AS label_id FROM documents")
def label_index(spark, sf):
    return rank.label_index(t.table(spark, sf, "documents").select("doc_id", "source"), "source")
