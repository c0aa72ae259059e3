"""Neighbour graph, same-label share, communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, neighbors, proto
from ..session import cut_lineage
from . import tables as t
from .prototype_queries import WITH_ASSIGNED
from .registry import query, rounded

K = 10
WITH_EMB = f"WITH {t.EMB}"
KNN = t.knn_sql(K)


def knn(spark, sf, k=K, metric="l2sq", **kw):
    return neighbors.knn_graph(t.emb(spark, sf).select("cell_id", "vec"), k, metric, **kw)


_OUT = "SELECT src, dst, rank::INT AS rank, round(dist, 6) AS dist FROM knn"


@query("knn_squared_l2", "H1", f"{WITH_EMB}, {KNN} {_OUT}")
def knn_squared_l2(spark, sf):
    return rounded(knn(spark, sf))


@query("knn_l2", "H2", f"{WITH_EMB}, {t.knn_sql(K, 'list_distance(a.vec, b.vec)')} {_OUT}")
def knn_l2(spark, sf):
    return rounded(knn(spark, sf, metric="l2"))


@query("knn_cosine", "H3", f"{WITH_EMB}, {t.knn_sql(K, '1 - list_cosine_similarity(a.vec, b.vec)')} {_OUT}")
def knn_cosine(spark, sf):
    return rounded(knn(spark, sf, metric="cosine"))


def _probed(pivots: int, nprobe: int) -> str:
    """Neighbours among the rows whose nearest pivot is one of the query's ``nprobe`` nearest."""
    u = t.u_sql("'pivot'", "cell_id")
    return f"""pv AS (SELECT row_number() OVER (ORDER BY {u}, cell_id) AS p, vec FROM emb QUALIFY p <= {pivots}),
        dp AS (SELECT cell_id, p, row_number() OVER (PARTITION BY cell_id ORDER BY list_distance(e.vec, v.vec), p) AS r FROM emb e, pv v),
        pr AS (SELECT a.cell_id AS src, b.cell_id AS dst, list_distance(a.vec, b.vec) ** 2 AS dist FROM emb a JOIN dp x ON x.cell_id = a.cell_id AND x.r <= {nprobe}
               JOIN dp y ON y.p = x.p AND y.r = 1 JOIN emb b ON b.cell_id = y.cell_id WHERE a.cell_id <> b.cell_id),
        near AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM pr QUALIFY rank <= {K})"""


@query("knn_approximate", "H4", f"{WITH_EMB}, {_probed(16, 4)} SELECT src, dst, rank::INT AS rank, round(dist, 6) AS dist FROM near")
def knn_approximate(spark, sf):
    """Visit the 4 nearest of 16 groups only."""
    return rounded(knn(spark, sf, nprobe=4, pivots=16))


@query(
    "knn_recall",
    "H4",
    f"""{WITH_EMB}, {KNN}, {_probed(16, 4)} SELECT round(avg((near.dst IS NOT NULL)::INT), 6) AS recall
        FROM knn LEFT JOIN near ON near.src = knn.src AND near.dst = knn.dst""",
)
def knn_recall(spark, sf):
    found = knn(spark, sf, nprobe=4, pivots=16)
    return rounded(neighbors.knn_recall(found, knn(spark, sf)))


EDGES = "edges AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM knn)"
BOTH = "both_dir AS (SELECT a AS src, b AS dst FROM edges UNION ALL SELECT b, a FROM edges)"


@query("undirected_edges", "H5", f"{WITH_EMB}, {KNN}, {EDGES} SELECT a, b FROM edges")
def undirected_edges(spark, sf):
    return neighbors.undirected_edges(knn(spark, sf))


@query(
    "restrict_graph",
    "H6",
    f"{WITH_EMB}, {KNN} SELECT src, dst, rank::INT AS rank FROM knn WHERE dst IN (SELECT cell_id FROM emb WHERE study IN ('study_0', 'study_2'))",
)
def restrict_graph(spark, sf):
    nodes = t.emb_cells(spark, sf).where(F.col("study").isin("study_0", "study_2"))
    return neighbors.restrict_graph(knn(spark, sf), nodes).select("src", "dst", "rank")


_SAME = "avg((x.cell_type = y.cell_type)::INT)"


@query(
    "same_label_fraction",
    "H7",
    f"""{WITH_EMB}, {KNN}, {EDGES}, {BOTH}, f AS (
          SELECT src, x.cell_type, {_SAME} AS f FROM both_dir JOIN emb x ON x.cell_id = src JOIN emb y ON y.cell_id = dst GROUP BY 1, 2)
        SELECT cell_type, round(avg(f), 6) AS same_label_fraction, count(*) AS n_cells FROM f GROUP BY 1""",
)
def same_label_fraction(spark, sf):
    both = neighbors.both_directions(neighbors.undirected_edges(knn(spark, sf)))
    return rounded(neighbors.same_label_fraction(both, t.emb_cells(spark, sf)))


@query(
    "same_label_per_cell",
    "H7",
    f"""{WITH_EMB}, {KNN} SELECT src AS cell_id, round({_SAME}, 6) AS fraction
        FROM knn JOIN emb x ON x.cell_id = src JOIN emb y ON y.cell_id = dst GROUP BY 1""",
)
def same_label_per_cell(spark, sf):
    return rounded(neighbors.same_label_per_cell(knn(spark, sf), t.emb_cells(spark, sf)))


def label_share_board(spark, sf):
    """Flagship: labels ordered by the share of neighbours that agree with them."""
    return same_label_fraction(spark, sf).orderBy(F.desc("same_label_fraction"), F.asc("cell_type"))


def _weighted(spark, sf):
    both = neighbors.both_directions(neighbors.undirected_edges(knn(spark, sf)))
    return both.withColumn("w", F.lit(1.0))


@query("communities", "H8")
def communities(spark, sf):
    return graph.communities(t.emb_cells(spark, sf), _weighted(spark, sf))


@query("community_modularity", "H8")
def community_modularity(spark, sf):
    # read by the rounds and by the score: the search is done once
    edges = cut_lineage(_weighted(spark, sf))
    return rounded(graph.modularity(edges, graph.communities(t.emb_cells(spark, sf), edges)))


@query(
    "label_modularity",
    "H8",
    f"""{WITH_EMB}, {KNN}, {EDGES}, {BOTH}, tg AS (
          SELECT x.cell_type AS c, (x.cell_type = y.cell_type)::INT AS s FROM both_dir JOIN emb x ON x.cell_id = src JOIN emb y ON y.cell_id = dst),
        p AS (SELECT c, count(*) AS k, sum(s) AS i FROM tg GROUP BY 1)
        SELECT round(sum(i / (SELECT count(*) FROM tg) - (k / (SELECT count(*) FROM tg)) ** 2), 6) AS modularity, count(*) AS n_communities FROM p""",
)
def label_modularity(spark, sf):
    members = t.emb_cells(spark, sf).select("cell_id", F.col("cell_type").alias("community"))
    return rounded(graph.modularity(_weighted(spark, sf), members))


_TRADE = """trade AS (
  SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
both_dir AS (SELECT src, dst, sum(w) AS w FROM (SELECT a AS src, b AS dst, w FROM trade UNION ALL SELECT b, a, w FROM trade) GROUP BY ALL)"""


def _trade(spark, sf):
    """Nations linked by the line items that one sells to the other, in both directions."""
    o, c, li, s = (t.table(spark, sf, name) for name in ("orders", "customer", "lineitem", "supplier"))
    sold = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    sold = sold.groupBy(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).agg(F.count("*").alias("w"))
    ways = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    both = sold.select(F.explode(ways).alias("_e"), "w").select(F.col("_e.src").cast("bigint").alias("src"), F.col("_e.dst").cast("bigint").alias("dst"), "w")
    return cut_lineage(both.groupBy("src", "dst").agg(F.sum("w").cast("double").alias("w")))


@query(
    "community_invariants",
    "H8",
    f"""WITH {_TRADE}, tg AS (SELECT x.n_regionkey AS c, w, CASE WHEN x.n_regionkey = y.n_regionkey THEN w ELSE 0 END AS s
          FROM both_dir JOIN nation x ON x.n_nationkey = src JOIN nation y ON y.n_nationkey = dst),
        p AS (SELECT c, sum(w) AS k, sum(s) AS i FROM tg GROUP BY 1)
        SELECT (SELECT count(*) FROM nation) AS n_nodes, 0::BIGINT AS n_disconnected, true AS at_least_regions,
               round(sum(i / (SELECT sum(w) FROM tg) - (k / (SELECT sum(w) FROM tg)) ** 2), 6) AS region_modularity FROM p""",
)
def community_invariants(spark, sf):
    """What must hold of communities, whatever they are: all nodes, each connected inside, modularity not below the regions'."""
    nations = t.table(spark, sf, "nation")
    nodes = nations.select(F.col("n_nationkey").cast("bigint").alias("cell_id"))
    edges = _trade(spark, sf)
    found = graph.communities(nodes, edges)
    parts = graph.connected_parts(found, edges).withColumnRenamed("community", "part")
    pieces = found.join(parts, "cell_id").groupBy("community").agg(F.countDistinct("part").alias("pieces"), F.count("*").alias("n"))
    facts = pieces.agg(F.struct(F.sum("n").alias("n_nodes"), F.count(F.when(F.col("pieces") > 1, 1)).alias("n_disconnected"))).scalar()
    regions = nations.select(F.col("n_nationkey").cast("bigint").alias("cell_id"), F.col("n_regionkey").alias("community"))
    region = graph.modularity(edges, regions).select(F.col("modularity").alias("region_modularity"))
    own = graph.modularity(edges, found).select("modularity").scalar()
    told = region.withColumn("_f", facts).withColumn("at_least_regions", own >= F.col("region_modularity") - 1e-12)
    return rounded(told.select("_f.n_nodes", "_f.n_disconnected", "at_least_regions", "region_modularity"))


def _purity_sql(label: str) -> str:
    return f"""{WITH_ASSIGNED}, c AS (SELECT proto_id AS community, {label}, count(*) AS n FROM assigned GROUP BY 1, 2)
        SELECT community, sum(n)::BIGINT AS size, arg_min({label}, (-n, {label})) AS majority, round(max(n) / sum(n), 6) AS purity,
               max(n)::DOUBLE AS weighted_purity FROM c GROUP BY 1"""


def _members(spark, sf):
    return proto.nearest_prototype(t.emb(spark, sf), t.protos(spark, sf)).withColumnRenamed("proto_id", "community")


@query("community_purity_by_type", "H9", _purity_sql("cell_type"))
def community_purity_by_type(spark, sf):
    return rounded(neighbors.community_purity(_members(spark, sf)))


@query("community_purity_by_study", "H9", _purity_sql("study"))
def community_purity_by_study(spark, sf):
    return rounded(neighbors.community_purity(_members(spark, sf), label="study"))
