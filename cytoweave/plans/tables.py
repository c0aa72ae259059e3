"""Engine tables derived from the given parquet tables, and the same rules as SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec as V
from ..session import ship_package

DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# --- dense family: one vector per cell ------------------------------------------------


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, cell_type, study, batch, label, vec."""
    study = F.concat(F.lit("study_"), (F.col("vec_id") % 4).cast("string"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("cell_id"),
        F.concat(F.lit("type_"), F.col("label").cast("string")).alias("cell_type"),
        study.alias("study"),
        study.alias("batch"),
        F.col("label"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def emb_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations only: the vectors are never read."""
    return emb(spark, sf_dir).select("cell_id", "cell_type", "study", "batch")


def protos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit mean vector of every label."""
    means = emb(spark, sf_dir).groupBy("label").agg(V.mean_vector("vec").alias("vec"))
    return means.select(F.col("label").alias("proto_id"), V.unit("vec").alias("vec"))


EMB = """emb AS (
  SELECT vec_id AS cell_id, 'type_' || label AS cell_type, 'study_' || (vec_id % 4) AS study,
         'study_' || (vec_id % 4) AS batch, label, embedding::DOUBLE[] AS vec
  FROM embeddings)"""
DIMS = """dims AS (
  SELECT cell_id, cell_type, study, label, unnest(range(0, 64)) AS dim, unnest(vec) AS v FROM emb)"""
PROTOS = """pmean AS (SELECT label AS proto_id, dim, avg(v) AS v FROM dims GROUP BY ALL),
pnorm AS (SELECT proto_id, sqrt(sum(v * v)) AS n FROM pmean GROUP BY ALL),
protos AS (SELECT proto_id, list(v / n ORDER BY dim) AS vec FROM pmean JOIN pnorm USING (proto_id) GROUP BY ALL)"""
SIMS = """scores AS (
  SELECT cell_id, cell_type, study, label, proto_id, list_inner_product(e.vec, p.vec) AS s FROM emb e, protos p)"""
DISTS = """dists AS (
  SELECT cell_id, cell_type, study, label, proto_id, list_distance(e.vec, p.vec) AS d FROM emb e, protos p)"""
WITH_PROTOS = f"WITH {EMB}, {DIMS}, {PROTOS}"
WITH_SIMS = f"{WITH_PROTOS}, {SIMS}"
WITH_DISTS = f"{WITH_PROTOS}, {DISTS}"


def knn_sql(k: int, expr: str = "list_distance(a.vec, b.vec) ** 2", name: str = "knn", where: str = "a.cell_id <> b.cell_id") -> str:
    return f"""{name} AS (
  SELECT src, dst, rank, dist FROM (
    SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM (
      SELECT a.cell_id AS src, b.cell_id AS dst, {expr} AS dist FROM emb a, emb b WHERE {where}))
  WHERE rank <= {k})"""


def u_sql(*parts: str) -> str:
    """The keyed draw in SQL; parts are SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0)"


# --- sparse family: cell x gene counts --------------------------------------------------


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"))
        .agg(F.sum("l_quantity").alias("x"))
    )


def count_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return (
        o.join(c, o.o_custkey == c.c_custkey, "left")
        .join(n, c.c_nationkey == n.n_nationkey, "left")
        .select(
            F.col("o_orderkey").alias("cell_id"),
            F.col("o_orderpriority").alias("cell_type"),
            F.col("c_mktsegment").alias("study"),
            F.col("n_name").alias("batch"),
        )
    )


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("gene_id"),
        F.concat_ws("_", "p_name", F.col("p_partkey").cast("string")).alias("gene_name"),
        F.col("p_brand").startswith("Brand#1").alias("mt"),
    )


COUNTS = "counts AS (SELECT l_orderkey AS cell_id, l_partkey AS gene_id, sum(l_quantity) AS x FROM lineitem GROUP BY ALL)"
CELLS = """cells AS (
  SELECT o_orderkey AS cell_id, o_orderpriority AS cell_type, c_mktsegment AS study, n_name AS batch
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""
GENES = """genes AS (
  SELECT p_partkey AS gene_id, p_name || '_' || p_partkey AS gene_name, starts_with(p_brand, 'Brand#1') AS mt FROM part)"""
WITH_COUNTS = f"WITH {COUNTS}, {CELLS}, {GENES}"


# --- small dense matrix: user x event type ----------------------------------------------


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell = user, gene = event type (by name), x = number of events."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("cell_id"), F.col("event_type").alias("gene"))
        .agg(F.count("*").cast("double").alias("x"))
    )


EVENTS = "ec AS (SELECT user_id AS cell_id, event_type AS gene, count(*)::DOUBLE AS x FROM events GROUP BY ALL)"
EVENT_GRID = f"""{EVENTS},
grid AS (
  SELECT c.cell_id, g.gene, coalesce(ec.x, 0) AS x
  FROM (SELECT DISTINCT cell_id FROM ec) c CROSS JOIN (SELECT DISTINCT gene FROM ec) g
  LEFT JOIN ec ON ec.cell_id = c.cell_id AND ec.gene = g.gene)"""


def metric_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-run metric table: model = return flag, fold = line number, three metrics."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").cast("bigint").alias("fold"))
        .agg(
            F.avg("l_discount").alias("bio"),
            F.avg("l_tax").alias("batch_mix"),
            F.avg("l_quantity").alias("size"),
        )
    )


RUNS = """runs AS (
  SELECT l_returnflag AS model, l_linenumber::BIGINT AS fold, avg(l_discount) AS bio, avg(l_tax) AS batch_mix,
         avg(l_quantity) AS size FROM lineitem GROUP BY ALL)"""
