"""Round trips through the stored forms."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..bundle import Bundle
from ..functions.ranks import quantile_buckets, running_sum
from ..session import cut_lineage, scratch_path
from ..sources import catalog, mtx, results
from . import tables as t
from .graph_queries import WITH_EMB, _OUT, knn
from .registry import query, rounded


@query(
    "read_annotated",
    "A1, A3",
    f"""{t.WITH_COUNTS} SELECT cell_type, gene_name, sum(x) AS total FROM counts JOIN cells USING (cell_id) JOIN genes USING (gene_id) GROUP BY 1, 2""",
)
def read_annotated(spark, sf):
    path = scratch_path(spark, "annotated")
    catalog.write_annotated(Bundle(t.count_cells(spark, sf), t.genes(spark, sf), t.counts(spark, sf)), path)
    b = catalog.read_annotated(spark, path)
    return b.counts.join(b.cells, "cell_id").join(b.genes, "gene_id").groupBy("cell_type", "gene_name").agg(F.sum("x").alias("total"))


def _positions(df, key, out):
    """1-based positions in the order of ``key``, which may have gaps."""
    cut = quantile_buckets(df.where(F.col(key).isNotNull()), key, "_q")
    return running_sum(cut, [], F.col("_q"), [key], F.lit(1), out).withColumn(out, F.col(out).cast("bigint")).drop("_q")


@query(
    "read_mtx",
    "A2",
    f"""{t.WITH_COUNTS} SELECT c_name AS barcode, gene_name, sum(x) AS x FROM counts JOIN orders ON o_orderkey = cell_id
        JOIN customer ON c_custkey = o_custkey JOIN genes USING (gene_id) GROUP BY 1, 2""",
)
def read_mtx(spark, sf):
    """Customers as barcodes, parts as features; keys become list positions, and equal names are one row of the answer."""
    customers = cut_lineage(_positions(t.table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", "cell_id"))
    parts = cut_lineage(_positions(t.genes(spark, sf).withColumnRenamed("gene_id", "p_partkey"), "p_partkey", "gene_id"))
    orders = t.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    raw = t.counts(spark, sf).select(F.col("cell_id").alias("o_orderkey"), F.col("gene_id").alias("p_partkey"), "x").join(orders, "o_orderkey")
    placed = raw.join(customers.select("c_custkey", "cell_id"), "c_custkey").join(parts.select("p_partkey", "gene_id"), "p_partkey")
    counts = placed.groupBy("cell_id", "gene_id").agg(F.sum("x").alias("x"))
    cells, genes = customers.select("cell_id", F.col("c_name").alias("barcode")), parts.select("gene_id", "gene_name", "mt")
    path = scratch_path(spark, "mtx")
    mtx.write_mtx(Bundle(cells, genes, counts), path)
    b = mtx.read_mtx(spark, path)
    return b.counts.join(b.cells, "cell_id").join(b.genes, "gene_id").groupBy("barcode", "gene_name").agg(F.sum("x").alias("x"))


def _long_runs(spark, sf):
    runs = t.metric_runs(spark, sf).withColumn("split", F.concat(F.lit("fold_"), F.col("fold").cast("string")))
    return runs.select("model", "split", F.expr("stack(2, 'bio', bio, 'size', size) as (metric, value)"))


LONG = f"""{t.RUNS}, lr AS (SELECT model, 'fold_' || fold AS split, 'bio' AS metric, bio AS value FROM runs
  UNION ALL SELECT model, 'fold_' || fold, 'size', size FROM runs)"""


@query("stored_metrics", "A4", f"WITH {LONG} SELECT model, split, metric, round(value, 6) AS value FROM lr WHERE model = 'A'")
def stored_metrics(spark, sf):
    path = scratch_path(spark, "metrics")
    results.save_metrics(_long_runs(spark, sf), path)
    return rounded(results.load_metrics(spark, path, model="A"))


@query("cached_graph", "A5", f"{WITH_EMB}, {t.knn_sql(10)} {_OUT}")
def cached_graph(spark, sf):
    root = scratch_path(spark, "graphs")
    path = results.graph_path(root, "embeddings", t.table(spark, sf, "embeddings").count(), None, None, 10)
    results.cached_graph(spark, path, lambda: knn(spark, sf))
    return rounded(results.cached_graph(spark, path, lambda: knn(spark, sf)))


@query(
    "label_dictionary",
    "A6",
    """SELECT doc_id, source, dense_rank() OVER (ORDER BY source) - 1 AS label_id FROM documents""",
)
def label_dictionary(spark, sf):
    docs = t.table(spark, sf, "documents").select("doc_id", "source")
    path = scratch_path(spark, "dictionary")
    catalog.save_label_dictionary(catalog.fit_label_dictionary(docs, "source"), path)
    return catalog.encode_labels(docs, catalog.load_label_dictionary(spark, path), "source")


@query(
    "exported_sheets",
    "A8",
    f"""{t.WITH_COUNTS} SELECT 'genes' AS sheet, count(*) AS n FROM genes UNION ALL SELECT 'types', count(DISTINCT cell_type) FROM cells""",
)
def exported_sheets(spark, sf):
    path = scratch_path(spark, "sheets")
    types = t.count_cells(spark, sf).groupBy("cell_type").agg(F.count("*").alias("n"))
    results.export_sheets({"genes": t.genes(spark, sf), "types": types}, path)
    read = lambda s: spark.read.option("header", True).csv(os.path.join(path, s)).agg(F.count("*").alias("n")).select(F.lit(s).alias("sheet"), "n")
    return read("genes").unionAll(read("types"))


@query(
    "missing_results",
    "A9",
    f"""WITH {LONG} SELECT model, split, metric FROM lr WHERE NOT (metric = 'bio' AND model = 'A')""",
)
def missing_results(spark, sf):
    wanted = _long_runs(spark, sf)
    stored = wanted.where("metric = 'bio' and model = 'A'")
    return results.missing_results(wanted.select("model", "split", "metric"), stored)


@query("reuse_or_compute", "A9", f"WITH {LONG} SELECT model, split, metric, round(value, 6) AS value FROM lr")
def reuse_or_compute(spark, sf):
    path = scratch_path(spark, "metrics")
    wanted = _long_runs(spark, sf)
    results.save_metrics(wanted.where("model = 'A'"), path)
    fill = lambda todo: wanted.join(todo, ["model", "split", "metric"], "left_semi")
    return rounded(results.reuse_or_compute(spark, path, wanted.select("model", "split", "metric"), fill))
