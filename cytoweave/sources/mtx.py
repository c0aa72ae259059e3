"""MatrixMarket triple: matrix, barcodes, features."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bundle import Bundle
from ..functions.ranks import running_sum


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(ordinal, value)`` with 1-based line numbers, part files by name: a folder may list them in any order."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start")
    lines = spark.read.text(path).select(place.alias("_place"), F.monotonically_increasing_id().alias("_at"), "value")
    numbered = running_sum(lines, [], F.col("_place"), ["_at"], F.lit(1), "ordinal")
    return numbered.select(F.col("ordinal").cast("bigint").alias("ordinal"), "value")


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """Entries ``(i, j, x)`` of a coordinate matrix; ``path`` is a file or a folder of parts.

    Comment lines are dropped.  The size line is the first other line of the file that
    carries the banner; an entry that reads exactly like it is kept.
    """
    raw = spark.read.text(path)
    banner = raw.where(F.col("value").startswith("%%MatrixMarket")).select(F.input_file_name()).first()
    if banner is None:
        raise ValueError(f"{path}: no MatrixMarket banner")
    size = spark.sparkContext.textFile(banner[0]).filter(lambda s: not s.startswith("%")).first()
    body = raw.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    twins = body.where(F.col("value") == size).groupBy("value").agg(F.count("*").alias("n"))
    again = twins.where("n > 1").select(F.explode(F.array_repeat("value", (F.col("n") - 1).cast("int"))).alias("value"))
    parts = F.split(F.trim("value"), r"\s+")
    entries = body.where(F.col("value") != size).unionAll(again)
    return entries.select(
        parts[0].cast("bigint").alias("i"), parts[1].cast("bigint").alias("j"), parts[2].cast("double").alias("x")
    )


def read_mtx(
    spark: SparkSession, folder: str, matrix: str = "matrix.mtx", barcodes: str = "barcodes.tsv", features: str = "genes.tsv"
) -> Bundle:
    """Genes x cells matrix with its two name lists.

    ``cell_id`` and ``gene_id`` are the 1-based positions of the lists; gene names are
    the second column of the feature list when there is one.
    """
    names = _numbered_lines(spark, os.path.join(folder, features))
    cols = F.split("value", "\t")
    genes = names.select(
        F.col("ordinal").alias("gene_id"), F.coalesce(F.get(cols, F.lit(1)), cols[0]).alias("gene_name")
    ).withColumn("mt", F.col("gene_name").startswith("MT-"))
    cells = _numbered_lines(spark, os.path.join(folder, barcodes)).select(
        F.col("ordinal").alias("cell_id"),
        F.lit(None).cast("string").alias("cell_type"),
        F.lit(None).cast("string").alias("study"),
        F.lit(None).cast("string").alias("batch"),
        F.col("value").alias("barcode"),
    )
    counts = read_coordinates(spark, os.path.join(folder, matrix)).select(
        F.col("j").alias("cell_id"), F.col("i").alias("gene_id"), "x"
    )
    return Bundle(cells=cells, genes=genes, counts=counts)


def write_mtx(bundle: Bundle, folder: str) -> None:
    """Write the triple as text folders; ids must be 1-based list positions."""
    banner = F.concat_ws(
        "\n",
        F.lit("%%MatrixMarket matrix coordinate real general"),
        F.lit("%"),
        F.concat_ws(
            " ",
            bundle.genes.agg(F.count("*")).scalar().cast("string"),
            bundle.cells.agg(F.count("*")).scalar().cast("string"),
            F.count("*").cast("string"),
        ),
    )
    matrix = os.path.join(folder, "matrix.mtx")
    bundle.counts.agg(banner.alias("value")).write.mode("overwrite").text(matrix)
    line = F.concat_ws(" ", F.col("gene_id").cast("string"), F.col("cell_id").cast("string"), F.col("x").cast("string"))
    bundle.counts.select(line.alias("value")).write.mode("append").text(matrix)
    bundle.cells.orderBy("cell_id").select(F.col("barcode").alias("value")).write.mode("overwrite").text(os.path.join(folder, "barcodes.tsv"))
    bundle.genes.orderBy("gene_id").select(F.concat_ws("\t", F.col("gene_id").cast("string"), "gene_name").alias("value")).write.mode(
        "overwrite"
    ).text(os.path.join(folder, "genes.tsv"))
