"""Stored results: metrics, neighbour graphs, exported sheets."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import read_if_exists

METRICS = "model string, split string, metric string, value double"


def save_metrics(metrics: DataFrame, path: str) -> None:
    """Append ``(model, split, metric, value)``, laid out by model and split.

    The model name is part of the layout and is never lost.
    """
    metrics.select("model", "split", "metric", "value").write.mode("append").partitionBy("model", "split").parquet(path)


def load_metrics(spark: SparkSession, path: str, model: str | None = None, split: str | None = None) -> DataFrame:
    """Stored metrics by exact keys (partition pruning)."""
    df = spark.read.schema(METRICS).parquet(path)
    if model is not None:
        df = df.where(F.col("model") == model)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df.select("model", "split", "metric", "value")


def missing_results(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """Requested (model, split, metric) keys without a stored value."""
    return requested.join(stored.select("model", "split", "metric"), ["model", "split", "metric"], "left_anti")


def reuse_or_compute(
    spark: SparkSession, path: str, requested: DataFrame, compute: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Stored values plus freshly computed missing ones, which are stored too."""
    stored = read_if_exists(spark, path, METRICS)
    todo = requested if stored is None else missing_results(requested, stored)
    if not todo.isEmpty():
        save_metrics(compute(todo), path)
    return load_metrics(spark, path).join(requested, ["model", "split", "metric"], "left_semi")


def graph_path(root: str, dataset: str, n_cells: int, reduction: str | None, components: int | None, k: int, metric: str = "l2", nprobe: int | None = None, seed: int = 0) -> str:
    """Folder of a stored graph, derived from everything that determines it."""
    return os.path.join(root, f"graph_{dataset}_{n_cells}_{reduction or 'none'}_{components or 0}_knn{k}_{metric}_probe{nprobe or 'all'}_seed{seed}")


def cached_graph(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the stored edge table, or build, store and read it."""
    found = read_if_exists(spark, path)
    if found is None:
        build().write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path)
    return found


def export_sheets(sheets: dict[str, DataFrame], path: str, fmt: str = "csv") -> None:
    """One folder per sheet."""
    for name, df in sheets.items():
        writer = df.write.mode("overwrite")
        target = os.path.join(path, name)
        writer.option("header", True).csv(target) if fmt == "csv" else writer.format(fmt).save(target)
