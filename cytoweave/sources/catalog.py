"""Annotated matrices as parquet folders, and the label dictionary."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bundle import SCHEMAS, Bundle, validate
from ..operators.rank import label_index


@dataclass(frozen=True)
class Dataset:
    """A named dataset: folder below the catalog root, label columns, held-out studies."""

    name: str
    label: str = "cell_type"
    study: str = "study"
    held_out: tuple[str, ...] = ()


# fixed values: held-out studies of the known datasets
DATASETS = {
    "immune": Dataset("immune", held_out=("Freytag", "Villani")),
    "hlca": Dataset("hlca", held_out=("Teichmann_Meyer_2019", "Lafyatis_Rojas_2019")),
    "pancreas": Dataset("pancreas", held_out=("celseq", "celseq2")),
    "pbmc3k": Dataset("pbmc3k"),
}


def read_if_exists(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The parquet folder, or ``None`` when there is none."""
    try:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_annotated(spark: SparkSession, path: str) -> Bundle:
    """Load ``cells`` with whichever of ``genes``, ``counts``, ``embeddings`` exist."""
    parts = {name: read_if_exists(spark, os.path.join(path, name)) for name in SCHEMAS}
    if parts["cells"] is None:
        raise FileNotFoundError(f"no cells table below {path}")
    bundle = Bundle(**parts)
    validate(bundle)
    return bundle


def write_annotated(bundle: Bundle, path: str, partitions: int | None = None) -> None:
    """Write every table; counts are clustered by cell, so one cell is in one file."""
    validate(bundle)
    for name, df in bundle.parts().items():
        if name == "counts":
            spread = df.repartition(partitions, "cell_id") if partitions else df.repartition("cell_id")
            df = spread.sortWithinPartitions("cell_id", "gene_id")
        df.write.mode("overwrite").parquet(os.path.join(path, name))


def save_bucketed(counts: DataFrame, table: str, buckets: int) -> None:
    """Counts as a bucketed table: joins and groupings on ``cell_id`` need no shuffle."""
    counts.write.mode("overwrite").bucketBy(buckets, "cell_id").sortBy("cell_id").saveAsTable(table)


def fit_label_dictionary(df: DataFrame, column: str = "cell_type") -> DataFrame:
    """``(label, label_id)``: index over the sorted distinct labels."""
    labels = df.select(F.col(column).alias("label")).where(F.col(column).isNotNull()).distinct()
    return label_index(labels, "label")


def save_label_dictionary(dictionary: DataFrame, path: str) -> None:
    dictionary.write.mode("overwrite").parquet(path)


def load_label_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("label string, label_id bigint").parquet(path)


def encode_labels(df: DataFrame, dictionary: DataFrame, column: str = "cell_type") -> DataFrame:
    """Add ``label_id``; labels missing from the dictionary get NULL."""
    return df.join(dictionary.withColumnRenamed("label", column), column, "left")
