"""Batch-wise work as Structured Streaming jobs.

Every job writes to the shared folder and can be restarted from its checkpoint;
sinks are keyed by the micro-batch number, so a repeated batch changes nothing.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.assign import bank_latest
from ..operators.proto import nearest_prototype


def parquet_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """What matches ``pattern`` in ``folder``, files or folders of part files, as a stream with a fixed schema."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # braces make a plain name a pattern too: a stream reads a single file only through one
    return reader.parquet(os.path.join(folder, f"{{{pattern}}}"))


def score_stream(cells: DataFrame, protos: DataFrame, metric: str = "l2") -> DataFrame:
    """Arriving cells against fixed prototypes: map only, no state, append mode."""
    return nearest_prototype(cells, protos, metric)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to parquet until the available input is used up."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def epoch_averages(events: DataFrame, time: str, value: str, weight: str, lateness: str | None = None) -> DataFrame:
    """sum(v * n) / sum(n) per day.

    No row is ever too late by default, at the price of one state row per day.  ``lateness`` sets a
    watermark that bounds the state and drops what comes later.
    """
    events = events if lateness is None else events.withWatermark(time, lateness)
    windowed = events.groupBy(F.window(time, "1 day"))
    return windowed.agg(
        F.sum(F.col(value) * F.col(weight)).alias("s"), F.sum(F.col(weight).cast("double")).alias("w")
    ).select(F.col("window.start").alias("epoch"), "s", "w", (F.col("s") / F.col("w")).alias("avg"))


def _per_batch(stream: DataFrame, path: str, checkpoint: str, shape) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        shape(batch).write.mode("overwrite").parquet(os.path.join(path, f"batch_no={number}"))

    return (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )


def keep_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store each micro-batch's changed rows under its number."""
    return _per_batch(stream, path, checkpoint, lambda b: b)


def latest_updates(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Newest version of every key of an update stream."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (key, "batch_no")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), "batch_no").alias("_v")).select(key, "_v.*")


def maintain_bank(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Memory bank as deltas: a micro-batch adds only its own latest rows.

    Nothing old is rewritten per batch; :func:`read_bank` folds the deltas and
    :func:`compact_bank` replaces them by one table when they get many.
    """
    return _per_batch(stream, path, checkpoint, bank_latest)


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """Latest vector per (bank, cell) over all deltas."""
    return bank_latest(spark.read.parquet(path).drop("batch_no"))


def compact_bank(spark: SparkSession, path: str, target: str) -> None:
    """Fold all deltas into a new folder of the same form."""
    read_bank(spark, path).write.mode("overwrite").parquet(os.path.join(target, "batch_no=0"))
