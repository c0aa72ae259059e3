"""Token ids in ORC files that many readers can share.

Layout of one dataset: ORC files in ascending ``doc_id`` order, each one part of the range.
Ids are integer columns, so ORC stores them run-length encoded; every stripe has row indexes,
and ``doc_id`` has Bloom filters.  A reader that asks for some documents skips files, stripes
and row groups by these; a full reader takes stripes in parallel.  A small table ``parts``
beside the files says how many ids come before each part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import list_array, map_text, record_batch
from .tokens import encoder

END_ID = 1
STRIPE_BYTES = 64 << 20
ROW_INDEX_STRIDE = 10_000
BLOOM_FPP = 0.01
ROWS = "part int, doc_id bigint, part_start bigint, n_tokens bigint, ids array<int>"


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Encode ``docs(doc_id, text)`` and write the ids, ``end_id`` after each document.

    Texts are dealt out by ranges of ``doc_id`` before they are encoded (text is smaller than
    ids).  A null text is empty; a null id sorts first; rows with the same id follow each other
    in text order.
    """

    def encode(batch: pa.RecordBatch):
        state = _part_state()
        ids, sizes = encoder(tokenizer).encode(batch.column(1))
        ids = np.insert(ids, np.cumsum(sizes), end_id)
        sizes = sizes + 1
        starts = state["used"] + np.cumsum(sizes) - sizes
        state["used"] += int(sizes.sum())
        part = np.full(len(sizes), state["part"], dtype=np.int32)
        yield record_batch(ROWS, [part, batch.column(0), starts, sizes, list_array(ids, sizes, pa.int32())])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        map_text(ordered, "text", encode, ROWS)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(BLOOM_FPP))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("compression", "zstd")
        .orc(f"{path}/ids")
    )
    spark = docs.sparkSession
    totals = spark.read.schema(ROWS).orc(f"{path}/ids").groupBy("part").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    # one row per file: the running sum over it is small whatever the number of documents
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    totals.withColumn("start", before).coalesce(1).write.orc(f"{path}/parts")


_state: dict[tuple, dict] = {}


def _part_state() -> dict:
    """Counters of the running task; the first call of another task (or attempt) starts anew."""
    context = TaskContext.get()
    key = (context.taskAttemptId(),)
    if key not in _state:
        _state.clear()
        _state[key] = {"part": context.partitionId(), "used": 0}
    return _state[key]


def parts(spark: SparkSession, path: str) -> DataFrame:
    """``part, first_doc, last_doc, n_docs, n_tokens, start``: one row per file."""
    return spark.read.orc(f"{path}/parts")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of the whole dataset; filters on ``doc_id`` reach the ORC reader."""
    starts = parts(spark, path).select("part", "start")
    rows = spark.read.schema(ROWS).orc(f"{path}/ids").join(F.broadcast(starts), "part")  # one row per file
    return rows.select("doc_id", (F.col("start") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The documents asked for: row groups without them are skipped by min/max and Bloom filters."""
    return read(spark, path).where(F.col("doc_id").isin([int(i) for i in doc_ids]))
