"""Streaming forms, run over all available input; results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import streams
from . import tables as t
from .prototype_queries import WITH_ASSIGNED
from .registry import query, rounded


def _finish(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def _stream(spark, sf, name):
    return streams.parquet_stream(spark, sf, f"{name}.parquet", t.table(spark, sf, name).schema)


@query("stream_scores", "L1", f"{WITH_ASSIGNED} SELECT cell_id, proto_id, round(d, 6) AS score FROM assigned")
def stream_scores(spark, sf):
    cells = _stream(spark, sf, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("vec"))
    out = scratch_path(spark, "scored")
    scored = streams.score_stream(cells, t.protos(spark, sf)).select("cell_id", "proto_id", "score")
    _finish(streams.append_to(scored, out, scratch_path(spark, "checkpoint")))
    return rounded(spark.read.schema(scored.schema).parquet(out))


@query(
    "stream_epoch_averages",
    "L2",
    """SELECT strftime(ts, '%Y-%m-%d') AS epoch, round(sum(value * (user_id + 1)) / sum(user_id + 1), 6) AS avg FROM events GROUP BY 1""",
)
def stream_epoch_averages(spark, sf):
    # the stored time has no zone: read it as UTC whatever the session zone is
    zone = F.current_timezone()
    utc = F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)
    events = _stream(spark, sf, "events").select(utc.alias("ts"), "value", (F.col("user_id") + 1).alias("n"))
    out = scratch_path(spark, "epochs")
    _finish(streams.keep_updates(streams.epoch_averages(events, "ts", "value", "n"), out, scratch_path(spark, "checkpoint")))
    day = F.date_format(F.to_utc_timestamp("epoch", zone), "yyyy-MM-dd")
    return rounded(streams.latest_updates(spark, out, "epoch").select(day.alias("epoch"), "avg"))


@query(
    "stream_bank",
    "L3",
    """SELECT (day(ts) % 2)::INT AS bank_no, user_id AS cell_id, arg_max(value, event_id) AS v0, max(event_id) AS step FROM events GROUP BY 1, 2""",
)
def stream_bank(spark, sf):
    rows = _stream(spark, sf, "events").select(
        (F.dayofmonth("ts") % 2).alias("bank_no"),
        F.col("user_id").alias("cell_id"),
        F.array("value", F.col("event_id").cast("double")).alias("vec"),
        F.col("event_id").alias("step"),
    )
    out = scratch_path(spark, "bank")
    _finish(streams.maintain_bank(rows, out, scratch_path(spark, "checkpoint")))
    return streams.read_bank(spark, out).select("bank_no", "cell_id", F.col("vec")[0].alias("v0"), "step")
