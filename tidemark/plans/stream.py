"""Streaming queries; each is run until its source is read and equals a batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.base import ORACLES, QUERIES
from tidemark.plans import alerts as _alerts  # noqa: F401  (its SQL is used below)
from tidemark.sources.staging import shared_path
from tidemark.streaming.alerts import ROCKS, STATE_STORE, failure_windows, suppress_repeats
from tidemark.streaming.ingest import merge_stream, once_in_overlap, stream_table, to_table


def stream_alert_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """X11 as a stateful stream."""
    return to_table(suppress_repeats(stream_table(spark, folder, "events")))


def stream_latest_wins(spark: SparkSession, folder: str) -> DataFrame:
    """S6, X8, X9 as micro-batches: the latest row of each number."""
    state, _ = merge_stream(stream_table(spark, folder, "events"), "user_id", ["ts", "event_id", "event_type"], ["ts", "event_id"])
    return state


def stream_failed_windows(spark: SparkSession, folder: str) -> DataFrame:
    """A12 as a stateful stream with timers: each window's final count."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        rows = to_table(failure_windows(stream_table(spark, folder, "events").where("event_type = 'error'")), "update")
    finally:
        spark.conf.set(STATE_STORE, before)
    return rows.groupBy("user_id", "opened_micros").agg(F.max("n").alias("n")).withColumn("locked", F.col("n") >= 5)


def stream_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Two polls that overlap by a day, the second one after a restart; each row once, then the latest of each number."""
    events = spark.read.parquet(f"{folder}/events.parquet").select("user_id", "event_id", "ts", "event_type")
    path = shared_path(spark, "polls")
    cursor = events.agg(F.date_trunc("day", F.percentile_approx("ts", 0.6).cast("timestamp_ntz")).alias("c")).first()[0]
    polled = (F.col("ts") < F.lit(cursor), F.col("ts") >= F.lit(cursor) - F.expr("interval 1 day"))
    rows, state = None, None
    for k, part in enumerate(polled):
        events.where(part).write.parquet(f"{path}/in/poll={k}")
        stream = spark.readStream.schema(events.schema).parquet(f"{path}/in/poll=*")
        rows = to_table(once_in_overlap(stream, ["event_id"], "ts"), path=f"{path}/rows")
        state, _ = merge_stream(stream, "user_id", ["ts", "event_id", "event_type"], ["ts", "event_id"], f"{path}/state")
    counts = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return state.join(counts, "user_id").select("user_id", "n", "ts", "event_id", "event_type")


def stream_hourly_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Event-time windows with a watermark over the event stream."""
    events = stream_table(spark, folder, "events").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "40 days")
    counts = events.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")
    return to_table(counts, "complete")


QUERIES |= {"stream_alert_dedup": stream_alert_dedup, "stream_latest_wins": stream_latest_wins, "stream_daily_counts": stream_hourly_counts, "stream_failed_windows": stream_failed_windows, "stream_overlap": stream_overlap}
ORACLES |= {
    "stream_alert_dedup": ORACLES["alert_dedup_24h"],
    "stream_latest_wins": "SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "stream_failed_windows": ORACLES["failed_login_window"],
    "stream_overlap": "SELECT user_id, count(*) AS n, max(ts) AS ts, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
    "stream_daily_counts": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
