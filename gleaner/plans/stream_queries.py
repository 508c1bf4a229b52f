"""Streaming queries, run to the end of what is there; each has the batch result as its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import shared_dir
from gleaner.streaming import ingest


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.file_stream(spark, sf, "events.parquet", spark.read.parquet(f"{sf}/events.parquet").schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _out(spark: SparkSession) -> tuple[str, str]:
    run = uuid.uuid4().hex
    return f"{shared_dir(spark)}/gleaner/stream-out-{run}", run


def stream_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the windows the watermark has closed; their state is gone, later rows are dropped."""
    path, run = _out(spark)
    ingest.run_once(ingest.window_counts(_events(spark, sf), "1 hour", "2 hours"), ingest.append_sink(path), "append", "windows", run)
    return spark.read.parquet(path)


def stream_distinct_events(spark: SparkSession, sf: str) -> DataFrame:
    path, run = _out(spark)
    ingest.run_once(ingest.distinct_events(_events(spark, sf), ["event_id"], "1 day"), ingest.append_sink(path), "append", "distinct", run)
    return spark.read.parquet(path).select("event_id", "user_id", "event_type")


def stream_keep_first_users(spark: SparkSession, sf: str) -> DataFrame:
    path, run = _out(spark)
    ingest.run_once(_events(spark, sf).select("user_id"), ingest.keep_first_sink(path, "user_id"), "append", "users", run)
    return ingest.stored(spark, path)


QUERIES = {"stream_window_counts": stream_window_counts, "stream_distinct_events": stream_distinct_events, "stream_keep_first_users": stream_keep_first_users}
ORACLES = {
    "stream_window_counts": "SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMPTZ) AS start, event_type, count(*) AS n FROM events WHERE time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '2 hours' FROM events) GROUP BY start, event_type",
    "stream_distinct_events": "SELECT DISTINCT event_id, user_id, event_type FROM events",
    "stream_keep_first_users": "SELECT DISTINCT user_id FROM events",
}
