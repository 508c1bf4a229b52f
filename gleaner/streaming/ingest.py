"""Micro-batch ingest, windowed counts with watermarks and stateful de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.versions import append_new
from gleaner.session import exists, shared_dir
from gleaner.sources.exports import BATCH, split_batches


def file_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A stream of the parquet files named so in a folder; one file a micro-batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


def run_once(stream: DataFrame, sink, mode: str, name: str, run: str) -> None:
    """Everything available, then stop; the checkpoint lies in the shared folder, so a restarted run goes on where it was."""
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{shared_dir(stream.sparkSession)}/gleaner/stream-{name}-{run}").trigger(availableNow=True).start()
    q.awaitTermination()


BUCKETS = 64


def stored(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`keep_first_sink` wrote."""
    return spark.read.parquet(path).drop("_bucket")


def keep_first_sink(path: str, key: str):
    """Idempotent append: a batch adds only keys not stored yet, so a repeated batch adds nothing.

    The table is laid out by a hash of the key; a batch reads only the key column of the buckets it touches.
    """

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int"))
        if exists(spark, path):
            touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most BUCKETS numbers
            old = spark.read.parquet(path).where(F.col("_bucket").isin(touched)).select(key)
        else:
            old = new.select(key).limit(0)
        append_new(old, new, key).write.mode("append").partitionBy("_bucket").parquet(path)

    return sink


def overwrite_sink(path: str):
    return lambda batch, _: batch.write.mode("overwrite").parquet(path)


def append_sink(path: str):
    return lambda batch, _: batch.write.mode("append").parquet(path)


def window_counts(events: DataFrame, size: str, late: str) -> DataFrame:
    """Counts per window and type; rows later than ``late`` behind the newest are dropped with the window's state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def distinct_events(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """First sighting of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def journal_stream(spark: SparkSession, folder: str, items_path: str, rejects_path: str, run: str) -> None:
    """Journal batches into an append-only table keyed by row hash; bad files go to the rejects and stop nothing."""
    raw = spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("file"), "value", F.from_json("value", BATCH).alias("b"))

    def sink(batch: DataFrame, no: int) -> None:
        rows, bad = split_batches(batch)
        keep_first_sink(items_path, "row_id")(rows.withColumn("row_id", F.sha2(F.concat_ws("\u0000", "corpus_id", "row"), 256)), no)
        bad.write.mode("append").parquet(rejects_path)

    run_once(raw, sink, "append", "journal", run)
