"""Streams of changed files: the snapshot difference and extraction on every batch.

An extension: the same plans that a batch run uses, driven by Structured
Streaming's file source with a checkpoint, so each file is taken once and a
restart goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import diff


def stream_files(spark: SparkSession, folder: str, schema: str, per_batch: int = 1000) -> DataFrame:
    """Parquet files of captured sources (path, content_hash, ...) as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def run_incremental(files: DataFrame, stored: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str, key: str = "path", hash_: str = "content_hash", once: bool = True):
    """On every batch, hands ``apply`` the files that are new or changed against ``stored()``.

    Of several captures of a path in one batch the last by ``seq`` counts.
    """

    def batch(df: DataFrame, number: int) -> None:
        others = [c for c in df.columns if c != key]
        newest = df.groupBy(key).agg(F.max_by(F.struct(*others), "seq").alias("_r")).select(key, "_r.*")
        # a batch holds some files only: what it lacks isn't missing
        wanted = diff.plan(newest, stored(), key, hash_).filter("action = 'process'")
        apply(newest.join(wanted.select(F.col("path").alias(key)), key, "left_semi"), number)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def event_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per kind and tumbling window; rows later than the watermark are left out, and state is dropped behind it."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
