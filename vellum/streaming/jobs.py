"""Streaming jobs: windows over events, the index kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.operators import search


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums of each event type and window; ``late`` is the watermark of a stream."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("sum_value")).select(
        F.col("w.start").alias("window_start"), "event_type", "n_events", "sum_value"
    )


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(F.col("w.start").alias("window_start"), "n_events")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Runs of a user's events with no pause longer than ``gap``."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("sum_value")).select(
        "user_id", F.col("w.start").alias("session_start"), "n_events", "sum_value"
    )


def follow_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Note files as they come: ``path, content``."""
    rows = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def keep_index(notes: DataFrame, index: str, checkpoint: str, on_batch: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Adds chunks of new and changed notes to the index, a part a batch, as :func:`vellum.operators.search.current` reads it.

    A batch that is written again replaces its part, or is a newer one after a restart: readers
    take a note's newest. Removed notes are found by comparing with a listing
    (:func:`vellum.operators.search.index_diff`).
    """
    first = search.next_part(notes.sparkSession, index)

    def write(batch: DataFrame, number: int) -> None:
        parts = search.chunks(batch.dropDuplicates(["path", "content"]))
        search.write_part(parts, index, first + number)
        if on_batch:
            on_batch(parts)

    return notes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
