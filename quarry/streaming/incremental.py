"""Structured Streaming: a folder of new rows kept merged into a table, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.sinks import merge_into


def merge_stream(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: str) -> StreamingQuery:
    """Upserts every micro-batch; the merge is idempotent, so a repeated batch changes nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: merge_into(batch, path, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, kind: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and kind; rows later than the watermark are left out."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")


def sessions(events: DataFrame, user: str, time: str, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events with no pause of ``gap``: user, start, end, events. Batch or stream."""
    grouped = events.groupBy(F.session_window(time, gap).alias("s"), user).agg(F.count("*").alias("events"))
    return grouped.select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")
