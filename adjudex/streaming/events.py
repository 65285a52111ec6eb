"""Streams of events: windowed counts and first-seen answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str = "ts", size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by window and type; on a stream, windows close `late` behind the newest event."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))  # a watermark needs an instant
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_answers(attempts: DataFrame, key: str, time: str = "ts", late: str = "1 day") -> DataFrame:
    """The first attempt of each request within the watermark; repeats of a stream go."""
    return attempts.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if attempts.isStreaming else attempts.dropDuplicates([key])
