"""Chapter state over a stream of events (an addition: nothing here is needed in batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_status(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(book_id, chapter_id, status, n_failed) so far, from a stream of (book_id, chapter_id, seq, event, ts)."""
    seen = events.withWatermark("ts", delay).groupBy("book_id", "chapter_id")
    return seen.agg(F.max_by("event", "seq").alias("status"), F.count_if(F.col("event") == "failed").alias("n_failed"))


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(start, event, n) per window; rows later than ``delay`` are dropped."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event", "n")
