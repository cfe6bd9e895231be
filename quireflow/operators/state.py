"""Chapter state: an append-only log of transitions folded to one row per chapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions.text import carryover, short_hash

STATUSES = "pending in_progress done failed source_ready dropped".split()
STRATEGIES = "translate source_only nav_generated drop_explicit".split()


def fold(events: DataFrame) -> DataFrame:
    """(book_id, chapter_id, seq, event, text, error, reason) -> one row per chapter.

    Events: pending, done, failed, source_ready, dropped. The last one gives the status;
    retries are the failures since the last event of another kind. Only dropping changes
    a strategy; done and source_ready set one where there is none. Two aggregations with
    map-side combine, so a chapter with a long log is no hot task.
    """
    key = ["book_id", "chapter_id"]
    failed = F.col("event") == "failed"
    last = F.max_by(F.struct("event", "text", "error", "reason"), "seq").alias("last")
    default = F.when(F.col("event") == "done", "translate").when(F.col("event") == "source_ready", "source_only")
    ends = events.groupBy(*key).agg(last, F.max(F.when(~failed, F.col("seq"))).alias("reset"), F.max(F.when(F.col("event") == "dropped", 1).otherwise(0)).alias("dropped"), F.min_by(default, F.when(default.isNotNull(), F.col("seq"))).alias("strategy"))
    tries = events.where(failed).join(ends.select(*key, "reset"), key).where("reset is null or seq > reset").groupBy(*key).agg(F.count("*").cast("int").alias("retry_count"))
    status = F.col("last.event")
    return ends.join(tries, key, "left").select(
        *key,
        F.when(F.col("dropped") == 1, "drop_explicit").otherwise(F.col("strategy")).alias("output_strategy"),
        status.alias("status"),
        F.when(status == "done", short_hash(F.col("last.text"))).alias("translation_hash"),
        F.when(status == "done", carryover(F.col("last.text"))).alias("carryover"),
        F.coalesce("retry_count", F.lit(0)).alias("retry_count"),
        F.when(status == "failed", F.col("last.error")).alias("error"),
        F.when(status == "dropped", F.col("last.reason")).alias("reason"),
    )


def carryover_for(chapters: DataFrame) -> DataFrame:
    """Adds previous_carryover: that of the nearest done chapter before, by id as text; empty if it has none."""
    before = Window.partitionBy("book_id").orderBy("chapter_id").rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("status") == "done", F.coalesce("carryover", F.lit("")))
    return chapters.withColumn("previous_carryover", F.coalesce(F.last(known, ignorenulls=True).over(before), F.lit("")))


def invalid(chapters: DataFrame) -> DataFrame:
    """(book_id, chapter_id, problem) of states that break the schema."""
    problem = (
        F.when(~F.coalesce(F.col("status").isin(STATUSES), F.lit(False)), "status")
        .when(~F.coalesce(F.col("output_strategy").isin(STRATEGIES), F.lit(True)), "strategy")
        .when((F.col("output_strategy") == "drop_explicit") & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "reason")
    )
    return chapters.select("book_id", "chapter_id", problem.alias("problem")).where("problem is not null")


def to_run(chapters: DataFrame) -> DataFrame:
    """What a resumed run takes up: pending chapters, and those that failed once."""
    return chapters.where("status = 'pending' or (status = 'failed' and retry_count < 2)")
