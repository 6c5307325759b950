"""Latest state of upload jobs from their stage events, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def job_state(events: DataFrame) -> DataFrame:
    """Newest stage per job with its progress value; the error text is kept while the newest stage is `failed`.

    The state per job is one small struct, so the same aggregation runs as a streaming query in update or complete mode.
    """
    error = F.col("error") if "error" in events.columns else F.lit(None).cast("string")
    row = F.struct("stage", "value", F.when(F.col("stage") == "failed", error).alias("error"), "ts")
    d = events.groupBy("job_id").agg(F.max_by(row, F.struct("ts", "seq")).alias("s"), F.count(F.lit(1)).alias("n_events"))
    return d.select("job_id", "s.*", "n_events")


def without_retries(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Stage events with repeated deliveries of (job_id, seq) dropped; state is kept for the given delay only."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id", "seq"])
