"""Event-time windows: the same functions serve batch frames and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(events: DataFrame, late: str | None = None) -> DataFrame:
    """``events`` with a zoned ``ts``, and a watermark if given (needed on streams)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late) if late else timed


def tumbling(events: DataFrame, length: str, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by window."""
    g = with_event_time(events, late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, start, n) of each run of events less than ``gap`` apart."""
    g = with_event_time(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def enrich_late(events: DataFrame, other: DataFrame, late: str, within: str) -> DataFrame:
    """Stream-stream inner join of a user's events with another stream's at most ``within`` later; both watermarked, so state is bounded."""
    a = with_event_time(events, late).select(F.col("user_id").alias("ua"), F.col("ts").alias("ta"), F.col("event_id").alias("ea"))
    b = with_event_time(other, late).select(F.col("user_id").alias("ub"), F.col("ts").alias("tb"), F.col("event_id").alias("eb"))
    return a.join(b, F.expr(f"ua = ub AND tb >= ta AND tb <= ta + INTERVAL {within}"))
