"""Event windows that run on batches and on streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_counts(events: DataFrame, length: str = "20 minutes", step: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(event_type, started, n) of sliding windows over ts. On a stream, rows later than
    ``late`` are dropped and a window's state goes when it can't change any more."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").alias("started"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, started, n) of sessions: rows less than gap apart."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("started"), "n")
