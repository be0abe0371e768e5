"""Structured Streaming forms of the running profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_heatmap(ledger: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Transactions and amount by event-time window and purpose; rows behind the watermark are dropped."""
    return (ledger.withWatermark("txn_time", watermark).groupBy(F.window("txn_time", window), "purpose")
            .agg(F.count(F.lit(1)).alias("volume"), F.sum("amount").alias("total_amount"))
            .select(F.col("window.start").alias("window_start"), "purpose", "volume", "total_amount"))


def stream_source_activity(ledger: DataFrame, watermark: str = "10 minutes", window: str = "1 day", slide: str | None = None) -> DataFrame:
    """Activity of each source by window, with a sketch of its distinct destinations."""
    w = F.window("txn_time", window, slide) if slide else F.window("txn_time", window)
    return (ledger.withWatermark("txn_time", watermark).groupBy(w, "source_id")
            .agg(F.count(F.lit(1)).alias("txns"), F.sum("amount").alias("total_amount"), F.approx_count_distinct("destination_id").alias("destinations"))
            .select(F.col("window.start").alias("window_start"), "source_id", "txns", "total_amount", "destinations"))
