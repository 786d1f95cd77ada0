"""Streaming counterparts: token use by window with late data, and first-delivery deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_windows(events: DataFrame, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, kind, n, tokens) of a stream (ts, kind, tokens), closed once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "kind").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).select(F.col("window.start").alias("start"), "kind", "n", "tokens")


def first_deliveries(records: DataFrame, late: str = "7 days") -> DataFrame:
    """A stream without repeated (file_path, line_no), remembered as long as deliveries may come late."""
    return records.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["file_path", "line_no"])
