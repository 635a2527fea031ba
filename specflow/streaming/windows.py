"""Event-time windows and deduplication on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(stream: DataFrame, ts: str, tolerance: str) -> DataFrame:
    """Watermark after a cast: zone-free timestamps cannot carry one."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, tolerance)


def windowed_counts(stream: DataFrame, ts: str, duration: str, slide: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Stream after ``event_time``. Events later than the tolerance are dropped by the state store."""
    placed = stream.withColumn("w", F.window(ts, duration, slide or duration))
    grouped = placed.groupBy("w", *keys).agg(F.count(F.lit(1)).alias("event_count"), F.max(ts).alias("last_event_at"))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "event_count", "last_event_at")


def session_counts(stream: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    grouped = stream.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("event_count"))
    return grouped.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "event_count")


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """First arrival per key within the watermark's tolerance."""
    return stream.dropDuplicatesWithinWatermark(keys)
