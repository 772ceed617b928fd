"""Throughput, latency and health over windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str, slide: str | None = None, seconds: int = 60) -> DataFrame:
    """Per window: events, events a second, and exact 50th and 99th percentiles of ``value``."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        events.groupBy(window.alias("w"))
        .agg(F.count("*").alias("n_events"), F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.99).alias("p99"))
        .select(F.unix_timestamp("w.start").alias("window_start"), "n_events", F.round(F.col("n_events") / seconds, 6).alias("qps"), F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"))
    )


def sliding_counts(events: DataFrame, width_minutes: int, slide_minutes: int) -> DataFrame:
    """Events and mean rate in windows that overlap."""
    window = F.window("ts", f"{width_minutes} minutes", f"{slide_minutes} minutes")
    return events.groupBy(window.alias("w")).agg(F.count("*").alias("n_events")).select(F.unix_timestamp("w.start").alias("window_start"), "n_events", F.round(F.col("n_events") / (60 * width_minutes), 6).alias("avg_qps"))


def health(events: DataFrame, width: str, degraded: float, down: float) -> DataFrame:
    """Per window ok, degraded or down by the share of errors."""
    share = F.avg((F.col("event_type") == "error").cast("double"))
    rated = events.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n_events"), share.alias("share"))
    status = F.when(F.col("share") >= down, "down").when(F.col("share") >= degraded, "degraded").otherwise("ok")
    return rated.select(F.unix_timestamp("w.start").alias("window_start"), "n_events", F.round("share", 6).alias("error_share"), status.alias("status"))


def storage(log: DataFrame, live: DataFrame) -> DataFrame:
    """Bytes of all versions and of the live ones, and the space amplification."""
    size = F.sum(F.octet_length("user_key") + F.octet_length("value")).cast("long")
    both = log.agg(size.alias("all_bytes")).crossJoin(live.agg(size.alias("live_bytes")))
    return both.select("all_bytes", "live_bytes", F.round(F.col("all_bytes") / F.col("live_bytes"), 6).alias("space_amplification"))


def inflight(events: DataFrame, limit: int) -> DataFrame:
    """Running connections from +1/-1 steps (pool, at, step), and whether each is within the limit."""
    from pyspark.sql import Window

    running = F.sum("step").over(Window.partitionBy("pool").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("inflight", running).withColumn("admitted", F.col("inflight") <= limit)
