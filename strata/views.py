"""Canonical views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The append-only change log (user_key, seq, vtype, value, ts) that ``events`` stands for; vtype 2 is a tombstone."""
    gone = F.col("event_type") == "error"
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("user_key"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(gone, 2).otherwise(1).alias("vtype"),
        F.when(gone, "").otherwise(F.col("props")).alias("value"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
