"""Writes: each appends versions to a change log; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.reads import LIVE, TOMBSTONE


def append(log: DataFrame, batch: DataFrame) -> DataFrame:
    """The log with a batch of operations (pos from 1, op 'put' or 'delete', user_key, value) after its last version.

    A null or missing value is an empty one; the batch's places become sequence numbers, so no task numbers all rows.
    """
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_last"))  # one row
    gone = F.col("op") == "delete"
    rows = batch.crossJoin(F.broadcast(last)).select(
        "user_key",
        (F.col("_last") + F.col("pos")).cast("long").alias("seq"),
        F.when(gone, TOMBSTONE).otherwise(LIVE).alias("vtype"),
        F.when(gone, "").otherwise(F.coalesce("value", F.lit(""))).alias("value"),
    )
    return log.select("user_key", "seq", "vtype", "value").unionByName(rows)


def put(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Append (pos, user_key, value)."""
    return append(log, rows.withColumn("op", F.lit("put")))


def delete(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Append a tombstone for each of (pos, user_key)."""
    return append(log, keys.withColumn("op", F.lit("delete")).withColumn("value", F.lit("")))
