"""Streaming twins: change-log ingestion to the latest state, windowed metrics, rate limits and expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strata.operators.reads import latest


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet change-log files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def upsert_latest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest version of every key under ``target``: each micro-batch writes a whole new generation.

    A generation is named by its batch, so a batch that runs again after a failure gives the same one.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch.select("user_key", "seq", "vtype", "value"))
        if number:
            new = latest(spark.read.parquet(f"{target}/generation={number - 1}").drop("generation").unionByName(new))
        new.write.mode("overwrite").parquet(f"{target}/generation={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, width: str, lateness: str, slide: str | None = None) -> DataFrame:
    """Events and the sum of their values a window of event time; rows later than ``lateness`` are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(window.alias("w")).agg(F.count("*").alias("n_events"), F.sum("value").alias("total")).select(F.unix_timestamp("w.start").alias("window_start"), "n_events", "total")


def token_buckets(stream: DataFrame, capacity: int, micros_per_token: int) -> DataFrame:
    """The batch token bucket as a stateful stream over (user_id, at, event_id): credit and time are a key's state."""
    full = capacity * micros_per_token

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        credit, last = state.get if state.exists else (full, None)
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        allowed = []
        for at in rows["at"].tolist():
            credit = min(full, credit + max(0, at - (at if last is None else last)))
            last = at
            ok = credit >= micros_per_token
            credit -= micros_per_token * ok
            allowed.append(ok)
        state.update((credit, last))
        yield pd.DataFrame({"event_id": rows["event_id"], "allowed": allowed})

    return stream.groupBy("user_id").applyInPandasWithState(step, "event_id long, allowed boolean", "credit long, last long", "append", GroupStateTimeout.NoTimeout)


def expiring(stream: DataFrame, ttl: str) -> DataFrame:
    """Distinct tokens of a stream, each remembered for ``ttl`` of event time."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["jti"])
