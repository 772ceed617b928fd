"""Operators with state that folds over the events of a key in order."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def token_bucket(events: DataFrame, capacity: int, micros_per_token: int, key: str = "user_id", at: str = "at", order: str = "event_id") -> DataFrame:
    """Add ``allowed``: a bucket a key, filled to its capacity and by one token each so many microseconds.

    State is kept in whole microseconds of credit, so no rounding decides a case.  Rows stream through in order, and
    only the last row's state is held, so a frequent key needs no memory.
    """
    full = capacity * micros_per_token

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, credit, last = None, full, 0
        for frame in frames:
            out = []
            for k, t in zip(frame[key].tolist(), frame[at].tolist(), strict=True):
                if k != now:
                    now, credit, last = k, full, t
                credit = min(full, credit + max(0, t - last))
                last = t
                ok = credit >= micros_per_token
                credit -= micros_per_token * ok
                out.append(ok)
            yield frame.assign(allowed=out)

    rows = events.select(key, at, order).repartition(key).sortWithinPartitions(key, at, order)
    return rows.mapInPandas(fold, T.StructType([*rows.schema.fields, T.StructField("allowed", T.BooleanType())]))


def lru(trace: DataFrame, capacity: int, cache: str = "cache", at: str = "at", key: str = "key") -> DataFrame:
    """Add ``hit``: a least-recently-used cache a value of ``cache`` that takes in every missed key."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, OrderedDict()
        for frame in frames:
            out = []
            for c, k in zip(frame[cache].tolist(), frame[key].tolist(), strict=True):
                if c != now:
                    now, held = c, OrderedDict()
                out.append(k in held)
                held[k] = True
                held.move_to_end(k)
                if len(held) > capacity:
                    held.popitem(last=False)
            yield frame.assign(hit=out)

    rows = trace.select(cache, at, key).repartition(cache).sortWithinPartitions(cache, at)
    return rows.mapInPandas(fold, T.StructType([*rows.schema.fields, T.StructField("hit", T.BooleanType())]))


def ttl_live(live: DataFrame, ttl_seconds: int, now_seconds: int, at: str = "ts") -> DataFrame:
    """Rows that have not outlived their time; 0 is forever."""
    return live if ttl_seconds == 0 else live.where(F.unix_timestamp(at) + ttl_seconds > now_seconds)


def timers_due(timers: DataFrame, current_tick: int, tick_ms: int, slots: int) -> DataFrame:
    """Timers (timer_id, start_tick, timeout_ms, canceled) with their expiry tick and wheel slot, those that are due."""
    wait = F.greatest(F.lit(1), F.ceil(F.col("timeout_ms") / tick_ms))
    out = timers.withColumn("expire_tick", (F.col("start_tick") + wait).cast("long")).withColumn("slot", F.pmod("expire_tick", F.lit(slots)))
    return out.where(~F.col("canceled") & (F.col("expire_tick") <= current_tick))


def probe_health(probes: DataFrame, down_after: int = 1, up_after: int = 1) -> DataFrame:
    """Healthy or not after each probe (upstream, at, ok): flips after so many equal outcomes in a row; starts healthy."""
    key = Window.partitionBy("upstream").orderBy("at")
    turn = F.coalesce((F.lag("ok").over(key) != F.col("ok")).cast("int"), F.lit(1))
    streaks = probes.withColumn("_s", F.sum(turn).over(key)).withColumn("_n", F.row_number().over(Window.partitionBy("upstream", "_s").orderBy("at")))
    flip = F.when(F.col("ok") & (F.col("_n") >= up_after), True).when(~F.col("ok") & (F.col("_n") >= down_after), False)
    return streaks.withColumn("healthy", F.coalesce(F.last(flip, ignorenulls=True).over(key.rowsBetween(Window.unboundedPreceding, 0)), F.lit(True))).drop("_s", "_n")
