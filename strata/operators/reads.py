"""Reads over a change log: newest visible version per key, points, ranges, prefixes, snapshots.

A change log has (user_key, seq, vtype, value); vtype 1 is a value, 2 a tombstone.  Keys are ordered by their bytes,
versions of a key from the newest.  Predicates on the key or the sequence are put below the ranking, so that they
reach the Parquet scan of a stored log; the ranking itself keeps one row a key before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIVE, TOMBSTONE = 1, 2


def latest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Newest version of every key, tombstones included; with ``snapshot`` only versions up to that seq are seen."""
    if snapshot is not None:
        log = log.where(F.col("seq") <= snapshot)
    order = Window.partitionBy("user_key").orderBy(F.desc("seq"), "vtype")
    return log.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def latest_live(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Newest version of every key unless that is a tombstone, which hides everything older."""
    return latest(log, snapshot).where(F.col("vtype") == LIVE)


def multi_get(log: DataFrame, keys: Iterable[str], snapshot: int | None = None) -> DataFrame:
    """(user_key, status, value) for each key asked for; status is OK or NOT_FOUND."""
    keys = sorted(set(keys))
    asked = log.sparkSession.createDataFrame([(k,) for k in keys], "user_key string")
    found = latest_live(log.where(F.col("user_key").isin(keys)), snapshot).select("user_key", "value", F.lit("OK").alias("_ok"))
    # one side is the literal keys of the call
    return F.broadcast(asked).join(found, "user_key", "left").select("user_key", F.coalesce("_ok", F.lit("NOT_FOUND")).alias("status"), "value")


def point_get(log: DataFrame, key: str, snapshot: int | None = None) -> DataFrame:
    return multi_get(log, [key], snapshot)


def range_scan(log: DataFrame, start: str = "", end: str = "", snapshot: int | None = None) -> DataFrame:
    """Live keys with start <= key < end; an empty bound is open."""
    if start:
        log = log.where(F.col("user_key") >= start)
    if end:
        log = log.where(F.col("user_key") < end)
    return latest_live(log, snapshot)


def ordered_scan(log: DataFrame, start: str = "", end: str = "", snapshot: int | None = None) -> DataFrame:
    """The range in the order of the keys' bytes; the sort is by ranges of keys, none of which takes all rows."""
    return range_scan(log, start, end, snapshot).orderBy("user_key")


def prefix_scan(log: DataFrame, prefix: str, snapshot: int | None = None) -> DataFrame:
    return latest_live(log.where(F.startswith("user_key", F.lit(prefix))), snapshot)


def seek(log: DataFrame, target: str, n: int, snapshot: int | None = None) -> DataFrame:
    """The first n live keys at or after the target."""
    return range_scan(log, start=target, snapshot=snapshot).orderBy("user_key").limit(n)


def snapshot_diff(log: DataFrame, old: int, new: int) -> DataFrame:
    """Keys whose live value differs between two snapshots, with both values (null: not live). One pass over the log."""
    newest = F.max(F.struct("seq", (-F.col("vtype")).alias("t"), "value"))
    older = F.max(F.when(F.col("seq") <= old, F.struct("seq", (-F.col("vtype")).alias("t"), "value")))
    both = log.where(F.col("seq") <= new).groupBy("user_key").agg(older.alias("o"), newest.alias("n"))
    value = lambda side: F.when(F.col(f"{side}.t") == -LIVE, F.col(f"{side}.value"))
    both = both.select("user_key", value("o").alias("old_value"), value("n").alias("new_value"))
    return both.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def count_live(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    return latest_live(log, snapshot).agg(F.count("*").alias("n_live"))


#: Buckets of keys that a range delete numbers apart.
NUMBER_BUCKETS = 1024


def range_delete(log: DataFrame, start: str, end: str, snapshot: int) -> DataFrame:
    """Tombstones for the live keys of a range, one sequence number each after ``snapshot`` (an extension)."""
    gone = range_scan(log, start, end, snapshot).select("user_key", F.pmod(F.xxhash64("user_key"), F.lit(NUMBER_BUCKETS)).alias("_bucket"))
    # numbered within buckets of keys, so that no task sees them all; one row a bucket tells how many come before
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = gone.groupBy("_bucket").agg(F.count("*").alias("_n"))
    bases = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    number = F.col("_base") + F.row_number().over(Window.partitionBy("_bucket").orderBy("user_key"))
    gone = gone.join(F.broadcast(bases), "_bucket")  # NUMBER_BUCKETS rows at most
    return gone.select("user_key", (F.lit(snapshot) + number).cast("long").alias("seq"), F.lit(TOMBSTONE).alias("vtype"), F.lit("").alias("value"))
