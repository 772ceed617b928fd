"""Placement of keys and requests: hash rings, shards, balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.hashing import fnv1a


def ring(spark: SparkSession, nodes: list[str], vnodes: int) -> DataFrame:
    """(pos, node) of the virtual nodes; of two at one position the later one stays."""
    spots = spark.createDataFrame([(i * vnodes + v, n, f"{n}#{v}") for i, n in enumerate(nodes) for v in range(vnodes)], "ord long, node string, label string")
    return spots.withColumn("pos", fnv1a(F.col("label"))).groupBy("pos").agg(F.max_by("node", "ord").alias("node"))


def locate(keys: DataFrame, spots: DataFrame, key: str = "user_key") -> DataFrame:
    """Add ``node``: the first virtual node at or after the key's hash, around the ring's end to its first.

    The ring is nodes times virtual nodes; its intervals are built once and broadcast.
    """
    order = Window.orderBy("pos")
    arcs = spots.select("node", "pos", F.coalesce(F.lag("pos").over(order) + 1, F.lit(0)).alias("low"))
    last = spots.agg(F.max("pos").alias("top"), F.min_by("node", "pos").alias("node"))
    wrap = last.select("node", F.lit(2**32 - 1).alias("pos"), (F.col("top") + 1).alias("low"))
    arcs = arcs.unionByName(wrap)
    hashed = keys.withColumn("key_hash", fnv1a(F.col(key)))
    return hashed.join(F.broadcast(arcs), (F.col("key_hash") >= F.col("low")) & (F.col("key_hash") <= F.col("pos"))).drop("low", "pos")


def migrated(keys: DataFrame, before: DataFrame, after: DataFrame, key: str = "user_key") -> DataFrame:
    """Keys with their nodes on two rings."""
    old = locate(keys, before, key).select(key, F.col("node").alias("old_node"))
    return locate(old, after, key).select(key, "old_node", F.col("node").alias("new_node"))


def spread(placed: DataFrame, bucket: str) -> DataFrame:
    """Count of each bucket, its share, and its term of the chi-squared statistic against an even spread."""
    counts = placed.groupBy(bucket).agg(F.count("*").alias("n_keys"))
    total = counts.agg(F.sum("n_keys").alias("_n"), F.count("*").alias("_k"))
    even = F.col("_n") / F.col("_k")
    return counts.crossJoin(F.broadcast(total)).select(bucket, "n_keys", (F.col("n_keys") / F.col("_n")).alias("share"), (F.pow(F.col("n_keys") - even, 2.0) / even).alias("chi_term"))


def round_robin(request: Column, upstreams: list[str]) -> Column:
    """The upstream of the n-th request (from 0) over the healthy ones."""
    return F.element_at(F.array(*(F.lit(u) for u in upstreams)), (F.pmod(request, F.lit(len(upstreams))) + 1).cast("int"))


def smooth_period(weights: list[tuple[str, int]]) -> list[str]:
    """One period of smooth weighted round robin: the choice repeats after the sum of the weights."""
    now = dict.fromkeys((u for u, _ in weights), 0)
    total, out = sum(w for _, w in weights), []
    for _ in range(total):
        for u, w in weights:
            now[u] += w
        best = max((u for u, _ in weights), key=lambda u: now[u])
        now[best] -= total
        out.append(best)
    return out


def smooth_round_robin(request: Column, weights: list[tuple[str, int]]) -> Column:
    return round_robin(request, smooth_period(weights))


def least_connections(upstreams: DataFrame, group: str | None = None) -> DataFrame:
    """The upstream (name, healthy, connections, ordinal) with the fewest connections, the first of equals."""
    healthy = upstreams.where("healthy")
    choice = F.min_by("name", F.struct("connections", "ordinal")).alias("name")
    return healthy.groupBy(group).agg(choice) if group else healthy.agg(choice)


def shard(key_hash: Column, shards: int) -> Column:
    return F.pmod(key_hash, F.lit(shards))
