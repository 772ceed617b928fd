"""Connected components: a union-find over the edges of each task, and between tasks large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm._common import checkpointed, small_batches, tidy


def _ends(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends: (u, v)."""
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _degrees(edges: DataFrame) -> DataFrame:
    """(u, m, smaller, larger): each node's least neighbour, and how many neighbours are smaller and larger."""
    return _ends(edges).groupBy("u").agg(F.min("v").alias("m"), F.count(F.when(F.col("v") < F.col("u"), 1)).alias("smaller"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("larger"))


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """The same rows, but a join on the (long) key shuffles this side too, so that it can split the other side's frequent keys."""
    return df.withColumn(key, F.shiftleft(key, 0))


def _star(around: DataFrame, large: bool) -> DataFrame:
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    tied = around.join(dealt_anew(least, "u"), "u")
    if large:  # the larger neighbours move to the least one
        moved = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:  # the node and its smaller neighbours do
        moved = tied.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return moved.where("a <> b")


#: Edges that one task reads, and that a union-find holds; few edges make few tasks and few files.
EDGES = 200_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (node, root) of the components that the edges make, roots being the smallest nodes."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)  # numbers in the order of the nodes
    up = list(range(len(nodes)))
    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x < y:
            up[y] = x
        else:
            up[x] = y
    for x in range(len(up)):  # what stands above a node has a smaller number
        up[x] = up[up[x]]
    root = np.array(up, np.int64)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return nodes[moved], nodes[root[moved]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges that connect the same nodes: stars, one for each component of up to ``EDGES`` edges of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def stars() -> pa.RecordBatch:
            x, y = forest(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            count += batch.num_rows
            if count >= EDGES:
                yield stars()
                held, count = [], 0
        if count:
            yield stars()

    small_batches(edges.sparkSession)
    return edges.select("a", "b").mapInArrow(tidy(run), "a long, b long")


def components(edges: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(node, root) for every node with an edge; the root is the smallest node that it reaches.

    Every step goes through the checkpoint folder, so a lost executor costs at most one step.  Steps end when all
    edges are those of stars, that is, when every node either has larger neighbours alone or a single smaller one; their
    number grows with the logarithm of the longest path between the stars of tasks.  As many edges as one task
    holds need no further step.  Null nodes and edges from a node to itself are left out; an empty table gives an empty
    result.
    """
    now = edges.select(F.col(first).cast("long").alias("a"), F.col(second).cast("long").alias("b")).where("a <> b")
    now = checkpointed(contracted(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    while True:
        degrees = _degrees(now).agg(F.count(F.when((F.col("smaller") > 1) | (F.col("smaller") > 0) & (F.col("larger") > 0), 1)).alias("unsettled"), F.sum("larger").alias("edges")).first()
        now = now.coalesce(max(1, -(-(degrees.edges or 0) // EDGES)))
        if not degrees.unsettled:
            break
        if degrees.edges <= EDGES:
            now = checkpointed(contracted(now))
            break
        now = _star(_ends(contracted(now)), large=True)
        now = checkpointed(_star(now.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), large=False).distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
