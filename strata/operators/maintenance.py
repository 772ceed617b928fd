"""Writes and maintenance: batches, flushes to runs, merges, compactions, the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.reads import LIVE, TOMBSTONE, latest


def explode_batches(batches: DataFrame, batch: str = "batch_no", ops: str = "ops", base: str = "base") -> DataFrame:
    """Rows of write batches: op i of a batch takes sequence number base + i + 1."""
    return batches.select(batch, F.col(base).alias("_base"), F.posexplode(ops).alias("pos", "op")).select(batch, "pos", (F.col("_base") + F.col("pos") + 1).alias("seq"), "op.*")


def next_sequence(log: DataFrame) -> Column:
    """Scalar subquery-like aggregate: the first free sequence number of a log."""
    return F.coalesce(F.max("seq"), F.lit(0)) + 1


def with_run(log: DataFrame, rows_per_run: int) -> DataFrame:
    """Assign each version to the run that its memory table is flushed to."""
    return log.withColumn("run_id", F.floor(F.col("seq") / rows_per_run).cast("long"))


def flush_stats(runs: DataFrame) -> DataFrame:
    """One row a run: what a writer records of it."""
    size = F.octet_length("user_key") + F.octet_length("value")
    return runs.groupBy("run_id").agg(
        F.count("*").alias("n_rows"),
        F.min("user_key").alias("min_key"),
        F.max("user_key").alias("max_key"),
        F.sum(size).cast("long").alias("n_bytes"),
        F.sum((F.col("vtype") == TOMBSTONE).cast("long")).alias("n_tombstones"),
    )


def merge_runs(*runs: DataFrame) -> DataFrame:
    """All versions of several runs with their place among the versions of their key, the newest first."""
    merged = runs[0]
    for run in runs[1:]:
        merged = merged.unionByName(run)
    order = Window.partitionBy("user_key").orderBy(F.desc("seq"), "vtype")
    return merged.withColumn("version_rank", F.row_number().over(order))


def merge_groups(runs: DataFrame, group: int) -> DataFrame:
    """Each ``group`` runs merged as by ``merge_runs``: every version, with its place among those of its key in the group."""
    order = Window.partitionBy("run_group", "user_key").orderBy(F.desc("seq"), "vtype")
    return _grouped(runs, group).withColumn("version_rank", F.row_number().over(order))


def compact_groups(runs: DataFrame, group: int) -> DataFrame:
    """The newest version of every key in each ``group`` runs; tombstones stay, as older runs may hold the key."""
    return merge_groups(runs, group).where("version_rank = 1").drop("version_rank")


def _grouped(runs: DataFrame, group: int) -> DataFrame:
    return runs.withColumn("run_group", F.floor(F.col("run_id") / group).cast("long"))


def compact(runs: DataFrame, drop_tombstones: bool) -> DataFrame:
    """The newest version of every key; tombstones may go only if the input holds all older runs."""
    newest = latest(runs)
    return newest.where(F.col("vtype") == LIVE) if drop_tombstones else newest


def compact_retaining(log: DataFrame, min_snapshot: int) -> DataFrame:
    """What snapshots from ``min_snapshot`` on can still see, and the newest version below; a lone old tombstone goes."""
    below = F.col("seq") < min_snapshot
    key = Window.partitionBy("user_key")
    ranked = log.withColumn("_below", F.row_number().over(Window.partitionBy("user_key", below).orderBy(F.desc("seq"), "vtype")))
    kept = ranked.where(~below | (F.col("_below") == 1)).withColumn("_n", F.count("*").over(key))
    return kept.where(~((F.col("_n") == 1) & (F.col("vtype") == TOMBSTONE) & below)).drop("_below", "_n")


def level_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("n_files"), F.max("file_no").alias("max_file_no"))


def compaction_due(files: DataFrame, trigger: int = 4) -> DataFrame:
    """Levels with at least ``trigger`` files."""
    return level_stats(files).where(F.col("n_files") >= trigger)


def manifest_live(edits: DataFrame) -> DataFrame:
    """Live files of an edit log (edit_no, type, level, file_no): after the last reset, the latest edit of a file is add."""
    # a reset cuts everything before it; the cut is one value
    cut = edits.where(F.col("type") == "reset").agg(F.coalesce(F.max("edit_no"), F.lit(-1)).alias("_cut"))
    after = edits.crossJoin(F.broadcast(cut)).where((F.col("edit_no") > F.col("_cut")) & (F.col("type") != "reset"))
    last = after.groupBy("level", "file_no").agg(F.max_by("type", "edit_no").alias("type"))
    return last.where(F.col("type") == "add").select("level", "file_no")


def write_amplification(runs: DataFrame, group: int) -> DataFrame:
    """Rows read and rows kept by compacting each ``group`` runs together."""
    return _grouped(runs, group).groupBy("run_group").agg(F.count("*").alias("rows_in"), F.countDistinct("user_key").alias("rows_kept"))


def write_run(run: DataFrame, path: str, partitions: int, compression: str = "zstd") -> None:
    """Write a run sorted by key and age, with key bounds and a key filter in its footers for later pruning."""
    ordered = run.repartitionByRange(partitions, "user_key").sortWithinPartitions("user_key", F.desc("seq"), "vtype")
    ordered.write.mode("errorifexists").option("compression", compression).option("parquet.bloom.filter.enabled#user_key", "true").parquet(path)


def manifest_snapshot(edits: DataFrame) -> DataFrame:
    """The edits that say the same as all before them: a reset, then an addition of each live file."""
    last = edits.agg(F.max("edit_no").alias("_last"))  # one row
    reset = last.select((F.col("_last") + 1).alias("edit_no"), F.lit("reset").alias("type"), F.lit(0).cast("long").alias("level"), F.lit(-1).cast("long").alias("file_no"))
    adds = manifest_live(edits).crossJoin(F.broadcast(last)).select((F.col("_last") + 2).alias("edit_no"), F.lit("add").alias("type"), F.col("level").cast("long").alias("level"), F.col("file_no").cast("long").alias("file_no"))
    return reset.unionByName(adds)
