"""Runs, event streams in text, replicated logs and settings as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = "user_key string, seq long, vtype int, value string"


def open_log(spark: SparkSession, live_runs: Iterable[str], tail: DataFrame | None = None) -> DataFrame:
    """The change log of a store: the Parquet runs that the manifest lists as live, and the log's tail."""
    paths = list(live_runs)
    log = spark.read.schema(LOG).parquet(*paths) if paths else spark.createDataFrame([], LOG)
    return log if tail is None else log.unionByName(tail)


def run_metadata(run: DataFrame) -> DataFrame:
    """Bounds and sizes of each file of a run, for pruning."""
    return run.groupBy(F.input_file_name().alias("path")).agg(F.min("user_key").alias("min_key"), F.max("user_key").alias("max_key"), F.count("*").alias("n_rows"), F.max("seq").alias("max_seq"))


def sse_frames(pairs: DataFrame) -> DataFrame:
    """Server-sent frames (frame) of a scan's (key, value) rows, and the closing frame with their count."""
    body = pairs.select(F.concat(F.lit("data: "), F.to_json(F.struct("key", "value")), F.lit("\n\n")).alias("frame"))
    end = pairs.agg(F.count("*").alias("count")).select(F.concat(F.lit("event: end\ndata: "), F.to_json(F.struct("count")), F.lit("\n\n")).alias("frame"))
    return body.unionByName(end)


def read_sse(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the data frames in files of server-sent events; frames with an event line are skipped."""
    blocks = spark.read.text(path, lineSep="\n\n").where(F.startswith("value", F.lit("data: ")))
    return blocks.select(F.from_json(F.substring("value", 7, 1 << 30), "key string, value string").alias("p")).select("p.key", "p.value")


def apply_commands(commands: DataFrame) -> DataFrame:
    """State after a replicated log of JSON commands (index, command): put and del in index order, others fail the job."""
    parsed = commands.select("index", F.from_json("command", "op string, key string, value string").alias("c")).select("index", "c.*")
    known = parsed.withColumn("op", F.when(F.col("op").isin("put", "del"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null"))))))
    last = known.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("index")))).where("_r = 1")
    return last.where("op = 'put'").select("key", "value")


def snapshot_json(state: DataFrame, buckets: int = 16) -> DataFrame:
    """The state as JSON maps, one a bucket of keys, so that no row holds all of it."""
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    return state.groupBy(bucket).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("state"))


def restore_json(snapshot: DataFrame) -> DataFrame:
    return snapshot.select(F.explode(F.from_json("state", "map<string,string>")).alias("key", "value"))


def settings(text: str) -> dict[str, object]:
    """Sections with ``name: value`` lines and lists of ``- item`` lines, as a dict; # begins a comment."""
    out: dict[str, object] = {}
    section: str | None = None
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].rstrip()
        if not line.strip():
            continue
        inner = line.strip()
        if line == inner and inner.endswith(":"):
            section = inner[:-1]
            out[section] = {}
        elif inner.startswith("- "):
            held = out.get(section)
            out[section] = [*held, inner[2:].strip()] if isinstance(held, list) else [inner[2:].strip()]
        else:
            name, _, value = inner.partition(":")
            target = out if section is None or line == inner else out[section]
            target[name.strip()] = value.strip()
    return out
