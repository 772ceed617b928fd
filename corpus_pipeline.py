"""A training corpus from raw documents: each stage works on all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of their input.  ``run`` writes each stage's rows as Parquet into the shared folder of
``spark.checkpoint.dir`` and reads them again for the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import line_dedup, ngram_join, packing, secrets, toxicity
from strata.llm._common import checkpoint_folder, table
from strata.shipping import ship

#: No stage of this pipeline can be told in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; null and empty texts stay."""
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.probability(docs, model) < toxicity.REJECT)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents of which that leaves no more than white space."""
    ship(spark)
    aside, back = _set_aside(docs, {"n_lines", "n_long", "dropped"})
    out = line_dedup.dedup(aside, short=True).where((F.size("dropped") == 0) | F.col("text").rlike(r"[^\t\n\x0B\f\r ]"))
    return _measured(back(out), docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that five-word shingles link, the one with the smallest id stays."""
    ship(spark)
    gone = ngram_join.link(docs).where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in place; every document stays."""
    ship(spark)
    aside, back = _set_aside(docs, {"n_assign", "n_access", "n_hex", "n_random", "spans", "base_spans"})
    out = secrets.scan(aside).withColumn("text", secrets.masked("text", "spans"))
    return _measured(back(out), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in training sequences."""
    ship(spark)
    return packing.pack(packing.pieces(docs))


def _set_aside(docs: DataFrame, names: set[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The documents with columns of these names renamed, and what gives these their names again."""
    kept = {c: f"__kept_{c}" for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(kept), lambda df: df.drop(*names).withColumnsRenamed({v: k for k, v in kept.items()})


def _measured(df: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))
    return df.select(columns)


STAGES = [
    ("toxicity", toxic_out),
    ("line_dedup", lines_once),
    ("ngram_jaccard", near_copies_out),
    ("secrets", secrets_out),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
