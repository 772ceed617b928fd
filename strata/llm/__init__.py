"""Operations of a training-data pipeline. Nothing outside this folder and corpus_pipeline.py imports it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: module -> its query
_QUERIES = {
    "line_dedup": "op1_line_dedup",
    "media": "op4_media_chunks",
    "bpe": "op8_byte_bpe",
    "lz_fingerprint": "op3_lz_fingerprint",
    "language": "op6_language_id",
    "licenses": "op5_license_index",
    "ngram_join": "op7_ngram_jaccard",
    "packing": "op9_best_fit_packing",
    "secrets": "op2_randomness_battery",
    "toxicity": "op10_toxicity",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"strata.llm.{module}"), name) for module, name in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL of those queries that have any; the others are tested against brute force."""
    found = {}
    for module, name in _QUERIES.items():
        sql = getattr(importlib.import_module(f"strata.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
