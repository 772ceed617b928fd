"""Lempel-Ziv phrase fingerprints.

A document is parsed as LZ78 does: each phrase is the shortest run of symbols not yet in the document's dictionary.
Symbols are runs of up to ``SYMBOL`` non-space characters.  The phrases' hashes give a min-hash signature of
``SLOTS`` slots; the share of equal slots of two signatures estimates the Jaccard likeness of the phrase sets, which
is high for texts that compress each other well.  A common beginning is parsed alike whatever follows it.

``neighbours`` walks all documents in descending order of their ids, each with the next one.  Rows are dealt to
ranges of the order; the first row of each range is also sent to the range before, so that one shuffle of
compressed texts is enough and no task sees more than a range.

Defined cases: a null text counts as empty; two empty texts are alike (1), an empty and another one are not (0);
rows with a null ``doc_id`` come last in the order; rows with one ``doc_id`` are ordered by a hash of their text;
a single row is its own next document; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm._common import seeds, shuffle_partitions, slices, table

SLOTS = 128
SYMBOL = 12
_SYMBOLS = re.compile(rf"\S{{1,{SYMBOL}}}")
_FACTORS = seeds(SLOTS, 3)
_CHUNK = 8192


def phrases(text: str) -> set[str]:
    """The dictionary that the parse of the text leaves."""
    seen: set[str] = set()
    add, now = seen.add, ""
    for symbol in _SYMBOLS.findall(text):
        longer = f"{now} {symbol}" if now else symbol
        if longer in seen:
            now = longer
        else:
            add(longer)
            now = ""
    return seen


def signature(text: str) -> np.ndarray:
    """SLOTS 16-bit values; all ones for a text without symbols."""
    from xxhash import xxh3_64_intdigest

    hashes = np.fromiter(map(xxh3_64_intdigest, phrases(text)), np.uint64)
    if not len(hashes):
        return np.full(SLOTS, 0xFFFF, np.uint16)
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _CHUNK):
        np.minimum(least, (hashes[i : i + _CHUNK] * _FACTORS[:, None]).min(axis=1), out=least)
    return ((least >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.uint16)


def shown(values: np.ndarray) -> str:
    return values.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / SLOTS


def fingerprint(text: str | None) -> str:
    return shown(signature(text or ""))


def edited(text: str, following: str) -> str:
    """The last third of the text's characters replaced by as many, or all, of the following text's first."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _ordered(documents: DataFrame, text: str, key: str) -> DataFrame:
    src = documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # ascending order of (o1, o2) is descending order of doc_id with nulls last, ties by text
    return src.withColumn("o1", F.bitwise_not(F.coalesce("doc_id", F.lit(-(2**63))))).withColumn("o2", F.xxhash64("text"))


def neighbours(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row."""
    spark = documents.sparkSession
    src = _ordered(documents, text, key)
    parts = shuffle_partitions(spark)
    per = 12
    ranges = 4 * parts
    order = src.select("o1", "o2")
    # places of the ranges' bounds, a few a range; a share of the rows by their hash, so that no task sends more
    draw = F.pmod(F.xxhash64(F.lit(1), "o1", "o2"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * per * ranges / max(1, order.count())))
    drawn = sorted((r.o1, r.o2) for r in order.where(draw).orderBy(F.xxhash64("o1", "o2"), "o1", "o2").limit(per * ranges).collect())
    bounds = drawn[per::per]

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple[int, int]] = {}
        for batch in batches:
            for o in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = bisect_right(bounds, o)
                if b not in least or o < least[b]:
                    least[b] = o
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array([v[0] for v in least.values()], pa.int64()), pa.array([v[1] for v in least.values()], pa.int64())], names=["b", "o1", "o2"])

    heads = {r.b: (r.m.o1, r.m.o2) for r in order.mapInArrow(firsts, "b int, o1 long, o2 long").groupBy("b").agg(F.min(F.struct("o1", "o2")).alias("m")).collect()}  # one row a range
    full = sorted(heads)
    before = {heads[b]: full[i - 1] for i, b in enumerate(full)}  # the range that needs this row too; the last needs the first

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, "text"):
            ids, texts, o1, o2 = (c.to_pylist() for c in batch.columns)
            rows = []
            for i, t, a, b in zip(ids, texts, o1, o2, strict=True):
                raw = pack.compress(t.encode())
                rows.append((bisect_right(bounds, (a, b)), 0, a, b, i, raw))
                if (a, b) in before:
                    rows.append((before[a, b], 1, a, b, i, raw))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["b", "ahead", "o1", "o2", "doc_id", "raw"])

    dealt = src.mapInArrow(deal, "b int, ahead int, o1 long, o2 long, doc_id long, raw binary")
    dealt = dealt.repartition(parts, "b").sortWithinPartitions("b", "ahead", "o1", "o2")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        last: tuple[int, int | None, str, np.ndarray] | None = None  # range, id, text, signature
        for batch in slices(batches, "raw", 1 << 20):
            out = []
            for b, ahead, i, raw in zip(*(batch.column(c).to_pylist() for c in (0, 1, 4, 5)), strict=True):
                if ahead and (last is None or last[0] != b):
                    continue  # a repeated first row of the next range
                t = unpack.decompress(raw).decode()
                s = signature(t)
                if last is not None and last[0] == b:
                    _, i0, t0, s0 = last
                    e = edited(t0, t)
                    se = s0 if e == t0 else signature(e)
                    out.append((i0, len(t0), hashlib.sha256(e.encode()).hexdigest(), shown(s0), shown(se), likeness(s0, se), likeness(s0, s)))
                last = None if ahead else (b, i, t, s)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("doc_id", key)


def op3_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "documents"))
