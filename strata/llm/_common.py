"""Helpers that the operators of this subpackage share: reading, Arrow mapping, vector hashing."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one call of a batch function gets at most (one row may be longer).
SLICE_BYTES = 4 << 20
#: The same where numpy holds some tens of bytes for each byte of text.
SMALL_SLICE = 1 << 19
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_training(doc_id: str = "doc_id") -> Column:
    """True for rows that a model may learn from: crc32(id as text) mod 3 is not 1. A null id is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the strings of ``column`` in each take about ``limit`` bytes; no row is dropped."""
    for batch in batches:
        if not batch.num_rows:
            continue
        arr = batch.column(batch.schema.get_field_index(column))
        width = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
        ends = np.frombuffer(arr.buffers()[1], dtype=width)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
            stop = min(batch.num_rows, max(stop, start + 1))
            yield batch.slice(start, stop - start)
            start = stop


def small_batches(spark: SparkSession) -> None:
    """Record batches that go to Python hold ``SLICE_BYTES`` at most, or less where the session says so."""
    held = "".join(c for c in spark.conf.get(_BATCH_BYTES) if c.isdigit())
    if not held or int(held) > SLICE_BYTES:
        spark.conf.set(_BATCH_BYTES, str(SLICE_BYTES))


#: What a worker process keeps between tasks: the model or vocabulary of the operator that it ran last.
_RESIDENT: dict[Any, Any] = {}


def resident(key: Any, build: Callable[[], Any]) -> Any:
    """``build()``, kept in the worker until another operator asks for what it needs."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        give_back()
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def give_back() -> None:
    """Return freed memory to the system; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Run, keeps: bool = False) -> Run:
    """A ``mapInArrow`` function that leaves no memory behind, but the resident model if it ``keeps`` one."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _RESIDENT.clear()
        yield from run(batches)
        give_back()

    return tidied


def map_text(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, limit: int = SLICE_BYTES, keeps: bool = False) -> DataFrame:
    """``mapInArrow`` over slices of bounded size; ``fn`` turns one slice into one record batch, or none."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, limit):
            out = fn(part)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(tidy(run, keeps), schema)


def buffer_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array, concatenated, and the n+1 offsets; nulls are empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    width = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    offs = np.frombuffer(arr.buffers()[1], dtype=width)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed 64-bit odd multipliers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


_BYTE = seeds(256, 77)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; a worker keeps them for its next batches."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, SMALL_SLICE + 1), np.uint64)
        have[1:] = np.uint64(base & (2**64 - 1))
        np.multiply.accumulate(have, out=have)
        if len(have) <= 2 * SMALL_SLICE:
            _POWERS[base] = have
    return have[:n]


def span_sums(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which hashes of spans are taken."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers(_BASE, len(raw)), out=sums[1:])
    return sums


#: Spans of more bytes are hashed one by one: sums of powers are weak where long strings repeat themselves with a twist.
SHORT_SPAN = 32


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end): equal bytes have equal hashes wherever they stand."""
    sums = span_sums(raw)
    out = mix64((sums[ends] - sums[starts]) * powers(_INVERSE, len(raw) + 1)[starts] + (ends - starts).astype(np.uint64))
    long = np.flatnonzero(ends - starts > SHORT_SPAN)
    if len(long):
        view = memoryview(raw)
        out[long] = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), np.uint64, len(long))
    return out


def span_digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the byte spans, as two arrays of longs."""
    view = memoryview(raw)
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of this application under ``spark.checkpoint.dir``; one is made only in local mode without it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="strata-checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of a bitmap filter: 8 MB, whatever the input. More values only make it let more through.
FILTER_BITS = 26


def bitmap_filter(values: DataFrame, column: str) -> np.ndarray:
    """A fixed-size bitmap with the low bits of every value of a long column set; no value that is in it is refused."""
    # bucket and bit numbers count from one
    place = F.col(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    rows = values.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in rows.collect():  # at most 2048 rows of 4 KB
        part = np.frombuffer(bytes(r.bits), np.uint8)
        out[(r.k - 1) * 4096 : (r.k - 1) * 4096 + len(part)] |= part
    return out


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    p = values.astype(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1


def shared_only(rows: DataFrame, parts: int, key: str = "k", member: str = "sk") -> DataFrame:
    """The different rows of (long) columns whose key has several members. One shuffle, one sort, no group is held."""
    columns = rows.columns
    ki, mi = columns.index(key), columns.index(member)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row seen
        emitted = False  # whether it, or one like it, has been given out

        for batch in batches:
            if held is not None:
                batch = pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(held.columns, batch.columns, strict=True)], schema=batch.schema)
            n = batch.num_rows
            if not n:
                continue
            k, m = batch.column(ki).to_numpy(), batch.column(mi).to_numpy()
            fresh = np.ones(n, bool)  # not the same row again
            fresh[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
            if held is not None:
                fresh[0] = not emitted
            several = np.zeros(n, bool)
            other = (k[1:] == k[:-1]) & (m[1:] != m[:-1])
            first = np.concatenate(([True], k[1:] != k[:-1]))
            group = np.cumsum(first) - 1
            mixed = np.zeros(int(group[-1]) + 1, bool)
            mixed[group[1:][other]] = True
            if held is not None and emitted:
                mixed[0] = True
            several = mixed[group]
            keep = fresh & several
            # the last row of the batch goes on with the next one
            last_emitted = bool(several[-1])
            tail = np.flatnonzero((k == k[-1]) & (m == m[-1]))[:1]
            if not last_emitted:
                keep[tail] = False
            held, emitted = batch.slice(n - 1, 1), last_emitted
            if keep.any():
                yield batch.filter(pa.array(keep))

    small_batches(rows.sparkSession)
    sorted_rows = rows.repartition(parts, key).sortWithinPartitions(key, member)
    return sorted_rows.mapInArrow(tidy(run), rows.schema)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage through a Parquet table in the shared folder, for rows that columns make much smaller."""
    path = f"{checkpoint_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
