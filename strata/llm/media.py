"""Media columns by content-defined chunking.

A payload (the UTF-8 bytes of a text, zero-padded to a multiple of 64) is stored as 8-bit samples in chunks.  A gear
hash rolls over the bytes, and a chunk ends where its top ``CUT_BITS`` bits are zero, between ``LEAST`` and ``MOST``
bytes from its start, so that equal passages are cut alike wherever they stand.

``store`` writes two Parquet tables.  ``objects`` has a row for each document: the ordered chunk list (digest,
length, whether the chunk is shared) and the bytes of the chunks that occur once.  ``chunks`` has every chunk that
occurs several times, once.  Which do is found by grouping digests; the writers learn it from a bitmap of fixed
size, and whatever the bitmap lets through wrongly is stored among the shared ones, so only shared bytes are
shuffled.  ``load`` joins the lists of different payloads with the shared chunks, checks every chunk's digest, puts
the payloads together in order, and fails on a missing or damaged chunk.

The stored form of a payload, for its size and hash, is its chunk list (``CDC1``, payload length, number of chunks,
then length and digest of each) followed by the samples.

Defined cases: null and empty texts are 64 zero bytes; equal texts are one payload however often they occur; rows
with a null ``doc_id`` are stored as any other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm._common import bitmap_filter, checkpoint_folder, in_bitmap, seeds, slices, table

UNIT = 64
CUT_BITS = 10
LEAST, MOST = 256, 4096
DIGEST = 16
_GEAR = (seeds(256, 21) >> np.uint64(32)).astype(np.uint32)


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\0" * ((-len(raw)) % UNIT or (0 if raw else UNIT))


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a payload."""
    rolled = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # sums over windows of 2, 4, ... 32 bytes, each byte shifted by its age
        older = rolled[:-k] << np.uint32(k)
        rolled = rolled.copy()
        rolled[k:] += older
    places = (np.flatnonzero(rolled >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    ends, start, n = [], 0, len(data)
    for p in places:
        while p - start > MOST:
            start += MOST
            ends.append(start)
        if p - start >= LEAST and p < n:
            start = p
            ends.append(p)
    while n - start > MOST:
        start += MOST
        ends.append(start)
    ends.append(n)
    return ends


def chunks_of(data: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of a payload's chunks, in order."""
    out, start = [], 0
    for end in cuts(data):
        piece = data[start:end]
        out.append((hashlib.blake2b(piece, digest_size=DIGEST).digest(), piece))
        start = end
    return out


def short(digest: bytes) -> int:
    return struct.unpack("<q", digest[:8])[0]


def stored_form(recipe: list[tuple[bytes, int]], data: bytes) -> bytes:
    return b"CDC1" + struct.pack("<QI", len(data), len(recipe)) + b"".join(struct.pack("<I", n) + d for d, n in recipe) + data


def features(data: bytes, n_chunks: int) -> str:
    """Mean, deviation and entropy of the samples, share of zero crossings of their steps, and the number of chunks."""
    samples = np.frombuffer(data, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    mean = float(counts @ np.arange(256)) / len(samples)
    deviation = max(0.0, float(counts @ (np.arange(256) ** 2)) / len(samples) - mean * mean) ** 0.5
    rises = samples[1:] > samples[:-1]
    turns = float(np.count_nonzero(rises[1:] != rises[:-1])) / len(samples)
    return f"{mean:.4f},{deviation:.4f},{float(-(share * np.log2(share)).sum()):.4f},{turns:.4f},{n_chunks}"


_RESULT = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _described(data: bytes, recipe: list[tuple[bytes, int]]) -> tuple:
    form = stored_form(recipe, data)
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(form), hashlib.sha256(form).hexdigest(), features(data, len(recipe))


def store(documents: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> None:
    """Write the media store of a text column to ``path``/objects and ``path``/chunks."""
    spark = documents.sparkSession
    src = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            count: dict[bytes, int] = {}
            for t in batch.column(1).to_pylist():
                for d, _ in chunks_of(payload(t)):
                    count[d] = count.get(d, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([short(d) for d in count], pa.int64()), pa.array(list(count.values()), pa.int64())], names=["d", "n"])

    repeated = src.mapInArrow(digests, "d long, n long").groupBy("d").agg(F.sum("n").alias("n")).where("n > 1")
    bits = spark.sparkContext.broadcast(bitmap_filter(repeated, "d"))  # of fixed size

    def shared(pieces: list[tuple[bytes, bytes]]) -> list[bool]:
        return in_bitmap(bits.value, np.array([short(d) for d, _ in pieces], np.int64).view(np.uint64)).tolist()

    def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for t in batch.column(1).to_pylist():
                pieces = chunks_of(payload(t))
                common = shared(pieces)
                recipe = [{"digest": d, "size": len(p), "shared": c} for (d, p), c in zip(pieces, common, strict=True)]
                own = b"".join(p for (_, p), c in zip(pieces, common, strict=True) if not c)
                object_id = hashlib.blake2b(b"".join(d for d, _ in pieces), digest_size=DIGEST).digest()
                rows.append((object_id, len((t or "").encode()), any(common), recipe, own))
            kinds = (pa.binary(), pa.int64(), pa.bool_(), pa.list_(pa.struct([("digest", pa.binary()), ("size", pa.int32()), ("shared", pa.bool_())])), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "object_id", "n_bytes", "any_shared", "recipe", "own"])

    def common_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "text"):
            found: dict[bytes, bytes] = {}
            for t in batch.column(1).to_pylist():
                pieces = chunks_of(payload(t))
                found |= {d: p for (d, p), c in zip(pieces, shared(pieces), strict=True) if c}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([pack.compress(p) for p in found.values()], pa.binary())], names=["digest", "samples"])

    made = src.mapInArrow(objects, "doc_id long, object_id binary, n_bytes long, any_shared boolean, recipe array<struct<digest:binary,size:int,shared:boolean>>, own binary")
    made.write.option("compression", "zstd").parquet(f"{path}/objects")
    unique = src.mapInArrow(common_chunks, "digest binary, samples binary").groupBy("digest").agg(F.min("samples").alias("samples"))
    unique.write.option("compression", "uncompressed").parquet(f"{path}/chunks")


def _whole(recipe: list[dict], own: bytes, found: dict[int, bytes]) -> tuple[bytes, list[tuple[bytes, int]]]:
    """The payload of a chunk list, from its own bytes and the shared chunks by place; every digest is checked."""
    parts, at = [], 0
    for i, c in enumerate(recipe):
        if c["shared"]:
            piece = found.get(i)
        else:
            piece = own[at : at + c["size"]]
            at += c["size"]
        if piece is None or len(piece) != c["size"] or hashlib.blake2b(piece, digest_size=DIGEST).digest() != c["digest"]:
            raise ValueError(f"chunk {c['digest'].hex()} is missing or damaged")
        parts.append(piece)
    return b"".join(parts), [(c["digest"], c["size"]) for c in recipe]


def load(spark: SparkSession, path: str, fn=_described, schema: str = _RESULT) -> DataFrame:
    """(doc_id, n_bytes, and what ``fn(payload, chunk list)`` returns), read back from the store, for every document."""
    objects = spark.read.parquet(f"{path}/objects")
    names = [c.split()[0] for c in schema.split(",")]
    alone = objects.where("not any_shared").select("doc_id", "n_bytes", "recipe", "own")

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "own"):
            rows = [fn(*_whole(r, o, {})) for r, o in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in zip(*rows, strict=True))], names=["doc_id", "n_bytes", *names])

    one = alone.mapInArrow(direct, f"doc_id long, n_bytes long, {schema}")
    # payloads with shared chunks are put together once, however many documents have them
    several = objects.where("any_shared").groupBy("object_id").agg(F.first(F.struct("recipe", "own")).alias("x")).select("object_id", "x.*")
    needed = objects.where("any_shared").select("object_id", "recipe").dropDuplicates(["object_id"]).select("object_id", F.posexplode("recipe").alias("i", "c")).where("c.shared")
    pieces = needed.select("object_id", "i", F.col("c.digest").alias("digest")).join(spark.read.parquet(f"{path}/chunks"), "digest", "left")
    pieces = pieces.groupBy("object_id").agg(F.collect_list(F.struct("i", "samples")).alias("pieces"))  # chunks of one payload

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches, "own"):
            rows = []
            for r, o, found in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                got = {p["i"]: unpack.decompress(p["samples"]) for p in found if p["samples"] is not None}
                rows.append(fn(*_whole(r, o, got)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*rows, strict=True))], names=["object_id", *names])

    put = several.join(pieces, "object_id").mapInArrow(assembled, f"object_id binary, {schema}")
    many = objects.where("any_shared").select("doc_id", "n_bytes", "object_id").join(put, "object_id").select("doc_id", "n_bytes", *names)
    return one.unionByName(many)


def op4_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_folder(spark)}/media-{uuid.uuid4().hex}"
    store(table(spark, sf_dir, "documents"), path)
    return load(spark, path)
