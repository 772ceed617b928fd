"""Write-ahead logs and sorted tables in their binary formats, as Spark data sources.

A log file is a run of frames: CRC-32C and length in four little-endian bytes each, then the payload.  A payload is
a batch of operations: type (1), key length (4), value length (4), key, value.  Reading stops at the first torn or
damaged frame, and each file is one partition.  Sequence numbers follow the files' order and the operations'.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

VALUE, DELETION = 1, 2
POLYNOMIAL = 0x82F63B78


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (POLYNOMIAL if n & 1 else 0)
        out.append(n)
    return out


_STEPS = _table()


def crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for octet in data:
        crc = (crc >> 8) ^ _STEPS[(crc ^ octet) & 0xFF]
    return crc ^ 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    return struct.pack("<II", crc32c(payload), len(payload)) + payload


def frames(data: bytes) -> Iterator[bytes]:
    """Payloads up to the first torn or damaged frame."""
    at = 0
    while at + 8 <= len(data):
        crc, n = struct.unpack_from("<II", data, at)
        payload = data[at + 8 : at + 8 + n]
        if len(payload) < n or crc32c(payload) != crc:
            return
        yield payload
        at += 8 + n


def encode_batch(ops: Iterable[tuple[int, bytes, bytes]]) -> bytes:
    return b"".join(struct.pack("<BII", kind, len(k), len(v)) + k + v for kind, k, v in ops)


def decode_batch(payload: bytes) -> list[tuple[int, bytes, bytes]]:
    out, at = [], 0
    while at + 9 <= len(payload):
        kind, nk, nv = struct.unpack_from("<BII", payload, at)
        at += 9
        out.append((kind, payload[at : at + nk], payload[at + nk : at + nk + nv]))
        at += nk + nv
    return out


def file_number(path: str) -> int | None:
    """The generation of a log file; the unnumbered one is the oldest; None for other files."""
    name = path.rsplit("/", 1)[-1]
    if name == "wal.log":
        return 0
    found = re.fullmatch(r"wal-(\d+)\.log", name)
    return int(found[1]) if found else None


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(file_no, batch_no, pos, user_key, vtype, value) of all log files in a folder that Spark can read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "wal*.log").load(folder).select("path", "content")

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                number = file_number(path)
                if number is None:
                    continue
                rows = [(number, b, i, k.decode(), kind, v.decode()) for b, p in enumerate(frames(content)) for i, (kind, k, v) in enumerate(decode_batch(p))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["file_no", "batch_no", "pos", "user_key", "vtype", "value"]).cast(_arrow_schema())

    return files.mapInArrow(decode, "file_no long, batch_no long, pos int, user_key string, vtype int, value string")


def _arrow_schema():
    import pyarrow as pa

    return pa.schema([("file_no", pa.int64()), ("batch_no", pa.int64()), ("pos", pa.int32()), ("user_key", pa.string()), ("vtype", pa.int32()), ("value", pa.string())])


class WalDataSource(DataSource):
    """``format("strata_wal")``: read or append log files in a folder that all executors mount at one path."""

    @classmethod
    def name(cls) -> str:
        return "strata_wal"

    def schema(self) -> str:
        return "file_no long, batch_no long, pos int, user_key string, vtype int, value string"

    def reader(self, schema) -> DataSourceReader:
        return WalReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WalWriter(self.options["path"], int(self.options.get("batch", "100")))


class _File(InputPartition):
    def __init__(self, path: str, number: int) -> None:
        self.path, self.number = path, number


class WalReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        found = [(file_number(n), n) for n in os.listdir(self.path)]
        return [_File(os.path.join(self.path, n), k) for k, n in sorted(x for x in found if x[0] is not None)]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            content = f.read()
        for b, payload in enumerate(frames(content)):
            for i, (kind, k, v) in enumerate(decode_batch(payload)):
                yield partition.number, b, i, k.decode(), kind, v.decode()


class _Written(WriterCommitMessage):
    def __init__(self, temporary: str | None) -> None:
        self.temporary = temporary


class WalWriter(DataSourceWriter):
    """Each task writes a file under a temporary name; the commit gives the files the next generations."""

    def __init__(self, path: str, batch: int) -> None:
        self.path, self.batch = path, batch

    def write(self, rows) -> _Written:
        import uuid

        os.makedirs(self.path, exist_ok=True)
        target = os.path.join(self.path, f"_new-{uuid.uuid4().hex}")
        ops: list[tuple[int, bytes, bytes]] = []
        any_row = False
        with open(target, "wb") as f:
            for row in rows:
                any_row = True
                ops.append((row["vtype"], row["user_key"].encode(), (row["value"] or "").encode()))
                if len(ops) == self.batch:
                    f.write(frame(encode_batch(ops)))
                    ops = []
            if ops:
                f.write(frame(encode_batch(ops)))
            f.flush()
            os.fsync(f.fileno())
        if not any_row:
            os.remove(target)
            return _Written(None)
        return _Written(target)

    def commit(self, messages) -> None:
        last = max((n for n in map(file_number, os.listdir(self.path)) if n is not None), default=0)
        for m in messages:
            if m and m.temporary:
                last += 1
                os.rename(m.temporary, os.path.join(self.path, f"wal-{last:06d}.log"))

    def abort(self, messages) -> None:
        for m in messages:
            if m and m.temporary and os.path.exists(m.temporary):
                os.remove(m.temporary)


def recovered(ops: DataFrame, first: int = 1) -> DataFrame:
    """Change-log rows of replayed operations: sequence numbers from ``first`` in file, batch and operation order.

    Numbers come from counts of the files and batches before, so no task sees all rows.
    """
    from pyspark.sql import Window

    counts = ops.groupBy("file_no", "batch_no").agg(F.count("*").alias("n"))
    files = counts.groupBy("file_no").agg(F.sum("n").alias("n")).withColumn("before_file", F.coalesce(F.sum("n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("file_no").orderBy("batch_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before_batch", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(files.select("file_no", "before_file"), "file_no")
    out = ops.join(starts.select("file_no", "batch_no", (F.col("before_file") + F.col("before_batch")).alias("base")), ["file_no", "batch_no"])
    return out.select("user_key", (F.col("base") + F.col("pos") + first).cast("long").alias("seq"), "vtype", "value")
