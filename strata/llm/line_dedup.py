"""Fuzzy line deduplication by MinHash.

Lines are what stands between line feeds.  Lines of at least ``LEAST`` characters take part, and, if ``short`` is
asked for as the query and the pipeline do, all shorter ones that hold more than ASCII white space.  Equal lines are
one line.  A line's set is its distinct runs of ``SHINGLE`` characters; a line of fewer is its only shingle, so it is
similar to equal lines alone and needs no bands; ``BANDS`` bands of ``ROWS`` minima of independent hashes make lines with Jaccard similarity
``THRESHOLD`` or more meet with a probability of over 99 % (99.5 % at ``THRESHOLD`` itself).  Pairs are verified on the exact sets; verified pairs are
united by distributed star contraction, and of every component one line stays, the first by (doc_id, line number).

Buckets are not paired off: each proposes ``PIVOTS`` of its lines to all, what links is merged, and after
at most ``ROUNDS`` such rounds buckets that still hold several components propose their pairs across components.  A proposal must pass a parity sketch of
``SKETCH`` bits first: the bits in which two sketches differ are at most the shingles in which the sets do.

Defined cases: a null text stays null and has no lines; an empty text has one empty line, which stays; rows with a
null ``doc_id`` come last in the order; rows with the same id and text are one document, so they keep the same
lines; other columns pass through (but ones named n_lines, n_long and dropped are replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm._common import SMALL_SLICE, bitmap_filter, buffer_of, checkpointed, in_bitmap, mix64, seeds, shared_only, shuffle_partitions, slices, small_batches, span_digests, table, tidy, written
from strata.llm._graph import components, dealt_anew

LEAST = 20
SHINGLE = 8
THRESHOLD = 0.8
BANDS = 10
ROWS = 4
PIVOTS = 3
ROUNDS = 1
#: Buckets whose pairs are under so many times their lines are paired off without further rounds.
FEW = 16
SKETCH = 2048
FOLDED = 8
_FACTORS = (seeds(BANDS * ROWS, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_BAND = seeds(ROWS, 12)
_SALT = seeds(BANDS, 13)
_BLOCK = 200
_BASE = 0x5851F42D4C957F2D
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Lines:
    """The lines of a batch of texts, as spans of their bytes."""

    def __init__(self, texts: pa.Array, short: bool = False) -> None:
        self.raw, offsets = buffer_of(texts)
        breaks = np.flatnonzero(self.raw == 10)
        count = len(offsets) - 1
        doc = np.concatenate((np.arange(count), np.searchsorted(offsets, breaks, side="right") - 1))
        start = np.concatenate((offsets[:-1], breaks + 1))
        order = np.lexsort((start, doc))
        self.doc, self.start = doc[order], start[order]
        self.end = offsets[self.doc + 1]
        same = self.doc[:-1] == self.doc[1:]
        self.end[:-1][same] = self.start[1:][same] - 1
        first = np.searchsorted(self.doc, np.arange(count))
        self.number = np.arange(len(self.doc)) - first[self.doc]
        if short:  # most lines show by their first byte that they are not blank
            some = self.end > self.start
            taken = np.zeros(len(self.doc), bool)
            taken[some] = ~_BLANK[self.raw[self.start[some]]]
            for i in np.flatnonzero(some & ~taken).tolist():
                line = self.raw[self.start[i] : self.end[i]]
                taken[i] = len(line) >= LEAST or not _BLANK[line].all()
        else:
            chars = np.concatenate(([0], np.cumsum((self.raw & 0xC0) != 0x80, dtype=np.int32)))
            taken = chars[self.end] - chars[self.start] >= LEAST
        for name in ("doc", "start", "end", "number"):
            setattr(self, name, getattr(self, name)[taken])
        self.key, self.check = span_digests(self.raw, self.start, self.end)

    def only(self, chosen: np.ndarray) -> Lines:
        for name in ("doc", "start", "end", "number", "key", "check"):
            setattr(self, name, getattr(self, name)[chosen])
        return self

    def distinct(self) -> Lines:
        return self.only(np.unique(self.key, return_index=True)[1])

    def shingled(self) -> Lines:
        """The lines that hold a shingle, with the code points of their characters."""
        self.only(self.end - self.start >= SHINGLE)
        view = memoryview(self.raw)
        joined = b"\n".join([view[a:b] for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)])
        self.codes = np.frombuffer(joined.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        breaks = np.append(np.flatnonzero(self.codes == 10), len(self.codes))
        self.first = np.append(0, breaks[:-1] + 1)[: len(self.key)]
        self.chars = breaks[: len(self.key)] - self.first
        long = self.chars >= SHINGLE
        self.first, self.chars = self.first[long], self.chars[long]
        return self.only(long)

    def hashes(self, kind: type) -> np.ndarray:
        """Hashes of ``SHINGLE`` characters from each place, those that run over a line's end included."""
        out = self.codes.astype(kind)
        width = 1
        while width < SHINGLE:
            out = out[:-width] + out[width:] * kind(pow(_BASE, width, 1 << 8 * np.dtype(kind).itemsize))
            width *= 2
        return out

    def text(self, i: int) -> str:
        return self.raw[self.start[i] : self.end[i]].tobytes().decode()

    def sketches(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of distinct shingles, their parity on each bit as rows of 64-bit words) of all lines."""
        hashes, counts, count = self.hashes(np.uint32), self.chars - SHINGLE + 1, len(self.key)
        sizes, words = np.empty(count, np.int64), np.empty((count, SKETCH // 64), np.int64)
        for i in range(0, count, _BLOCK):  # blocks, so that the counts of all bits are never held together
            j = min(count, i + _BLOCK)
            some = counts[i:j]
            at = np.arange(some.sum()) + np.repeat(self.first[i:j] - np.cumsum(some) + some, some)
            owner = np.repeat(np.arange(j - i, dtype=np.uint64) << np.uint64(32), some)
            tagged = np.sort(owner | hashes[at])
            fresh = np.ones(len(tagged), bool)
            fresh[1:] = tagged[1:] != tagged[:-1]
            tagged = tagged[fresh]
            line = (tagged >> np.uint64(32)).astype(np.int64)
            place = line * SKETCH + ((tagged >> np.uint64(7)) & np.uint64(SKETCH - 1)).astype(np.int64)
            odd = (np.bincount(place, minlength=(j - i) * SKETCH) & 1).astype(np.uint8)
            sizes[i:j] = np.bincount(line, minlength=j - i)
            words[i:j] = np.packbits(odd).view(np.int64).reshape(j - i, SKETCH // 64)
        return sizes, words

    def sets(self) -> list[np.ndarray]:
        """Sorted distinct 64-bit hashes of the shingles of each line."""
        every = self.hashes(np.uint64)
        return [np.unique(every[i : i + n]) for i, n in zip(self.first.tolist(), (self.chars - SHINGLE + 1).tolist(), strict=True)]

    def bands(self) -> np.ndarray:
        """One 64-bit key a line and band."""
        hashes, count = np.append(self.hashes(np.uint32), np.uint32(0)), len(self.key)
        keys = np.zeros((BANDS, count), np.uint64)
        least = np.empty((BANDS * ROWS, _BLOCK), np.uint32)
        for i in range(0, count, _BLOCK):  # blocks that stay in the processor's cache
            j = min(count, i + _BLOCK)
            begin, end = self.first[i], self.first[j - 1] + self.chars[j - 1] - SHINGLE + 1
            part = hashes[begin : end + 1]
            bounds = np.empty(2 * (j - i), np.int64)  # a line's shingles, and what lies between lines, in turn
            bounds[::2] = self.first[i:j] - begin
            bounds[1::2] = bounds[::2] + self.chars[i:j] - SHINGLE + 1
            for k, factor in enumerate(_FACTORS):
                least[k, : j - i] = np.minimum.reduceat(part * factor, bounds)[::2]
            for b in range(BANDS):
                for r in range(ROWS):
                    keys[b, i:j] += least[b * ROWS + r, : j - i].astype(np.uint64) * _BAND[r]
        for b in range(BANDS):
            keys[b] = mix64(keys[b] + _SALT[b])
        return keys.view(np.int64)


def similar(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether two sorted sets have the threshold's Jaccard similarity."""
    both = np.concatenate((x, y))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common >= threshold * (len(x) + len(y) - common) - 1e-9


def _mapped(src: DataFrame, fn, schema: str, short: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SMALL_SLICE):
            out = fn(batch, Lines(batch.column(2), short))
            if out is not None and out.num_rows:
                yield out

    small_batches(src.sparkSession)
    return src.mapInArrow(tidy(run), schema)


def _occurrences(batch: pa.RecordBatch, lines: Lines) -> pa.RecordBatch:
    doc = pa.array(lines.doc)
    return pa.RecordBatch.from_arrays([batch.column(0).take(doc), batch.column(1).take(doc), pa.array(lines.number.astype(np.int32)), pa.array(lines.key), pa.array(lines.check)], names=["o", "row", "line", "sk", "check"])


def _buckets(_: pa.RecordBatch, lines: Lines) -> pa.RecordBatch | None:
    lines = lines.distinct().shingled()
    if not len(lines.key):
        return None
    return pa.RecordBatch.from_arrays([pa.array(lines.bands().ravel()), pa.array(np.tile(lines.key, BANDS))], names=["k", "sk"])


def _known(src: DataFrame, asked: DataFrame, short: bool) -> DataFrame:
    """(sk, check, n, s, t): second half of the hash, size, sketch and text of the lines that are asked for."""
    bits = src.sparkSession.sparkContext.broadcast(bitmap_filter(asked, "sk"))

    def fetch(_: pa.RecordBatch, lines: Lines) -> pa.RecordBatch | None:
        lines = lines.only(in_bitmap(bits.value, lines.key.view(np.uint64))).distinct().shingled()
        if not len(lines.key):
            return None
        texts = pa.array([lines.text(i) for i in range(len(lines.key))], pa.string())
        sizes, sketches = lines.sketches()
        words = pa.ListArray.from_arrays(pa.array(np.arange(len(lines.key) + 1) * (SKETCH // 64), pa.int32()), pa.array(sketches.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(lines.key), pa.array(lines.check), pa.array(sizes.astype(np.int32)), words, texts], names=["sk", "check", "n", "s", "t"])

    found = _mapped(src, fetch, "sk long, check long, n int, s array<long>, t string", short).join(asked.distinct(), "sk", "left_semi")
    return written(found.dropDuplicates(["sk"]))


def _folded(sketch: str) -> Column:
    """The sketch folded to ``FOLDED`` words."""
    word = lambda i: functools.reduce(Column.bitwiseXOR, (F.col(sketch)[j] for j in range(i, SKETCH // 64, FOLDED)))
    return F.array(*(word(i) for i in range(FOLDED)))


def _near(n: str, m: str, a: str, b: str, folded: tuple[str, str] | None = None) -> Column:
    """False for sizes and sketches of which the sets cannot be similar; folded sketches are looked at first."""
    total = F.col(n) + F.col(m)
    fits = lambda apart: (1 + THRESHOLD) * (total - apart) >= 2 * THRESHOLD * total - 1e-9
    out = (F.col(n) >= THRESHOLD * F.col(m) - 1e-9) & (F.col(m) >= THRESHOLD * F.col(n) - 1e-9)
    if folded:
        out = out & fits(sum((F.bit_count(F.col(folded[0])[i].bitwiseXOR(F.col(folded[1])[i])) for i in range(FOLDED)), F.lit(0)))
    return out & fits(F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x))


def _verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of line keys those whose lines are similar."""
    side = lambda x: known.select(F.col("sk").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}"))
    near = pairs.distinct().join(side("b"), "b").join(side("a"), "a").where(_near("na", "nb", "sa", "sb")).select("a", "b")
    near = checkpointed(near)
    both = near.join(known.select(F.col("sk").alias("b"), F.col("t").alias("tb")), "b").join(known.select(F.col("sk").alias("a"), F.col("t").alias("ta")), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ta", 1 << 18):
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            texts = list(dict.fromkeys(a + b))
            number = dict(zip(texts, Lines(pa.array(texts, pa.string()), True).shingled().sets(), strict=True))  # each text is one line
            keep = [similar(number[x], number[y]) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return checkpointed(both.select("a", "b", "ta", "tb").mapInArrow(tidy(check), "a long, b long"))


def _several(lists: DataFrame, column: str) -> DataFrame:
    """Rows of the buckets that hold different values of the column."""
    each = Window.partitionBy("k")
    return lists.withColumn("_lo", F.min(column).over(each)).withColumn("_hi", F.max(column).over(each)).where("_lo <> _hi").drop("_lo", "_hi")


def classes(src: DataFrame, short: bool = False) -> DataFrame:
    """(sk, check, root) of the lines that are similar to another one."""
    buckets = checkpointed(shared_only(_mapped(src, _buckets, "k long, sk long", short), shuffle_partitions(src.sparkSession)))
    known = _known(src, buckets.select("sk"), short)
    other = lambda df, *more: df.select("k", F.col("sk").alias("sk2"), F.col("c").alias("d"), *more)
    pair = (F.least("sk", "sk2").alias("a"), F.greatest("sk", "sk2").alias("b"))
    rest, links, label = buckets.withColumn("c", F.col("sk")), None, None
    for turn in range(ROUNDS):
        ranked = rest.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64(F.lit(turn), "sk"), "sk")))
        met = ranked.join(other(ranked.where(F.col("r") <= PIVOTS), F.col("r").alias("q")), "k").where("r > q and c <> d").select(*pair)
        found = _verified(met, known)
        links = found if links is None else links.unionByName(found)
        label = checkpointed(components(links))
        if not turn:  # buckets of at most PIVOTS + 1 lines have had all their pairs verified
            rest = rest.withColumn("_size", F.count("*").over(Window.partitionBy("k"))).where(F.col("_size") > PIVOTS + 1).drop("_size")
        rest = rest.drop("c").join(label.select(F.col("node").alias("sk"), "root"), "sk", "left").withColumn("c", F.coalesce("root", "sk")).drop("root")
        rest = checkpointed(_several(rest, "c"))
        size = rest.groupBy("k").agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()
        if (size[1] or 0) <= FEW * (size[0] or 0):
            break
    rest = checkpointed(rest.join(known.select("sk", "n", "s", _folded("s").alias("f")), "sk"))
    across = rest.join(other(rest, F.col("n").alias("m"), F.col("s").alias("s2"), F.col("f").alias("f2")), "k").where((F.col("sk") < F.col("sk2")) & (F.col("c") != F.col("d")) & _near("n", "m", "s", "s2", ("f", "f2"))).select(*pair)
    more = _verified(across, known)
    if not more.isEmpty():
        label = checkpointed(components(links.unionByName(more)))
    # another line with the same first half of the hash is none of these
    return label.select(F.col("node").alias("sk"), "root").join(known.select("sk", "check"), "sk")


def dedup(documents: DataFrame, text: str = "text", key: str = "doc_id", short: bool = False) -> DataFrame:
    """The rows with ``text`` without the lines that repeat an earlier one, and n_lines, n_long, dropped (line numbers).

    With ``short`` lines under ``LEAST`` characters take part too."""
    row = F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string"))
    order = F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1))
    src = documents.where(F.col(text).isNotNull()).select(order.alias("o"), row.alias("row"), F.col(text).cast("string").alias("text"))
    seen = written(_mapped(src, _occurrences, "o long, row long, line int, sk long, check long", short))
    line = ["sk", "check"]
    root = checkpointed(classes(src, short))
    place = F.struct("o", "row", "line")
    # only lines that stand several times, or have similar ones, are ordered
    again = seen.groupBy(line).agg(F.count("*").alias("n")).where("n > 1").select(line).join(root, line, "left_anti").select(*line, F.col("sk").alias("class"), F.col("check").alias("apart"))
    known = root.select(*line, F.col("root").alias("class"), F.lit(0).cast("long").alias("apart")).unionByName(again)
    held = checkpointed(seen.join(known, line).drop(*line))
    first = dealt_anew(held.groupBy("class", "apart").agg(F.min(place).alias("keep")), "class")
    gone = held.join(first, ["class", "apart"]).where(place != F.col("keep")).groupBy("o", "row").agg(F.array_sort(F.collect_set("line")).alias("dropped"))
    gone = gone.withColumnRenamed("o", "__line_o").withColumnRenamed("row", "__line_row").withColumnRenamed("dropped", "__line_dropped")
    out = documents.drop("n_lines", "n_long", "dropped").withColumn("__line_o", order).withColumn("__line_row", row).join(gone, ["__line_o", "__line_row"], "left").drop("__line_o", "__line_row")
    out = out.withColumn("dropped", F.coalesce("__line_dropped", F.array().cast("array<int>"))).drop("__line_dropped")
    parts = F.split(F.col(text).cast("string"), "\n", -1)
    left = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("dropped", i)), "\n")
    out = out.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("long"))
    out = out.withColumn("n_long", F.when(F.col(text).isNull(), 0).otherwise(F.size(F.filter(parts, lambda x: F.length(x) >= LEAST))).cast("long"))
    return out.withColumn(text, F.when(F.size("dropped") > 0, left).otherwise(F.col(text)))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_kept, dropped, text): every document without the lines that repeat an earlier one."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), short=True)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", (F.col("n_lines") - F.size("dropped")).alias("n_kept"), "dropped", "text")
