"""Best-fit packing by linear grouping.

Lengths are integers of at most ``capacity``, so a histogram of bounded size says all that a packing plan needs.
The plan is made from it on the driver:

1. Large lengths (over ``capacity * small_share``) are sorted and cut into ``groups`` groups of equal cardinality;
   within a group every length is rounded up to the group's largest.
2. The few rounded sizes are packed by configurations: the linear program over all configurations is solved by
   column generation (a knapsack prices configurations), and rounded down to whole sequences.
3. Actual documents take the places of the rounded sizes.
4. What the rounding down left, and then the small lengths, go best-fit into the space that is left.

Sequences with equal contents are kept as one class with a count, so the plan's size depends on ``capacity`` and
``groups`` alone, never on the number of documents: it is safe to broadcast.  A document finds its place by its
rank among the documents of its length, which salted windows number without one task for a frequent length.

Defined cases: a null text counts as empty and is one token (the closing id 0); rows with a null or repeated
``doc_id`` are packed as any other; only documents longer than ``capacity`` are cut, their first piece being the
short one; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm._common import checkpointed, map_text, resident, shuffle_partitions, table, tidy

CAPACITY = 2048
GROUPS = 100
SMALL_SHARE = 1 / 4
END_ID = 0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Ids:
    """Ids of the vocabulary file's tokenizer, as it is loaded: strings of its special tokens get these tokens' ids.

    Texts whose code points all lie below U+0250 are split alike by both libraries' patterns, and the merges of
    the file are its ranks, so the faster library encodes them; all other texts, and those in which the string of a
    special token stands, go to the file's own library.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(back[c] for c in token): rank for token, rank in vocab.items() if all(c in back for c in token) and token not in self.special()}
        import public_tokenizers

        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.beyond = re.compile("|".join(["[^\x00-ɏ]", *map(re.escape, sorted(self.special()))]))

    def special(self) -> set[str]:
        return {t.content for t in self.slow.get_added_tokens_decoder().values()}

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.beyond.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text)


def loaded(path: str) -> Ids:
    return resident(("packing", path), lambda: Ids(path))


def pieces(df: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every document, its closing id included."""
    path = path or default_vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids_of = loaded(path)
        row, number, start, length, crc = [], [], [], [], []
        for r, t in enumerate(batch.column(1).to_pylist()):
            ids = np.append(ids_of(t), np.uint32(END_ID)).astype("<u4", copy=False)
            at, k, n = 0, 0, len(ids)
            stop = n % capacity or min(n, capacity)
            while at < n:
                row.append(r)
                number.append(k)
                start.append(at)
                length.append(stop - at)
                crc.append(zlib.crc32(ids[at:stop].tobytes()))
                at, stop, k = stop, stop + capacity, k + 1
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    src = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_text(src, "text", run, "doc_id long, piece int, start long, length long, ids_crc32 long", keeps=True)


@dataclass
class Bins:
    """``count`` sequences with equal contents: (length, number of such documents) in the order they lie."""

    count: int
    room: int
    content: list[tuple[int, int]] = field(default_factory=list)


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable configuration: how many of each size."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    sizes_sorted, values_sorted = sizes[order], values[order]
    for room in range(int(sizes_sorted[0]), capacity + 1):
        fit = int(np.searchsorted(sizes_sorted, room, side="right"))
        gain = best[room - sizes_sorted[:fit]] + values_sorted[:fit]
        k = int(gain.argmax())
        if gain[k] > best[room - 1] + 1e-12:
            best[room], choice[room] = gain[k], k
        else:
            best[room] = best[room - 1]
    out, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
            continue
        out[order[choice[room]]] += 1
        room -= int(sizes_sorted[choice[room]])
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 600) -> list[tuple[list[int], int]]:
    """[(how many of each size, how many such sequences)]: the configuration program's basic solution, rounded down."""
    if not sizes:
        return []
    w, n = np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // w).astype(float))
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(len(w)))
        column = _knapsack(w, price, capacity).astype(float)
        if price @ column <= 1 + 1e-7:
            break
        use, step = np.linalg.solve(basis, n), np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    use = np.linalg.solve(basis, n)
    out, left = [], np.array(demand, np.int64)
    for j in np.argsort(-use):
        column = basis[:, j].astype(np.int64)
        times = max(0, int(use[j] + 1e-6))
        if times and (inside := column > 0).any():
            times = min(times, int((left[inside] // column[inside]).min()))
            if times:
                out.append((column.tolist(), times))
                left -= column * times
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small_share: float = SMALL_SHARE) -> list[Bins]:
    """Sequences, as classes with counts, that hold exactly the documents of the histogram."""
    left = {length: n for length, n in histogram.items() if n}
    done: list[Bins] = []
    if capacity in left:
        done.append(Bins(left.pop(capacity), 0, [(capacity, 1)]))
    large = sorted((length for length in left if length > capacity * small_share), reverse=True)
    total = sum(left[x] for x in large)
    share = max(1, -(-total // groups))
    size, demand, members, filled = [], [], [], 0
    for length in large:  # linear grouping, the longest first; a length may lie in two groups
        n = left[length]
        while n:
            if filled == 0:
                size.append(length)
                demand.append(0)
                members.append([])
            take = min(n, share - filled)
            demand[-1] += take
            members[-1].append([length, take])
            n, filled = n - take, (filled + take) % share
    merged: dict[int, int] = {}
    for i, s in enumerate(size):
        if s in merged:
            demand[merged[s]] += demand[i]
            members[merged[s]] += members[i]
        else:
            merged[s] = i
    keep = sorted(merged.values())
    size, demand, members = [size[i] for i in keep], [demand[i] for i in keep], [members[i] for i in keep]
    open_bins: list[Bins] = []
    for column, times in configurations(size, demand, capacity):
        slots = [g for g, k in enumerate(column) for _ in range(k)]
        while times:
            # the next sequences whose places all take documents of one length each
            need: dict[int, int] = {}
            for g in slots:
                need[g] = need.get(g, 0) + 1
            run = min(times, *(members[g][0][1] // k for g, k in need.items()))
            if run:
                content = [(members[g][0][0], k) for g, k in need.items()]
                for g, k in need.items():
                    members[g][0][1] -= run * k
            else:  # a length ends within one sequence
                run, lengths = 1, {}
                for g in slots:
                    while not members[g][0][1]:
                        members[g].pop(0)
                    lengths[members[g][0][0]] = lengths.get(members[g][0][0], 0) + 1
                    members[g][0][1] -= 1
                content = list(lengths.items())
            for g in need:
                while members[g] and not members[g][0][1]:
                    members[g].pop(0)
            open_bins.append(Bins(run, capacity - sum(x * k for x, k in content), content))
            times -= run
    rest = {length: n for length, n in left.items() if length <= capacity * small_share}
    for group in members:
        for length, n in group:
            if n:
                rest[length] = rest.get(length, 0) + n
    rooms: list[tuple[int, int]] = sorted((b.room, i) for i, b in enumerate(open_bins))
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            at = bisect_left(rooms, (length, -1))
            if at == len(rooms):
                each = capacity // length
                for count, k in ((n // each, each), (1 if n % each else 0, n % each)):
                    if count:
                        open_bins.append(Bins(count, capacity - k * length, [(length, k)]))
                        insort(rooms, (capacity - k * length, len(open_bins) - 1))
                n = 0
                continue
            room, i = rooms.pop(at)
            b = open_bins[i]
            each = min(room // length, n)
            take = min(b.count, n // each)
            if take < b.count:
                open_bins.append(Bins(b.count - take, room, list(b.content)))
                insort(rooms, (room, len(open_bins) - 1))
            b.count, b.room = take, room - each * length
            b.content.append((length, each))
            insort(rooms, (b.room, i))
            n -= take * each
    return done + [b for b in open_bins if b.count]


def placements(bins: list[Bins]) -> np.ndarray:
    """Rows (length, first rank, first sequence, documents of it in a sequence, first offset), sorted by length and rank."""
    rows, rank, base = [], {}, 0
    for b in bins:
        offset = 0
        for length, k in b.content:
            first = rank.get(length, 0)
            rows.append((length, first, base, k, offset))
            rank[length] = first + b.count * k
            offset += length * k
        base += b.count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(items: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small_share: float = SMALL_SHARE) -> DataFrame:
    """Add sequence_id and offset to rows with (doc_id, piece, length, ids_crc32); ``length`` is 1 to ``capacity``."""
    spark = items.sparkSession
    salts = shuffle_partitions(spark)
    items = checkpointed(items.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts))))
    counts = items.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    lengths = counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()  # at most ``capacity`` rows
    rows = placements(plan({int(r.length): int(r.n) for r in lengths}, capacity, groups, small_share))
    rule = spark.sparkContext.broadcast(rows)  # bounded by capacity and groups
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_before"))
    local = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = items.withColumn("_rank", F.row_number().over(local)).join(offsets, ["length", "_salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_rank") - 1).alias("rank"))

    def place(batches):
        table_ = rule.value
        wide = 1 << 48
        keys = table_[:, 0] * wide + table_[:, 1] if len(table_) else np.zeros(0, np.int64)
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            row = table_[np.searchsorted(keys, length * wide + rank, side="right") - 1]
            t = rank - row[:, 1]
            out = [*(batch.column(i) for i in range(5)), pa.array(row[:, 2] + t // row[:, 3]), pa.array(row[:, 4] + t % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(tidy(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
