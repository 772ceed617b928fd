"""Set similarity join on word n-grams: size-aware, light and heavy.

Documents are sets of distinct five-word shingles, as 64-bit hashes; documents with equal sets are one set.  Two
sets link when their Jaccard similarity is at least ``NUMERATOR / DENOMINATOR``, an exact comparison of integers.

* Light sets, of at most ``boundary`` shingles: every subset of the size that a partner of each possible size must
  share is enumerated; sets that share one are candidates.
* Heavy sets: inverted lists are scanned.  A set is listed under those of its shingles that come first in one order
  of all shingles, as many as a partner must meet one of; the order puts shingles that are frequent in the corpus
  last, so their lists are short.  Light sets that a heavy one could match are listed too.
* The boundary is the one with the least cost: subsets written, against postings written and scanned.

Long lists are not paired off.  Each open list first proposes ``PIVOTS`` members to all; what links is merged into
components, and lists whose members are then of one component are closed.  After ``ROUNDS`` such rounds the lists
still open propose every pair across components (by length, position and role), so no link that could join two
components is missed.  All proposals are verified on whole sets.  Only fixed-size bitmaps and at most ``HOT`` frequent
shingles (counted where ``AGAIN`` sets of ``UNIT`` shingles in a task have them) are ever held in one place; they steer the order and the reading, not the result.

Defined cases: null and empty texts, and texts without words, have an empty set and link with nothing; under five
words the whole sequence is the one shingle; repeated rows of a ``doc_id`` count as one document with several
texts; rows with a null ``doc_id`` link with nothing and have a null component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm._common import SMALL_SLICE, bitmap_filter, buffer_of, checkpointed, in_bitmap, mix64, shared_only, shuffle_partitions, slices, small_batches, span_hashes, table, tidy
from strata.llm._graph import components

WORDS = 5
NUMERATOR, DENOMINATOR = 4, 5
HOT = 1 << 20
UNIT = 6_000_000
AGAIN = 3
LARGEST_LIGHT = 12
LIST_COST = 3.0
SKETCH_LEAST = 512
SMALL = SKETCH_LEAST // 64
PIVOTS = 6
ROUNDS = 1
#: Lists whose pairs are under so many times their members are paired off without further rounds.
FEW = 6

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STEP = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(WORDS)]


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def least_overlap(a: int, b: int) -> int:
    """The smallest intersection of sets of a and b that reaches the threshold."""
    return ceil_div(NUMERATOR * (a + b), NUMERATOR + DENOMINATOR)


def partner_sizes(n: int) -> range:
    return range(ceil_div(NUMERATOR * n, DENOMINATOR), DENOMINATOR * n // NUMERATOR + 1)


def probe_prefix(n: int) -> int:
    return n - ceil_div(NUMERATOR * n, DENOMINATOR) + 1


def index_prefix(n: int) -> int:
    return n - least_overlap(n, n) + 1


def subsets_of(n: int) -> int:
    return sum(comb(n, least_overlap(n, m)) for m in partner_sizes(n))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, offsets = buffer_of(texts)
    sets = [np.zeros(0, np.uint64)] * len(texts)
    if not len(raw):
        return sets
    raw = _LOWER[raw]
    blank = _SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    starts = ~blank
    starts[1:] &= blank[:-1] | first[1:-1]
    ends = ~blank
    ends[:-1] &= blank[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    words = span_hashes(raw, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    n = len(words)
    if n >= WORDS:
        grams = words[: n - WORDS + 1] * _STEP[0]
        for k in range(1, WORDS):
            grams = grams + words[k : n - WORDS + 1 + k] * _STEP[k]
        grams = mix64(grams)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if b - a >= WORDS:
            got = np.sort(grams[a : b - WORDS + 1])
            keep = np.ones(len(got), bool)
            keep[1:] = got[1:] != got[:-1]
            sets[i] = got[keep]
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for w in words[a:b]:
                whole = mix64(whole ^ w) * _STEP[1]
            sets[i] = whole
    return sets


_OTHER = np.uint64(0xD1B54A32D192ED03)


def first_key(s: np.ndarray) -> int:
    """A 64-bit key of a set."""
    return int(mix64(np.array([mix64(s).sum(dtype=np.uint64) ^ np.uint64(len(s))]))[0].astype(np.int64))


def second_key(s: np.ndarray) -> int:
    """Another one, which tells sets apart that share the first."""
    return int(mix64(np.array([mix64(s ^ _OTHER).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].astype(np.int64))


def set_key(s: np.ndarray, clashing: frozenset[int]) -> int:
    """The first key, or the second one where different sets share the first."""
    key = first_key(s)
    return second_key(s) if key in clashing else key


def sketch(s: np.ndarray) -> np.ndarray:
    wide = max(SKETCH_LEAST, 1 << (2 * len(s) - 1).bit_length())
    odd = (np.bincount((s & np.uint64(wide - 1)).astype(np.int64), minlength=wide) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _sets(df: DataFrame, fn, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SMALL_SLICE):
            out = fn(batch.column(0), shingle_sets(batch.column(1)))
            if out is not None and out.num_rows:
                yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(tidy(run), schema)


def _summaries(src: DataFrame) -> DataFrame:
    """For each document (0, doc_id, size, keys and sketch of its set); for shingles met again nearby (1, shingle, count)."""
    schema = "kind int, one long, n long, sk long, other long, sketch array<long>"
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    names = ["kind", "one", "n", "sk", "other", "sketch"]

    def again(kept: list[np.ndarray]) -> pa.RecordBatch | None:
        everything = np.sort(np.concatenate(kept))
        cuts = np.flatnonzero(np.concatenate(([True], everything[1:] != everything[:-1])))
        counts = np.diff(np.append(cuts, len(everything)))
        often = counts >= AGAIN
        n = int(often.sum())
        columns = ([1] * n, everything[cuts[often]].view(np.int64), counts[often], [None] * n, [None] * n, [None] * n)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        held = 0
        for batch in slices(batches, "text", SMALL_SLICE):
            sets = shingle_sets(batch.column(1))
            key = [first_key(s) if len(s) else None for s in sets]
            columns = ([0] * len(sets), batch.column(0), [len(s) for s in sets], key, [second_key(s) if len(s) else None for s in sets], [sketch(s) if len(s) else None for s in sets])
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            for k, s in zip(key, sets, strict=True):
                if len(s) and k not in kept:
                    kept[k] = s
                    held += len(s)
            if held >= UNIT:
                yield again(list(kept.values()))
                kept, held = {}, 0
        if kept:
            yield again(list(kept.values()))

    small_batches(src.sparkSession)
    return src.mapInArrow(tidy(run), schema)


def cheapest_boundary(sizes: dict[int, int], largest: int = LARGEST_LIGHT) -> int:
    """The largest light size, by the cost of what is written and scanned for sets up to ``largest``."""

    def cost(x: int) -> float:
        light = sum(n * subsets_of(s) for s, n in sizes.items() if s <= x)
        return light + LIST_COST * sum(n * probe_prefix(s) for s, n in sizes.items() if s <= largest + 4 and DENOMINATOR * s >= NUMERATOR * (x + 1))

    return min(range(largest + 1), key=cost)


def _proposals(src: DataFrame, hot: np.ndarray, boundary: int, clashing: frozenset[int]) -> DataFrame:
    """(light, k, sk, n, pos): subsets of light sets (pos holds the sum of both sizes), postings of heavy ones."""
    shared = src.sparkSession.sparkContext.broadcast(hot)  # at most HOT values, the most frequent last

    def emit(_: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        order = np.argsort(shared.value)
        sorted_hot = shared.value[order]
        light, k, sk, size, pos = [], [], [], [], []
        done = set()
        for s in sets:
            n = len(s)
            if not n or (key := set_key(s, clashing)) in done:
                continue
            done.add(key)
            if n <= boundary:
                mixed = mix64(s)
                for m in partner_sizes(n):
                    need = least_overlap(n, m)
                    for c in combinations(range(n), need):
                        whole = mix64(mixed[list(c)].sum(keepdims=True) + _STEP[2] * np.array([n + m], np.uint64))
                        light.append(np.ones(1, bool))
                        k.append(whole)
                        sk.append(np.array([key]))
                        size.append(np.array([n]))
                        pos.append(np.array([n + m]))
            if DENOMINATOR * n >= NUMERATOR * (boundary + 1):
                p = probe_prefix(n)
                if len(sorted_hot):
                    at = np.minimum(np.searchsorted(sorted_hot, s), len(sorted_hot) - 1)
                    frequent = sorted_hot[at] == s
                    if frequent.any():
                        tail = s[frequent][np.argsort(order[at[frequent]])]
                        s = np.concatenate((s[~frequent], tail))
                light.append(np.zeros(p, bool))
                k.append(s[:p])
                sk.append(np.full(p, key))
                size.append(np.full(p, n))
                pos.append(np.arange(p))
        if not k:
            return None
        cat = np.concatenate
        return pa.RecordBatch.from_arrays([pa.array(cat(light)), pa.array(cat(k).view(np.int64)), pa.array(cat(sk).astype(np.int64)), pa.array(cat(size).astype(np.int32)), pa.array(cat(pos).astype(np.int32))], names=["light", "k", "sk", "n", "pos"])

    return _sets(src, emit, "light boolean, k long, sk long, n int, pos int")


def _small(sketch_: Column) -> Column:
    """The sketch folded to ``SMALL`` longs."""
    words = F.transform(F.sequence(F.lit(0), F.lit(SMALL - 1)), lambda i: F.aggregate(F.filter(sketch_, lambda _, j: j % SMALL == i), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x)))
    return words


def _near(n: str, m: str, a: str, b: str) -> Column:
    """False for sizes and small sketches of which the sets cannot link."""
    fits = (NUMERATOR * F.col(n) <= DENOMINATOR * F.col(m)) & (NUMERATOR * F.col(m) <= DENOMINATOR * F.col(n))
    apart = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SMALL)), F.lit(0))
    total = F.col(n) + F.col(m)
    return fits & ((NUMERATOR + DENOMINATOR) * (total - apart) >= 2 * NUMERATOR * total)


def _verified(pairs: DataFrame, src: DataFrame, classes: DataFrame, clashing: frozenset[int]) -> DataFrame:
    """Of the pairs (a, b) of set keys those whose sets link. Reads the texts again for the sets that are asked for."""
    side = lambda x: classes.select(F.col("sk").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    near = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    half = lambda x: (F.size(x) / 2).cast("int")
    folded = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), lambda y, z: y.bitwiseXOR(z))
    near = near.withColumn("sa", F.when(F.size("sa") > F.size("sb"), folded("sa")).otherwise(F.col("sa"))).withColumn("sb", F.when(F.size("sb") > F.size("sa"), folded("sb")).otherwise(F.col("sb")))
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    total = F.col("na") + F.col("nb")
    # overlap <= (total - apart) / 2
    pairs = checkpointed(near.where((NUMERATOR + DENOMINATOR) * (total - apart) >= 2 * NUMERATOR * total).select("a", "b"))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sk"))
    bits = src.sparkSession.sparkContext.broadcast(bitmap_filter(asked, "sk"))

    def fetch(_: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch | None:
        keyed = {set_key(s, clashing): s for s in sets if len(s)}
        keys = np.array(list(keyed), np.int64)
        if not len(keys):
            return None
        keep = [int(k) for k in keys[in_bitmap(bits.value, keys.view(np.uint64))]]
        return pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array([keyed[k].view(np.int64) for k in keep], pa.list_(pa.int64()))], names=["sk", "s"])

    whole = _sets(src, fetch, "sk long, s array<long>").join(asked.distinct(), "sk", "left_semi").groupBy("sk").agg(F.first("s").alias("s"))
    both = pairs.join(whole.select(F.col("sk").alias("a"), F.col("s").alias("sa")), "a").join(whole.select(F.col("sk").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return checkpointed(both.where(DENOMINATOR * common >= NUMERATOR * (F.size("sa") + F.size("sb") - common)).select("a", "b"))


def link(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id) for every row; component_id is the smallest key that links reach."""
    spark = documents.sparkSession
    src = documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    seen = checkpointed(_summaries(src))
    # different sets with one key, of which ten billion sets have a few, go by their second keys
    alike = seen.where("kind = 0 and sk is not null").groupBy("sk").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi")
    clashing = frozenset(r.sk for r in alike.select("sk").collect())
    if clashing:
        seen = seen.withColumn("sk", F.when(F.col("sk").isin(list(clashing)), F.col("other")).otherwise(F.col("sk")))
    rows = seen.where("kind = 0").select(F.col("one").alias("doc_id"), "n", "sk")
    counts = checkpointed(seen.where("kind = 1").groupBy("one").agg(F.sum("n").alias("n")))
    levels = {int(r.level): int(r.m) for r in counts.groupBy(F.floor(8 * F.log2("n")).alias("level")).agg(F.count("*").alias("m")).collect()}
    least = min((x for x in levels if sum(m for y, m in levels.items() if y >= x) <= HOT), default=1 << 20)
    top = counts.where(F.floor(8 * F.log2("n")) >= least).toArrow()  # at most HOT rows
    often = np.lexsort((top["one"].to_numpy(), top["n"].to_numpy()))
    hot = top["one"].to_numpy()[often].view(np.uint64)
    sizes = {int(r.n): int(r.m) for r in rows.where((F.col("n") > 0) & (F.col("n") <= LARGEST_LIGHT + 4)).groupBy("n").agg(F.countDistinct("sk").alias("m")).collect()}
    parts = shuffle_partitions(spark)
    proposals = _proposals(src.where(F.col("doc_id").isNotNull()), hot, cheapest_boundary(sizes), clashing)
    lists = checkpointed(shared_only(proposals, parts))  # lists with one set only are of no use
    light, heavy = lists.where("light"), lists.where("not light").select("k", "sk", "n", "pos")
    # light: members of one size meet a member of the other size, or, alone, the least of their own
    ends = light.groupBy("k", "pos").agg(F.min(F.struct("n", "sk")).alias("lo"), F.max(F.struct("n", "sk")).alias("hi"))
    tied = light.join(ends, ["k", "pos"])
    other = F.when(F.col("lo.n") == F.col("hi.n"), F.col("lo.sk")).when(F.col("n") == F.col("lo.n"), F.col("hi.sk")).otherwise(F.col("lo.sk"))
    pairs = tied.where((F.col("lo.n") != F.col("hi.n")) | (F.col("pos") >= 2 * F.col("n"))).select("sk", other.alias("other"))
    pairs = pairs.where("sk <> other").select(F.least("sk", "other").alias("a"), F.greatest("sk", "other").alias("b"))
    known = seen.where("kind = 0 and sk is not null and one is not null")
    classes = checkpointed(known.groupBy("sk").agg(F.min("one").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    # documents of several texts tie the classes of these
    several = rows.where(F.col("doc_id").isNotNull() & F.col("sk").isNotNull()).join(classes.select("sk", "rep"), "sk").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links, label = None, None
    fits = (NUMERATOR * F.col("n") <= DENOMINATOR * F.col("m")) & (NUMERATOR * F.col("m") <= DENOMINATOR * F.col("n"))
    open_lists = heavy.withColumn("c", F.col("sk"))
    for turn in range(ROUNDS):
        each = Window.partitionBy("k")
        ranked = open_lists.withColumn("r", F.row_number().over(each.orderBy(F.xxhash64(F.lit(turn), "sk"), "sk")))
        pivots = ranked.where(F.col("r") <= PIVOTS).select("k", F.col("sk").alias("other"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("r").alias("q"))
        met = ranked.join(pivots, "k").where((F.col("r") > F.col("q")) & (F.col("c") != F.col("d")) & fits).select(F.least("sk", "other").alias("a"), F.greatest("sk", "other").alias("b"))
        found = _verified(met if turn else met.unionByName(pairs), src, classes, clashing)
        links = found if links is None else links.unionByName(found)
        label = checkpointed(components(links))
        open_lists = heavy.join(label.select(F.col("node").alias("sk"), "root"), "sk", "left").withColumn("c", F.coalesce("root", "sk")).drop("root")
        open_lists = open_lists.withColumn("_lo", F.min("c").over(each)).withColumn("_hi", F.max("c").over(each)).where("_lo <> _hi").drop("_lo", "_hi")
        open_lists = checkpointed(open_lists)
        size = open_lists.groupBy("k").agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()
        if (size[1] or 0) <= FEW * (size[0] or 0):
            break
    # a small sketch refuses most pairs of a long list before they are written
    open_lists = checkpointed(open_lists.join(classes.select("sk", _small(F.col("sketch")).alias("s")), "sk"))
    left = open_lists.where(F.col("pos") < F.col("n") - F.ceil(2 * NUMERATOR * F.col("n") / (NUMERATOR + DENOMINATOR)) + 1)
    right = open_lists.select("k", F.col("sk").alias("sk2"), F.col("n").alias("m"), F.col("pos").alias("pos2"), F.col("c").alias("d"), F.col("s").alias("s2"))
    room = 1 + F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("pos2")) - 1
    across = left.join(right, "k").where((F.col("c") != F.col("d")) & ((F.col("n") < F.col("m")) | (F.col("n") == F.col("m")) & (F.col("sk") < F.col("sk2"))) & _near("n", "m", "s", "s2") & ((NUMERATOR + DENOMINATOR) * room >= NUMERATOR * (F.col("n") + F.col("m"))))
    found = _verified(across.select(F.least("sk", "sk2").alias("a"), F.greatest("sk", "sk2").alias("b")), src, classes, clashing)
    links = links.unionByName(found)
    named = links.join(classes.select(F.col("sk").alias("a"), F.col("rep").alias("ra")), "a").join(classes.select(F.col("sk").alias("b"), F.col("rep").alias("rb")), "b")
    root = checkpointed(components(named.select(F.col("ra").alias("a"), F.col("rb").alias("b")).unionByName(several)))
    # copies point at their class first, which spreads a large group of them over the tasks
    out = rows.join(classes.select("sk", "rep"), "sk", "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    out = out.join(root.select(F.col("node").alias("rep"), "root"), "rep", "left")
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


#: The same result from its definition: every pair of documents that shares a shingle, and the closure of the links.
ORACLE_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
grams as (select doc_id, len(s) as n, unnest(s) as g from sets),
links as (
  select a.doc_id as x, b.doc_id as y from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach as (select doc_id, doc_id as r from sets union select reach.doc_id, links.y from reach join links on links.x = reach.r)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(reach.r) as component_id from sets s join reach on reach.doc_id = s.doc_id group by s.doc_id, s.s
"""
