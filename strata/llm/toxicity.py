"""Toxicity by maximal scoring segments.

A word's score is its log-odds between toxic and clean training documents.  Words are seen as chains of prefixes
(3 letters, 4, 5, ... and the whole word), and each link has a Dirichlet prior of ``PRIOR`` documents spread as its
parent's odds say; a link with under ``MIN_DOCUMENTS`` documents inherits.  So an unseen ending is judged by its stem,
and a harmless word is not judged by a toxic one with the same stem.  Log-odds under ``MIN_ODDS`` do not count.
All other words cost ``GAP``.  A linear scan finds all maximal
scoring segments of a document.  Under clean text a segment's score S has an extreme-value law: with lambda from
sum p_i exp(lambda s_i) = 1 and n words, lambda*S - ln(n) is its significance in nats; segments above
``SIGNIFICANT`` are toxic passages, and a logistic curve through their sum (or the best one's shortfall), fitted on training
documents that the log-odds were not learnt from, gives the score.

The classifier is fitted on at most ``PER_CLASS`` labelled documents of each class, those with the smallest hashes
of their ids; documents alike in a min-hash of word shingles share one unit of weight, so that copies count once.
Counts of labels cover all labelled training rows.

Defined cases: null and empty texts score as texts without a toxic passage; rows with a null ``doc_id`` are never
learnt from and are scored as held out; a document with several labels counts as toxic if one of them says so;
with no training document of one class the score is the share of toxic labels; repeated rows are scored each, and
several texts of a labelled id are learnt from as they stand; columns other than the id and the text are not read; texts
of any length are scored whole; empty tables give a model that rejects nothing, or an empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm._common import SMALL_SLICE, give_back, in_training, map_text, slices, small_batches, table, tidy

PER_CLASS = 8_000
PRIOR = 20.0
MIN_ODDS = 1.0
MIN_DOCUMENTS = 6
LONGEST = 8
GAP = 0.1
SIGNIFICANT = 0.0
REJECT = 0.7
_WORD = re.compile(r"[^\W\d_]+")
#: Words that a worker remembers before it forgets all of them.
_CACHE = 60_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def chain_of(word: str) -> list[str]:
    """Prefixes of growing length, and the whole word, marked by its end."""
    return [*(word[:n] for n in range(3, min(len(word), LONGEST) + 1)), word + "$"]


@dataclass
class ToxicityModel:
    """Scores of features; decay of clean scores; calibration weights (bias, shortfall of the best, sum of all)."""

    scores: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def __post_init__(self) -> None:
        self.cache: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def word_scores(self, words: list[str]) -> np.ndarray:
        cache, scores = self.cache, self.scores
        if len(cache) > _CACHE:
            cache.clear()
        for w in set(words).difference(cache):
            best = next((scores[f] for f in reversed(chain_of(w)) if f in scores), 0.0)
            cache[w] = best if best >= MIN_ODDS else -GAP
        return np.fromiter(map(cache.__getitem__, words), np.float64, len(words))

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """All maximal segments: (first word, word after the last, significance in nats), in order."""
        if not words:
            return []
        cost = math.log(len(words))
        return [(a, b, self.decay * s - cost) for a, b, s in maximal_segments(self.word_scores(words))]

    def evidence(self, segments: list[tuple[int, int, float]]) -> tuple[float, float]:
        """How far the best segment stays below significance, and the sum of all that are above."""
        best = max((s for *_, s in segments), default=-20.0)
        return max(-20.0, min(0.0, best)), math.log1p(sum(s for *_, s in segments if s > SIGNIFICANT))

    def probability(self, evidence: tuple[float, float]) -> float:
        x = self.weights[0] + self.weights[1] * evidence[0] + self.weights[2] * evidence[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time; runs of negative scores are stepped over."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, previous with a smaller sum before
    for p in positive.tolist():
        start, end, left, right = p, p + 1, float(sums[p]), float(sums[p + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((start, end, left, right, j))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - x) for a, b, x, r, _ in stack]


def _decay(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum p_i exp(x s_i) = 1 for scores with a negative mean."""
    low, high = 1e-3, 20.0
    total = weights.sum()
    if float((scores * weights).sum()) >= 0:
        return low
    for _ in range(60):
        mid = (low + high) / 2
        if float((weights * np.exp(np.minimum(mid * scores, 50))).sum()) > total:
            high = mid
        else:
            low = mid
    return low


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - ridge * beta
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def log_odds(counts: dict[str, tuple[float, float]], clean: float, toxic: float) -> dict[str, float]:
    """Log-odds of the links (clean and toxic documents with each); only those that can decide a word's score."""
    base = math.log(toxic / clean)
    odds: dict[str, float] = {}
    parent: dict[str, str | None] = {}
    for f in sorted(counts, key=lambda f: len(f)):
        stem = f[:-1] if not f.endswith("$") else f[:-1][:LONGEST]
        while len(stem) >= 3 and stem not in odds:
            stem = stem[:-1]
        parent[f] = stem if stem in odds else None
        prior = math.exp(odds.get(stem, 0.0) + base)
        c, t = counts[f]
        odds[f] = math.log((t + PRIOR * prior / (1 + prior)) / (c + PRIOR / (1 + prior))) - base
    return {f: x for f, x in odds.items() if x >= MIN_ODDS or (parent[f] is not None and odds[parent[f]] >= MIN_ODDS)}


def _shingle_key(words: list[str]) -> int:
    """One min-hash of five-word shingles: copies mostly share it."""
    import xxhash

    return min((xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0) >> 1


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    spark = documents.sparkSession
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & in_training()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return ToxicityModel(weights=(math.log(1e-3), 0.0, 0.0))
    order = F.xxhash64("doc_id")
    chosen = [r for side in (0, 1) for r in marks.where(F.col("toxic") == side).withColumn("_order", order).orderBy("_order", "doc_id").limit(per_class).collect()]
    side_of = {int(r.doc_id): int(r.toxic) for r in chosen}  # at most 2 * per_class
    known = spark.createDataFrame([(k, v) for k, v in side_of.items()], "doc_id long, toxic int")
    sample = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [_shingle_key(words_of(t)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], names=["doc_id", "k"])

    keyed = map_text(sample.select("doc_id", "text"), "text", keys, "doc_id long, k long").groupBy("doc_id").agg(F.min("k").alias("k"))
    key_of = {int(r.doc_id): int(r.k) for r in keyed.collect()}  # at most 2 * per_class, however often an id stands there
    size: dict[tuple[int, int], int] = defaultdict(int)
    for d, k in key_of.items():
        size[k, side_of[d]] += 1
    weight = {d: 1 / size[k, side_of[d]] for d, k in key_of.items()}
    # copies of one text stay on one side of the split, or calibration would see what the log-odds were learnt from
    held = {d for d, k in key_of.items() if k % 4 == 0}
    facts = spark.sparkContext.broadcast({d: (side_of[d], weight[d], d in held) for d in key_of})  # at most 2 * per_class

    def count(batches):
        for batch in slices(batches, "text", SMALL_SLICE):
            sums: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0, 0])
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                side, w, out = facts.value[d]
                if not out:
                    for f in {f for x in set(words_of(t)) for f in chain_of(x)}:
                        s = sums[f]
                        s[side] += w
                        s[2] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array([s[i] for s in sums.values()], pa.float64()) for i in (0, 1)), pa.array([s[2] for s in sums.values()], pa.int64())], names=["f", "clean", "toxic", "n"])

    counts = sample.select("doc_id", "text").mapInArrow(tidy(count), "f string, clean double, toxic double, n long").groupBy("f").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"), F.sum("n").alias("n"))
    learnt = [d for d in key_of if d not in held]
    n = [max(1e-9, sum(weight[d] for d in learnt if side_of[d] == side)) for side in (0, 1)]
    seen_often = counts.where(F.col("n") >= MIN_DOCUMENTS).toArrow()  # of the bounded sample
    model = ToxicityModel(log_odds(dict(zip(seen_often["f"].to_pylist(), zip(seen_often["c"].to_pylist(), seen_often["t"].to_pylist(), strict=True), strict=True)), n[0], n[1]))
    del seen_often
    # what clean training words score gives the decay; then calibration on the held part
    shared = spark.sparkContext.broadcast(model)

    def clean_scores(batches):
        for batch in slices(batches, "text", SMALL_SLICE):
            sums: dict[float, float] = defaultdict(float)
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                side, w, out = facts.value[d]
                if side == 0 and out:
                    got, k = np.unique(np.round(shared.value.word_scores(words_of(t)), 2), return_counts=True)
                    for s, m in zip(got.tolist(), k.tolist(), strict=True):
                        sums[s] += w * m
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.float64()), pa.array(list(sums.values()), pa.float64())], names=["s", "w"])

    spread = sample.select("doc_id", "text").mapInArrow(tidy(clean_scores), "s double, w double").groupBy("s").agg(F.sum("w").alias("w")).collect()
    if spread:
        s, w = np.array([r.s for r in spread]), np.array([r.w for r in spread])
        top = max(model.scores.values(), default=1.0)
        model.decay = _decay(np.append(s, top), np.append(w, 1.0))
    shared = spark.sparkContext.broadcast(model)

    def evidence(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        got = [m.evidence(m.segments(words_of(t))) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "a", "b"])

    shown = map_text(sample.select("doc_id", "text"), "text", evidence, "doc_id long, a double, b double").groupBy("doc_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    seen = [r for r in shown.collect() if r.doc_id in held]  # at most 2 * per_class
    picked = {side: sum(v == side for v in side_of.values()) for side in (0, 1)}
    if len({side_of[r.doc_id] for r in seen}) == 2:
        x = np.array([[1.0, r.a, r.b] for r in seen])
        y = np.array([float(side_of[r.doc_id]) for r in seen])
        w = np.array([weight[r.doc_id] * totals[side_of[r.doc_id]] / picked[side_of[r.doc_id]] for r in seen])
        model.weights = tuple(float(b) for b in _logistic(x, y, w * len(w) / w.sum()))
    else:
        share = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
        model.weights = (math.log(share / (1 - share)), 0.0, 0.0)
    return model


def score(documents: DataFrame, model: ToxicityModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score, predicted, n_passages, passages) for every row; passages are [first word, word after the last]."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        scores, found = [], []
        for t in batch.column(1).to_pylist():
            segments = m.segments(words_of(t))
            scores.append(m.probability(m.evidence(segments)))
            found.append([[a, b] for a, b, sig in segments if sig > SIGNIFICANT])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= REJECT) for s in scores], pa.int32()), pa.array([len(f) for f in found], pa.int32()), pa.array(found, pa.list_(pa.list_(pa.int32())))], names=["key", "score", "predicted", "n_passages", "passages"])

    src = documents.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return map_text(src, "text", run, "key long, score double, predicted int, n_passages int, passages array<array<int>>").withColumnRenamed("key", key)


def probability(documents: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    """The score as a column, for filters that keep all other columns where they are."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            yield pd.Series([m.probability(m.evidence(m.segments(words_of(t)))) for t in texts], dtype="float64")
        m.cache.clear()
        give_back()

    return of(F.col(text).cast("string"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"))
    return score(documents, model).select("doc_id", (~in_training()).alias("held_out"), "score", "predicted", "n_passages", "passages")
