"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds every substring of a sample of labelled text.  A document is parsed
greedily against it: each phrase is the longest match from where the last phrase ended.  Text of the sample's
language needs few, long phrases; ``phrases * log2(sample length)`` estimates the cross entropy, and the language
that needs the fewest bits wins (ties: the first by name).

The automata are unrolled into transition tables in which a failed match leads on from the root and carries a mark,
so that parsing is one table look-up a character and all blocks of a batch step together in numpy.  Documents are
parsed whole, in blocks of ``BLOCK`` characters. The state at a block's start is guessed by parsing the ``WARM``
characters before it; where the block before ends in another state, the block is parsed again from that one, so the
phrases are those of one parse from the text's start.  Every letter of the samples is a symbol of its own; the commonest
have a column of the tables (``COLUMNS``, a matter of layout alone), the others are found by binary search.

Learning is from at most ``SAMPLE_TEXTS`` different texts of a language, those with the smallest hashes in
``BUCKETS`` buckets, and at most
``SAMPLE_CHARS`` normalised characters of them (fewer if there are so many languages that the tables would pass
``TABLE_CHARS`` together), shared evenly by all these texts; of a long text a window at a hashed place is taken.  Normalised: lower case, every run of non-letters one space.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows without ``lang`` or ``doc_id`` are
not learnt from; with nothing to learn from every row is ``und``; repeated rows are predicted each; texts of any
length are parsed whole; columns other than those named are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm._common import in_training, map_text, resident, table

SAMPLE_TEXTS = 96
BUCKETS = 32
SAMPLE_CHARS = 1 << 15
TABLE_CHARS = 1 << 18
COLUMNS = 98
BLOCK = 512
WARM = 64
_MARK = 1 << 30
_UNKNOWN = 1


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the root."""
    move: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = new
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return move


def normalise(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


@dataclass(frozen=True)
class LanguageModel:
    """Sample text of each language, in order of the names."""

    samples: tuple[tuple[str, str], ...]


class _Parser:
    """The automata of a model as tables, built once in each worker.

    A symbol is 0 for white space, 1 for a letter of no sample, else the rank of a letter by its frequency. Symbols below
    ``width`` have a column in the tables; the others are looked up in a sorted list of (state, symbol).
    """

    def __init__(self, model: LanguageModel) -> None:
        count: dict[str, int] = {}
        for _, text in model.samples:
            for c in text:
                count[c] = count.get(c, 0) + 1
        count.pop(" ", None)
        chars = sorted(count, key=lambda c: (-count[c], c))
        self.names = [name for name, _ in model.samples]
        self.total = len(chars) + 2
        self.width = min(self.total, COLUMNS)
        letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.lookup = np.where(letters, _UNKNOWN, 0).astype(np.min_scalar_type(self.total))
        self.lookup[[ord(c) for c in chars]] = np.arange(2, self.total)
        self.tables, self.sparse, self.bits = [], [], []
        for _, text in model.samples:
            symbols = self.lookup[np.frombuffer(text.encode("utf-32-le"), np.uint32)].tolist()
            move = suffix_automaton(symbols)
            root = np.full(self.total, _MARK, np.int32)
            for c, target in move[0].items():
                root[c] = target * self.width | _MARK
            t = np.tile(root[: self.width], (len(move), 1))  # from the root every symbol begins a phrase
            rare = []
            for state, targets in enumerate(move[1:], 1):
                for c, target in targets.items():
                    if c < self.width:
                        t[state, c] = target * self.width
                    else:
                        rare.append((state * self.width * self.total + c, target * self.width))
            rare.sort()
            self.tables.append(t.ravel())
            self.sparse.append((root, np.array([k for k, _ in rare], np.int64), np.array([v for _, v in rare], np.int32)))
            self.bits.append(math.log2(max(2, len(symbols))))

    def _rare(self, k: int, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The moves by symbols that have no column."""
        root, keys, targets = self.sparse[k]
        out = root[symbol]
        if len(keys):
            sought = state.astype(np.int64) * self.total + symbol
            place = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
            out = np.where(keys[place] == sought, targets[place], out)
        return out

    def _walk(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray, which: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases begun in each block, state after it) for the languages ``which``; ``before``: the states at its start."""
        order = np.argsort(-size, kind="stable")
        at, left = start[order], -size[order]
        state = before[:, order]
        marks = np.zeros_like(state)
        for step in range(int(-left[0]) if len(left) else 0):
            n = int(np.searchsorted(left, -step))  # blocks that are longer
            row = symbols[at[:n] + step]
            rare = np.flatnonzero(row >= self.width) if self.total > self.width else row[:0]
            column = np.where(row < self.width, row, _UNKNOWN) if len(rare) else row
            for i, k in enumerate(which):
                got = self.tables[k][state[i, :n] + column]
                if len(rare):
                    got[rare] = self._rare(k, state[i, rare], row[rare])
                marks[i, :n] += got >> 30
                state[i, :n] = got & (_MARK - 1)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return marks[:, back], state[:, back]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(letters of each text, phrases of each text by language)."""
        lows = [t.lower() for t in texts]
        sizes = np.array([len(t) for t in lows], np.int64)
        symbols = self.lookup[np.frombuffer("".join(lows).encode("utf-32-le", "surrogatepass"), np.uint32)]
        doc = np.repeat(np.arange(len(texts)), sizes)
        letters = np.bincount(doc[symbols > 0], minlength=len(texts))
        same = np.zeros(len(symbols), bool)
        same[1:] = (symbols[1:] == 0) & (symbols[:-1] == 0) & (doc[1:] == doc[:-1])
        symbols, doc = symbols[~same], doc[~same]
        sizes = np.bincount(doc, minlength=len(texts))
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        number = np.arange(len(owner)) - (np.cumsum(blocks) - blocks)[owner]
        start = (np.cumsum(sizes) - sizes)[owner] + number * BLOCK
        size = np.minimum(BLOCK, sizes[owner] - number * BLOCK)
        langs = list(range(len(self.names)))
        later = np.flatnonzero(number)
        before = np.zeros((len(langs), len(owner)), np.int32)
        _, before[:, later] = self._walk(symbols, start[later] - WARM, np.full(len(later), WARM), before[:, later], langs)
        marks, after = self._walk(symbols, start, size, before, langs)
        for k in langs:
            while len(wrong := later[after[k, later - 1] != before[k, later]]):
                # the first wrong block of each text, as all before it are right
                wrong = wrong[np.concatenate(([True], owner[wrong[1:]] != owner[wrong[:-1]]))]
                before[k, wrong] = after[k, wrong - 1]
                got, end = self._walk(symbols, start[wrong], size[wrong], before[k : k + 1, wrong], [k])
                marks[k, wrong], after[k, wrong] = got[0], end[0]
        return letters, np.stack([np.bincount(owner, weights=marks[k], minlength=len(texts)) for k in langs])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        letters, phrases = self.phrases([t or "" for t in texts])
        bits = phrases * np.array(self.bits)[:, None]
        order = np.argsort(bits, axis=0, kind="stable")
        best = bits[order[0], np.arange(len(texts))]
        second = bits[order[1], np.arange(len(texts))] if len(self.names) > 1 else best * 0
        sure = np.where(best + second > 0, second / np.maximum(best + second, 1e-9), 0.5) if len(self.names) > 1 else np.ones(len(texts))
        names = [self.names[i] if n else "und" for i, n in zip(order[0].tolist(), letters.tolist(), strict=True)]
        return names, [float(s) if n else 0.0 for s, n in zip(sure, letters, strict=True)]


def _parser(model: LanguageModel) -> _Parser:
    return resident(("language", model), lambda: _Parser(model))


def _shares(texts: list[str], budget: int) -> list[str]:
    """Of each text as much as its share of the budget, what short texts leave going to longer ones; from its middle."""
    out, left = {}, budget
    for n, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        share = left // (len(texts) - n)
        take = min(len(texts[i]), max(0, share - 1))
        start = (len(texts[i]) - take) // 2
        out[i] = texts[i][start : start + take]
        left -= take + 1
    return [out[i] for i in range(len(texts)) if out[i]]


def fit(documents: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> LanguageModel:
    spark = documents.sparkSession
    src = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    src = src.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & in_training())
    # different texts, without moving any text: copies share a hash
    different = src.select("lang", F.xxhash64("text").alias("h"), "doc_id").groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id"))
    # the smallest hashes of each of many buckets, so that no task sees all of a frequent language
    each = Window.partitionBy("lang", F.pmod("h", F.lit(BUCKETS))).orderBy("h", "doc_id")
    chosen = different.withColumn("_rank", F.row_number().over(each)).where(F.col("_rank") <= max(1, sample_texts // BUCKETS)).select("lang", "doc_id", "h")
    picked = [(r.doc_id, r.lang, r.h) for r in chosen.collect()]  # at most sample_texts a language
    if not picked:
        return LanguageModel(())
    ids = F.broadcast(spark.createDataFrame(picked, "doc_id long, lang string, h long"))
    names = sorted({lang for _, lang, _ in picked})
    budget = min(sample_chars, max(1024, TABLE_CHARS // len(names)))
    # of a training text a window at a place that its hash says, so that all parts of texts are learnt from alike
    wide = F.lit(4 * budget)
    at = 1 + F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.length("text") - wide + 1)).cast("int")
    rows = src.withColumn("h", F.xxhash64("text")).join(ids, ["doc_id", "lang", "h"]).select("lang", "h", "doc_id", F.substring(F.col("text"), at, wide).alias("text")).dropDuplicates(["lang", "h"]).collect()
    samples = []
    for name in names:
        texts = [normalise(r.text) for r in sorted((r for r in rows if r.lang == name), key=lambda r: (r.h, r.doc_id))]
        text = " ".join(_shares(texts, budget))[:budget]
        if text.strip():
            samples.append((name, text))
    return LanguageModel(tuple(samples))


def predict(documents: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) for every row; the score is the second best's share of the best two's bits, 0.5 to 1."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        names, scores = _parser(model).predict(texts) if model.samples else (["und"] * len(texts), [0.0] * len(texts))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["key", "lang_pred", "score"])

    src = documents.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return map_text(src, "text", run, "key long, lang_pred string, score double", keeps=True).withColumnRenamed("key", key)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return predict(documents, fit(documents)).select("doc_id", (~in_training()).alias("held_out"), "lang_pred", "score")
