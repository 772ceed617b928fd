"""Byte-level BPE by a monoid tree reduction.

The encoding of a pre-token is an element of a monoid: ``join`` takes the encodings of two neighbouring byte
strings to the encoding of their concatenation.  Halves are encoded recursively; two neighbours are joined by
encoding a window around their boundary anew.  A token list is the encoding of its bytes exactly when every
adjacent pair is stable, i.e. when the concatenated bytes of the pair encode to that pair.  Both lists are
stable already, so the window is the only place where this can fail: it grows, doubling, until the pairs at its
two edges are stable.  Decoding concatenates the tokens' bytes up the same tree.

Defined cases: a null text counts as empty; an empty text has no tokens, the hash of no ids is that of the
empty string; special tokens in a text are ordinary text; of a pattern with groups the whole match is taken, and
characters that it does not match are left out; repeated rows and rows with a null key are encoded each; columns other
than the key and the text are not read; a text of any length is encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm._common import map_text, resident, table

#: Longest byte string that is encoded at once; longer ones are halved.
LEAF = 4
#: Bytes of pre-tokens, and short byte strings, that a worker remembers before it forgets all of them.
CACHE_BYTES = 64 << 20
WINDOWS = 150_000
#: Longest byte string whose encoding is remembered by itself.
WINDOW = 12
#: What an entry takes beside its text.
_ENTRY = 200


def _latin_pattern() -> re.Pattern:
    """The pre-token pattern of the GPT-2 family for texts whose code points are all below U+0250."""
    kinds = {k: "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == k) for k in "LN"}
    letters, numbers = kinds["L"], kinds["N"]
    # \s of a str pattern also takes U+001C..U+001F, which the Unicode property White_Space does not have
    space = r"\t\n\x0b\x0c\r \x85\xa0"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


class TreeBPE:
    """Encoder and decoder for a file of ranks (base64 of a token, its rank)."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.leaf = max(2, leaf)
        self.pattern = regex.compile(pattern)
        self.latin = _latin_pattern() if pattern == default_vocabulary()[1] else None
        self.beyond = re.compile("[^\x00-ɏ]")
        self.held = 0
        self.cache: dict[str, tuple[int, ...]] = {}
        self.shown: dict[str, str] = {}
        self.windows: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Plain BPE of a short byte string: merge the lowest rank, leftmost first."""
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = ranks.get
        near = [get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
        while near:
            low = min(near)
            if low == 1 << 60:
                break
            i = near.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del near[i]
            if i:
                near[i - 1] = get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(near):
                near[i] = get(parts[i] + parts[i + 1], 1 << 60)
        return [ranks[p] for p in parts]

    def window(self, piece: bytes) -> list[int]:
        """``merge`` of what may well come again."""
        known = self.windows.get(piece)
        if known is None:
            known = self.merge(piece)
            if len(piece) <= WINDOW:
                if len(self.windows) > WINDOWS:
                    self.windows.clear()
                self.windows[piece] = known
        return known

    def stable(self, a: int, b: int) -> bool:
        """Whether the pair stays as it is when its bytes are encoded together."""
        return self.window(self.tokens[a] + self.tokens[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's product: the encoding of the concatenation of what both lists encode."""
        if not left or not right:
            return left or right
        k, tokens = 1, self.tokens
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            middle = self.window(b"".join([tokens[t] for t in left[i:]] + [tokens[t] for t in right[:j]]))
            if (i == 0 or self.stable(left[i - 1], middle[0])) and (j == len(right) or self.stable(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            k *= 2

    def halves(self, piece: bytes) -> list[int]:
        """The tree, bottom up, so that no text is too long for the stack."""
        level = [self.window(piece[i : i + self.leaf]) for i in range(0, len(piece), self.leaf)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def piece(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        return tuple(self.merge(raw) if len(raw) <= self.leaf else self.halves(raw))

    def words(self, text: str) -> list[str]:
        if self.latin is None or self.beyond.search(text):
            return [m.group() for m in self.pattern.finditer(text)]
        return self.latin.findall(text)

    def known(self, words: list[str]) -> None:
        cache = self.cache
        if self.held > CACHE_BYTES:
            cache.clear()
            self.shown.clear()
            self.held = 0
        for w in set(words).difference(cache):
            cache[w] = ids = self.piece(w)
            self.shown[w] = ",".join(map(str, ids))
            self.held += _ENTRY + 16 * len(w)

    def encode(self, text: str | None) -> list[int]:
        words = self.words(text or "")
        self.known(words)
        return list(chain.from_iterable(map(self.cache.__getitem__, words)))

    def encode_shown(self, text: str | None) -> tuple[list[int], str]:
        """The ids, and the same in decimal, joined by commas."""
        words = self.words(text or "")
        self.known(words)
        return list(chain.from_iterable(map(self.cache.__getitem__, words))), ",".join(map(self.shown.__getitem__, words))

    def decode(self, ids: list[int]) -> bytes:
        level = [b"".join(map(self.tokens.__getitem__, ids[i : i + 4096])) for i in range(0, len(ids), 4096)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


def loaded(path: str, pattern: str) -> TreeBPE:
    """One encoder for each worker process and vocabulary."""
    return resident(("bpe", path, pattern), lambda: TreeBPE(path, pattern))


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids array<int>, decoded binary) for every row; other columns are not read. Null texts are empty."""
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(path, pattern)
        ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.binary())], names=["key", "ids", "decoded"])

    src = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return map_text(src, "text", run, "key long, ids array<int>, decoded binary", keeps=True).withColumnRenamed("key", key)


def encoding_digests(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) for every row, by the same encoder; the ids do not leave the worker."""
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(path, pattern)
        n, shown, decoded = [], [], []
        for t in batch.column(1).to_pylist():
            ids, joined = bpe.encode_shown(t)
            n.append(len(ids))
            shown.append(hashlib.sha256(joined.encode()).hexdigest())
            decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(shown, pa.string()), pa.array(decoded, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return map_text(src, "text", run, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string", keeps=True).withColumnRenamed("key", key)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"))
