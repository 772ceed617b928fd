"""Operators on single rows: BPE, packing, fingerprints, media, language, toxicity."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.llm import bpe, language, lz_fingerprint, media, packing, toxicity

ALPHABET = ["a", "the", "0", "\n", " ", "  ", "\t", "\r\n", "é", "\x1c", "\x85", "\xa0", "²", "¼", "ª", "µ", "ab", "-", "=", "_", "'s", "'", "<|endoftext|>", "\x00", "ɏ", "ſ", "漢", "🙂", "́", "xxxxx", "ǅ", "𝟘", "　"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    tree = bpe.loaded(path, pattern)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=tree.ranks, special_tokens={})


@pytest.mark.parametrize("leaf", [2, 3, 7, 64])
def test_bpe_equals_the_library(reference, leaf):
    tree = bpe.TreeBPE(*bpe.default_vocabulary(), leaf)
    rng = random.Random(leaf)
    samples = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(80))) for _ in range(300)]
    samples += ["".join(rng.choice("abcdehinorst") for _ in range(rng.randrange(300))) for _ in range(100)]
    samples += ["a" * 5000 + "=-" * 900 + "ñ" * 1501, ""]
    for t in samples:
        ids = tree.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert tree.decode(ids) == t.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_of_any_text(t):
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    tree = bpe.loaded(path, pattern)
    got = tree.encode(t)
    assert got == tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=tree.ranks, special_tokens={}).encode_ordinary(t)


def test_bpe_join_is_associative():
    tree = bpe.TreeBPE(*bpe.default_vocabulary(), 4)
    data = b"internationalisation" * 4
    for i in range(1, len(data), 7):
        assert tree.join(tree.halves(data[:i]), tree.halves(data[i:])) == tree.merge(data)


def test_bpe_rows(reference, odd, none):
    out = bpe.encoding_digests(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == sorted(
        (r.doc_id is None, r.doc_id or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect() for ids in [reference.encode_ordinary(r.text or "")]
    )
    assert bpe.encoding_digests(none).count() == 0
    assert {r.doc_id: bytes(r.decoded) for r in bpe.encode_documents(odd).where("doc_id = 9").collect()}[9].decode().endswith("🙂 \x00 end")


def test_packing_ids():
    from tokenizers import Tokenizer

    ids, fresh = packing.Ids(packing.default_vocabulary()), Tokenizer.from_file(packing.default_vocabulary())
    rng = random.Random(2)
    for t in ["a<|endoftext|>b", *("".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(400))]:
        assert ids(t).tolist() == fresh.encode(t, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30), st.integers(1, 12))
def test_packing_plan_holds_everything(histogram, groups):
    bins = packing.plan(histogram, 64, groups)
    held = Counter()
    for b in bins:
        assert sum(length * k for length, k in b.content) == 64 - b.room and b.room >= 0 and b.count > 0
        for length, k in b.content:
            held[length] += k * b.count
    assert held == Counter(histogram)


def test_packing_is_tight():
    rng = random.Random(1)
    histogram = Counter(min(2048, max(1, int(rng.lognormvariate(6.3, 0.9)))) for _ in range(60000))
    used = sum(b.count for b in packing.plan(dict(histogram)))
    assert used <= 1.02 * -(-sum(k * n for k, n in histogram.items()) // 2048)


def checked_packing(rows, texts, capacity=packing.CAPACITY):
    ids = packing.loaded(packing.default_vocabulary())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for d, t in texts:
        whole = np.append(ids(t), np.uint32(0)).astype("<u4")
        first = len(whole) % capacity or min(capacity, len(whole))
        cuts = [0, *range(first, len(whole) + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d, i, a, b - a, zlib.crc32(whole[a:b].tobytes())] += 1
    assert pieces == want


def test_packing_rows(documents, odd, none, texts):
    checked_packing(packing.pack(packing.pieces(documents)).collect(), list(texts.items()))
    checked_packing(packing.pack(packing.pieces(odd)).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.pack(packing.pieces(none)).count() == 0


def test_fingerprints(documents, texts):
    out = {r.doc_id: r for r in lz_fingerprint.neighbours(documents).collect()}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        t, following = texts[d], texts[order[(i + 1) % len(order)]]
        e = lz_fingerprint.edited(t, following)
        r = out[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (lz_fingerprint.fingerprint(t), lz_fingerprint.fingerprint(e))
        assert r.near_next == lz_fingerprint.likeness(lz_fingerprint.signature(t), lz_fingerprint.signature(following))
    long = [r for r in out.values() if r.n_chars > 400]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97


def plain_fingerprint(text):
    """128 minima of the phrases' hashes, each times an odd factor modulo 2**64, 16 bits of each; in plain integers."""
    import xxhash

    symbols = [w[i : i + 12] for w in text.split() for i in range(0, len(w), 12)]
    known, at = set(), 0
    while at < len(symbols):
        n = 1
        while at + n <= len(symbols) and tuple(symbols[at : at + n]) in known:
            n += 1
        if at + n <= len(symbols):
            known.add(tuple(symbols[at : at + n]))
        at += n
    hashes = [xxhash.xxh3_64_intdigest(" ".join(x)) for x in known]
    factors = [int(f) for f in lz_fingerprint._FACTORS]
    return [min((h * f & (1 << 64) - 1 for h in hashes), default=(1 << 64) - 1) >> 8 & 0xFFFF for f in factors]


def test_fingerprints_by_plain_integers(documents, texts):
    out = lz_fingerprint.neighbours(documents).collect()
    order = sorted(texts, reverse=True)
    following = {d: texts[order[(i + 1) % len(order)]] for i, d in enumerate(order)}
    plain = {}
    for r in out:
        t, n = texts[r.doc_id], following[r.doc_id]
        third = len(t) // 3
        e = t[: len(t) - third] + n[:third]
        for x in (t, n, e):
            if x not in plain:
                plain[x] = plain_fingerprint(x)
        assert r.fingerprint == "".join(f"{v:04x}" for v in plain[t]) and r.edited_fingerprint == "".join(f"{v:04x}" for v in plain[e])
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert (r.near_edited, r.near_next) == tuple(sum(a == b for a, b in zip(plain[t], plain[x], strict=True)) / 128 for x in (e, n))


def test_fingerprints_odd(spark, odd, none):
    out = lz_fingerprint.neighbours(odd).collect()
    assert len(out) == odd.count()
    assert len({r.fingerprint for r in out if r.doc_id in (1, 2)}) == 1
    assert lz_fingerprint.neighbours(none).count() == 0
    alone = lz_fingerprint.neighbours(odd.where("doc_id = 7")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"one two tone ").hexdigest()
    assert lz_fingerprint.phrases("a b a b a b") == {"a", "b", "a b"}


def test_media(documents, odd, none, spark, tmp_path):
    for name, df in (("d", documents), ("o", odd), ("n", none)):
        path = str(tmp_path / name)
        media.store(df, path)
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in media.load(spark, path).collect())
        want = Counter()
        for d, t in rows:
            p = media.payload(t)
            recipe = [(x, len(y)) for x, y in media.chunks_of(p)]
            want[(d, len((t or "").encode()), *media._described(p, recipe))] += 1
        assert got == want
        digests = [bytes(r.digest) for r in spark.read.parquet(f"{path}/chunks").collect()]
        assert len(digests) == len(set(digests))


def test_media_payloads_by_definition(odd, documents, spark, tmp_path):
    for name, df in (("o", odd), ("d", documents)):
        path = str(tmp_path / name)
        media.store(df, path)
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            raw = (r.text or "").encode()
            padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
            want[r.doc_id, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])] += 1
        got = media.load(spark, path).collect()
        assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
        alike = defaultdict(set)
        for r in got:
            alike[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
        assert all(len(x) == 1 for x in alike.values())


def test_media_chunks():
    rng = random.Random(4)
    data = rng.randbytes(50000)
    ends = media.cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= media.MOST and sizes[:-1].min() >= media.LEAST
    hashed = media.GEAR if hasattr(media, "GEAR") else media._GEAR
    h, start, want = 0, 0, []
    for i, b in enumerate(data[:20000]):
        h = (h << 1) + int(hashed[b]) & 0xFFFFFFFF
        n = i + 1 - start
        if n == media.MOST or n >= media.LEAST and h >> (32 - media.CUT_BITS) == 0:
            want.append(i + 1)
            start = i + 1
    assert [e for e in ends if e <= want[-1]] == want
    moved = {d for d, _ in media.chunks_of(b"prefix" + data)}
    assert len(moved & {d for d, _ in media.chunks_of(data)}) > 0.8 * len(ends)
    broken = [{"digest": b"\0" * 16, "size": 3, "shared": False}]
    with pytest.raises(ValueError):
        media._whole(broken, b"abc", {})


def test_language(documents, odd, none):
    model = language.fit(documents)
    assert [n for n, _ in model.samples] == ["de", "en", "es", "fr"]
    truth = {r.doc_id: r.lang for r in documents.collect()}
    out = language.predict(documents, model).collect()
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.97
    got = {r.doc_id: r for r in language.predict(odd.where("doc_id is not null"), model).collect()}
    assert all((got[d].lang_pred, got[d].score) == ("und", 0.0) for d in (3, 4, 5))
    assert language.predict(none, model).count() == 0
    assert language.fit(none).samples == () and language.predict(odd, language.fit(none)).where("lang_pred <> 'und'").count() == 0


def brute_phrases(text, sample):
    count = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        count, at = count + 1, at + n
    return count


def test_cross_parsing():
    samples = (("x", "abracadabra abracad"), ("y", "hocus pocus focus"))
    parser = language._Parser(language.LanguageModel(samples))
    for t in ("abrahocus", "cadabra", "pocus abra", "zzz abra", "focuspocus cad"):
        _, got = parser.phrases([t])
        assert got[:, 0].tolist() == [brute_phrases(t, s) for _, s in samples]


def test_cross_parsing_of_long_texts_is_one_parse():
    rng = random.Random(5)
    samples = tuple((n, "".join(rng.choice(a) for _ in range(900)).strip()) for n, a in (("x", "abc "), ("y", "abd "), ("z", "aab")))
    parser = language._Parser(language.LanguageModel(samples))
    texts = ["".join(rng.choice("abcd") for _ in range(n)) for n in (0, 1, 511, 512, 513, 4000, 9001)] + ["a" * 5000, "ab" * 2600, "aabq" * 700]
    _, got = parser.phrases(texts)
    assert got.T.tolist() == [[brute_phrases(t, s) for _, s in samples] for t in texts]


def test_cross_parsing_of_many_letters():
    rng = random.Random(6)
    han = [chr(0x4E00 + i) for i in range(1500)]
    samples = tuple((n, "".join(rng.choice(a) for _ in range(3000))) for n, a in (("l", "abcdefgh"), ("p", han[:900]), ("q", han[600:])))
    parser = language._Parser(language.LanguageModel(samples))
    texts = ["".join(rng.choice(han) for _ in range(700)), samples[1][1][100:2000], samples[2][1][5:900] + "abc" + samples[1][1][:40], "abcÿ" * 300]
    _, got = parser.phrases(texts)
    assert got.T.tolist() == [[brute_phrases(t, s) for _, s in samples] for t in texts]
    assert parser.predict([samples[1][1][50:350], samples[2][1][50:350]])[0] == ["p", "q"]


def brute_segments(scores):
    """Maximal segments by definition: the best one, then the same on both sides of it."""

    def within(a, b):
        best = max(((sum(scores[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        s, _, i, j = max(x for x in ((sum(scores[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)) if x[0] == best[0])
        return [*within(a, i), (i, j, s), *within(j, b)]

    return within(0, len(scores))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=14))
def test_segments(scores):
    got = toxicity.maximal_segments(np.array(scores, float))
    assert sorted(s for *_, s in got) == sorted(s for *_, s in brute_segments(scores))
    assert all(sum(scores[a:b]) == s for a, b, s in got)


def test_toxicity(spark, odd, none):
    from tests.llm.conftest import prose

    rng = random.Random(7)
    bad = ["vilest", "scumlike", "rotten"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        words = prose(i, 80).split()
        if toxic:
            at = rng.randrange(70)
            words[at : at + 3] = rng.choices(bad, k=3)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    documents, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(documents, marks)
    truth = {d: t for d, _, t in labels}
    held = [r for r in toxicity.score(documents, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    text = dict(rows)
    for r in held:
        if r.predicted:
            words = text[r.doc_id].split()
            assert any(w in bad for a, b in r.passages for w in words[a:b])
    out = toxicity.score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in out)
    assert toxicity.score(none, model).count() == 0
    unmarked = toxicity.fit(documents, marks.where("false"))
    assert toxicity.score(odd, unmarked).where("predicted = 1").count() == 0
    assert documents.where(toxicity.probability(documents, model) >= 0.7).count() == toxicity.score(documents, model).where("predicted = 1").count()
    one_sided = toxicity.fit(documents, marks.where("toxic = 0").withColumn("doc_id", F.col("doc_id")))
    assert 0 <= toxicity.score(odd, one_sided).first().score < 0.7


def test_bpe_of_a_text_uses_the_tree(monkeypatch):
    """Words of ordinary length are joined from leaves, to the ids that plain merging gives."""
    tree = bpe.TreeBPE(*bpe.default_vocabulary())
    joined, join = [], tree.join
    monkeypatch.setattr(tree, "join", lambda a, b: joined.append(1) or join(a, b))
    words = [" unfathomably", " Quzzlement", "naïvetés", " 漢字漢字"]
    assert [list(tree.piece(w)) for w in words] == [tree.merge(w.encode()) for w in words]
    assert len(joined) >= len(words)


def test_bpe_keeps_to_its_pattern():
    path, _ = bpe.default_vocabulary()
    assert bpe.TreeBPE(path, r".").words("abc d") == ["a", "b", "c", " ", "d"]
    assert bpe.TreeBPE(path, r"(a)b").words("abab") == ["ab", "ab"]


def test_language_sample_shares():
    got = language._shares(["abc", "x" * 500, "y" * 90, ""], 120)
    assert got[0] == "abc" and sum(map(len, got)) <= 120 and min(len(got[1]), len(got[2])) > 40
