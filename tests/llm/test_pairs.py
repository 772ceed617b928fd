"""Line dedup, n-gram join and components against brute force."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strata.llm import _graph, line_dedup, ngram_join
from strata.llm._common import bitmap_filter, in_bitmap, shared_only
from strata.llm._graph import components


def find(parent, x):
    while parent.setdefault(x, x) != x:
        x = parent[x]
    return x


def unite(parent, a, b):
    a, b = find(parent, a), find(parent, b)
    parent[max(a, b)] = min(a, b)


@pytest.mark.parametrize("held", [7, 200_000])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr(_graph, "EDGES", held)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(i, i + 1) for i in range(500, 560)] + [(900, i) for i in range(800, 890)]
    parent = {}
    for a, b in edges:
        if a != b:
            unite(parent, a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(parent, x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_only(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rng = random.Random(5)
        rows = [(rng.randrange(60), rng.randrange(3)) for _ in range(150)] + [(1000, 7)] * 9 + [(2000, 1), (2000, 2)] * 5
        groups = defaultdict(set)
        for k, m in rows:
            groups[k].add(m)
        got = shared_only(spark.createDataFrame(rows, "k long, sk long"), 3).collect()
        assert sorted(map(tuple, got)) == sorted((k, m) for k, v in groups.items() if len(v) > 1 for m in v)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bitmap(spark):
    import numpy as np

    values = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 500)
    bits = bitmap_filter(spark.createDataFrame([(int(v),) for v in values], "x long"), "x")
    assert in_bitmap(bits, values.view(np.uint64)).all()
    assert in_bitmap(bits, np.arange(1, 5000, dtype=np.uint64) * np.uint64(987654321987)).mean() < 0.01


def brute_links(rows):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    parent, sets = {}, []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append((i, frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
        if i is not None:
            find(parent, i)
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and i != j and 100 * len(a & b) >= 80 * len(a | b):
                unite(parent, i, j)
    return sorted(((i, len(s), None if i is None else find(parent, i)) for i, s in sets), key=repr)


def shown(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_ngram_join(spark, documents, odd, none):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert shown(ngram_join.link(documents)) == brute_links(rows)
    assert shown(ngram_join.link(odd)) == brute_links([(r.doc_id, r.text) for r in odd.collect()])
    assert ngram_join.link(none).count() == 0


def test_ngram_join_of_many_sizes(spark, monkeypatch):
    """Short sets on both sides of the boundary, and a group whose members link only in chains."""
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    rng = random.Random(9)
    rows, words = [], [f"w{i}" for i in range(400)]
    for n in range(1, 26):
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(n)] = rng.choice(words)
            rows.append(copy)
    base = [rng.choice(words) for _ in range(200)]
    for i in range(60):
        copy = list(base)
        copy[3 * i : 3 * i + 3] = [f"x{i}a", f"x{i}b", f"x{i}c"]
        rows.append(copy)
        rows.append(copy[:150] + [rng.choice(words) for _ in range(rng.randrange(60))])
    rng.shuffle(rows)
    data = [(i, " ".join(r)) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert shown(ngram_join.link(df)) == brute_links(data)


def test_boundary_costs():
    assert ngram_join.cheapest_boundary({}) == 0
    assert ngram_join.subsets_of(5) == 7 and ngram_join.least_overlap(10, 10) == 9
    many = ngram_join.cheapest_boundary({n: 100 for n in range(1, 17)})
    assert 1 <= many <= ngram_join.LARGEST_LIGHT


def brute_lines(rows):
    occurrences = defaultdict(list)
    for o, i, t in rows:
        for j, line in enumerate((t or "").split("\n")):
            if t is not None and len(line) >= line_dedup.LEAST:
                occurrences[line].append((o, i, j))
    lines = list(occurrences)
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} for x in lines]
    parent = {}
    for i, a in enumerate(sets):
        find(parent, i)
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                unite(parent, i, j)
    groups = defaultdict(set)
    for i, line in enumerate(lines):
        groups[find(parent, i)] |= set(occurrences[line])
    return {x for g in groups.values() for x in g if x != min(g)}


def test_line_dedup(spark, documents):
    some = documents.where("doc_id < 70").select("doc_id", "text")
    got = {(r.doc_id, r.doc_id, j) for r in line_dedup.dedup(some).collect() for j in r.dropped}
    want = brute_lines([(r.doc_id, r.doc_id, r.text) for r in some.collect()])
    assert len(got ^ want) <= 0.02 * len(want)
    for r in line_dedup.dedup(some.withColumn("was", F.col("text"))).collect():
        assert r.text == "\n".join(x for j, x in enumerate(r.was.split("\n")) if j not in r.dropped)


def test_line_dedup_odd(odd, none):
    out = line_dedup.dedup(odd).collect()
    assert len(out) == odd.count() and "rep" in out[0].asDict()
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert [r.dropped for r in by[1]] == [[], []]  # the same id and text is one document
    assert by[2][0].text == "" and by[2][0].dropped == [0]
    assert by[3][0].text is None and by[3][0].n_lines == 0
    assert by[4][0].text == "" and by[10][0].dropped == [1, 2]
    assert line_dedup.dedup(none).count() == 0


def brute_lines_of_all_lengths(rows):
    occurrences = defaultdict(list)
    for o, i, t in rows:
        for j, line in enumerate((t or "").split("\n")):
            if len(line) >= 20 or line.strip("\t\n\v\f\r "):
                occurrences[line].append((o, i, j))
    sets = {x: {x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in occurrences}
    lines, parent = list(occurrences), {}
    for i, a in enumerate(lines):
        find(parent, i)
        for j in range(i):
            b = lines[j]
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                unite(parent, i, j)
    groups = defaultdict(set)
    for i, line in enumerate(lines):
        groups[find(parent, i)] |= set(occurrences[line])
    return {x for g in groups.values() for x in g if x != min(g)}


def test_line_dedup_of_all_lengths(spark, documents):
    """Short lines repeat as others do; blank ones stay."""
    some = documents.where("doc_id < 70").select("doc_id", "text")
    extra = [(1000, "And.\n\nAnd.\n }\n  \n漢字漢字\nabcdefghijklmno"), (1001, " }\n\n漢字漢字\nabcdefghijklmnop\nabcdefg\n}\n  \nown text"), (1002, "}\n\nabcdefg\nabcdefgh")]
    some = some.unionByName(spark.createDataFrame(extra, some.schema)).cache()
    rows = line_dedup.dedup(some, short=True).collect()
    got = {(r.doc_id, r.doc_id, j) for r in rows for j in r.dropped}
    want = brute_lines_of_all_lengths([(r.doc_id, r.doc_id, r.text) for r in some.collect()])
    assert len(got ^ want) <= 0.02 * len(want)
    texts = {r.doc_id: r.text.split("\n") for r in some.where("text is not null").collect()}
    assert all(len(texts[x[0]][x[2]]) >= 8 for x in got ^ want)  # exact repeats depend on no bands
    by = {r.doc_id: r for r in rows}
    assert set(by[1001].dropped) >= {0, 2} and 1 not in by[1001].dropped and 6 not in by[1001].dropped
    assert by[1002].dropped == [0, 2] and by[1002].text == "\nabcdefgh"


def test_query_drops_short_repeats(spark, tmp_path):
    rows = [(1, "And.\nfirst"), (2, "And.\nsecond\n\n\nAnd.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: (r.n_lines, r.n_kept, r.dropped, r.text) for r in line_dedup.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert out == {1: (2, 2, [], "And.\nfirst"), 2: (5, 3, [0, 4], "second\n\n")}


def test_bands_miss_few_pairs():
    """At the threshold fewer than 6 pairs of 1,000 may meet in no band."""
    assert (1 - line_dedup.THRESHOLD**line_dedup.ROWS) ** line_dedup.BANDS < 0.006


def twisted(n, a, b):
    """A word in which sums of powers modulo 2**64 vanish against the same with its letters exchanged."""
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_long_twisted_words(spark):
    rows = [(1, twisted(1024, "a", "b")), (2, twisted(1024, "b", "a"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert shown(ngram_join.link(df)) == [(1, 1, 1), (2, 1, 2)]
    words = [twisted(64, "a", "b"), twisted(64, "b", "a"), "short", "x" * 33, "x" * 34]
    import pyarrow as pa

    assert len({int(s[0]) for s in ngram_join.shingle_sets(pa.array(words))}) == len(words)
    lines = line_dedup.Lines(pa.array(["\n".join(words)]), True)
    assert len(set(zip(lines.key.tolist(), lines.check.tolist(), strict=True))) == len(words)


def test_sets_that_share_a_key():
    import numpy as np

    a, b = np.array([3, 9], np.uint64), np.array([4, 9], np.uint64)
    clashing = frozenset({ngram_join.first_key(a)})
    assert ngram_join.set_key(a, clashing) == ngram_join.second_key(a) != ngram_join.first_key(a)
    assert ngram_join.set_key(b, clashing) == ngram_join.first_key(b)


def test_sketches_by_blocks():
    """Many short lines: sizes and parities as from the sets."""
    import pyarrow as pa

    rng = random.Random(6)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(8, 40))) + "." for _ in range(450)]
    lines = line_dedup.Lines(pa.array(["\n".join(texts)]), True).shingled()
    sizes, words = lines.sketches()
    assert sizes.tolist() == [len({lines.text(i)[j : j + 8] for j in range(len(lines.text(i)) - 7)}) for i in range(len(lines.key))]
    assert words.shape == (len(lines.key), line_dedup.SKETCH // 64)
