"""The two operators in DataFrame expressions: secrets and licences; and the pipeline."""

import base64
import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from strata.llm import licenses, secrets
from tests.llm.conftest import prose

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def test_secrets_base(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in secrets.op2_randomness_battery(spark, sf_dir).collect():
        want = base_spans(texts[r.doc_id])
        shown = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in want) for x in range(3))


def test_secrets_method(spark, odd, none):
    rng = random.Random(4)
    letters = string.ascii_letters + string.digits
    makers = [
        lambda: "".join(rng.choice(letters) for _ in range(40)),
        lambda: base64.b64encode(rng.randbytes(36)).decode(),
        lambda: "abcdefghijklmnopqrstuvwxyz0123",
        lambda: "thisisaverylongidentifiernameforatest",
        lambda: "some_module_name-with-many-parts_and_words",
        lambda: "xyzxyzxyzxyzxyzxyzxyzxyzxyz",
    ]
    rows = [(i, f"{prose(i, 9)} {makers[i % 6]()} é🙂 token: x password = 'hunter2hunter2' token=token= abcdefghij") for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = secrets.scan(df).collect()
    for r in out:
        assert [tuple(s) for s in r.base_spans] == base_spans(r.text)
    found = [sum(r.n_random for r in out if r.doc_id % 6 == k) for k in range(6)]
    assert found[0] >= 38 and found[1] >= 38 and found[2:] == [0, 0, 0, 0]
    masked = secrets.scan(df).select("text", secrets.masked("text", "spans").alias("m")).first()
    assert "hunter2hunter2" not in masked.m and masked.m.count("[secret]") >= 1 and masked.m.startswith(masked.text.split(" ")[0])
    assert secrets.scan(odd.drop("spans")).count() == odd.count() and secrets.scan(none.drop("spans")).count() == 0
    assert secrets.scan(odd.drop("spans")).where("doc_id = 3").first().n_assign == 0


def test_false_discovery_rule():
    counts = {(8, 0): 990, (8, 100): 10, (9, 3): 5}
    assert secrets.least_bins(counts) == {8: 80}  # 1000 * 10 ** (-80 * 0.05) = 0.01 * 10


def brute_license(t):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    starts, base, labels = [], set(), set()
    for known in licenses.templates():
        for i in range(len(w) - len(known.words) + 1):
            if known.base and tuple(w[i : i + len(known.words)]) == known.words:
                starts.append(i)
                base.add(known.label)
            elif all(tuple(w[i + o : i + o + len(k)]) == k for o, k in known.keys):
                labels.add(known.label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels))


def test_licenses(spark, sf_dir, odd, none, monkeypatch):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in licenses.op5_license_index(spark, sf_dir).collect():
        assert tuple(r)[1:7] == brute_license(texts[r.doc_id])
    rows = [
        (1, "CC BY cc by, CC-BY all rights Reserved all all rights reserved"),
        (2, None),
        (3, ""),
        (4, "Permission is hereby granted, free of charge, to any person obtaining a copy"),
        (5, "general general public license of the gnu general public license version 3"),
        (6, "by cc licence"),
        (7, "x " * 4000 + "all rights reserved"),
    ]
    monkeypatch.setattr(licenses, "table", lambda *_: spark.createDataFrame(rows, "doc_id long, text string"))
    out = licenses.op5_license_index(spark, "").collect()
    assert [tuple(r)[1:7] for r in out] == [brute_license(t) for _, t in rows]
    assert all((r.score > 0.5) == bool(r.labels) and 0 <= r.score <= 1 for r in out)
    assert licenses.scan(odd.drop("n_words", "score")).count() == odd.count() and licenses.scan(none).count() == 0


def test_pipeline(spark, sf_dir, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, sf_dir)
        assert out.columns == docs.columns, name
        kept = {r.doc_id for r in out.collect()}
        assert kept <= ids and len(kept) > 0.5 * len(ids)
        ids, seen = kept, spark.createDataFrame(out.collect(), docs.schema)
    assert not any(base_spans(r.text) for r in seen.collect())
    final = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in final.collect()} == ids
    strange = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        strange = stage(spark, strange, sf_dir)
        assert strange.columns == odd.columns
        strange = spark.createDataFrame(strange.collect(), odd.schema)
    assert strange.where("doc_id is null").count() == 2
    assert corpus_pipeline.STAGES[-1][1](spark, strange, sf_dir).count() >= strange.count()


def test_line_stage_keeps_what_is_left(spark):
    """A document whose long lines all stand elsewhere keeps its own short ones; one without any text left goes."""
    import corpus_pipeline

    a, b = prose(21, 20), prose(22, 20)
    rows = [(1, a), (2, b), (3, f"{a}\n{b}\nown"), (4, f"{a}\n\n{b}"), (5, ""), (6, None), (7, " \n"), (8, f"{b}\n{{}}"), (9, "{}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in corpus_pipeline.lines_once(spark, docs, "").collect()}
    assert out == {1: a, 2: b, 3: "own", 5: "", 6: None, 7: " \n", 8: "{}"}
