import base64
import json

from pyspark.sql import functions as F

from strata.functions import codec, web


def test_statuses(spark):
    codes = [200, 301, 400, 404, 409, 418, 429, 500, 503]
    got = {r.s: r.e for r in spark.createDataFrame([(c,) for c in codes], "s int").select("s", web.error_of(F.col("s")).alias("e")).collect()}
    assert got == {200: None, 301: None, 400: "invalid argument", 404: "not found", 409: "conflict", 418: "http 418", 429: "rate limited", 500: "internal", 503: "internal"}
    texts = spark.createDataFrame([(0, ""), (1, "k"), (5, None)], "c int, m string").select(web.status_text(F.col("c"), F.col("m")).alias("t")).collect()
    assert [r.t for r in texts] == ["OK", "NotFound: k", "IOError: "]


def test_responses(spark):
    rows = [(200, [("A", "b")], "hé"), (404, [("content-length", "9")], ""), (500, [], "x")]
    df = spark.createDataFrame(rows, "s int, h array<struct<name:string,value:string>>, b string")
    got = [r.t for r in df.select(web.response(F.col("s"), F.col("h"), F.col("b")).alias("t")).collect()]
    assert got == ["HTTP/1.1 200 OK\r\nA: b\r\nContent-Length: 3\r\n\r\nhé", "HTTP/1.1 404 Not Found\r\ncontent-length: 9\r\n\r\n", "HTTP/1.1 500 Error\r\nContent-Length: 1\r\n\r\nx"]
    assert [r.k for r in df.select(web.body_kind(F.col("h")).alias("k")).collect()] == ["none", "sized", "none"]


def test_claims_and_paths(spark):
    body = base64.urlsafe_b64encode(json.dumps({"sub": "u?>", "role": "admin", "jti": "1", "exp": 9, "iat": 1, "iss": "x"}).encode()).decode().rstrip("=")
    df = spark.createDataFrame([(f"h.{body}.s", "/a/b/000042.sst"), ("bad", "/a/b/MANIFEST")], "t string, p string")
    rows = df.select(web.claims(F.col("t")).alias("c"), web.file_number(F.col("p")).alias("n")).collect()
    assert (rows[0].c.sub, rows[0].c.role, rows[0].c.exp, rows[0].n, rows[1].n) == ("u?>", "admin", 9, 42, None)


def test_scan_payload(spark):
    df = spark.createDataFrame([("a", "1"), ("bé", "")], "k string, v string")
    frames = b"".join(bytes(r.f) for r in df.select(codec.pair_frame(F.col("k"), F.col("v")).alias("f")).collect())
    payloads = spark.createDataFrame([((2).to_bytes(4, "little") + frames,), ((0).to_bytes(4, "little"),)], "p binary")
    got = [[tuple(x) for x in r.d] for r in payloads.select(codec.decode_pairs(F.col("p")).alias("d")).collect()]
    assert got == [[("a", "1"), ("bé", "")], []]
