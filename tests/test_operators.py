import random

from pyspark.sql import functions as F

from strata.functions import codec, hashing
from strata.operators import access, maintenance, placement, reads, stateful
from strata.sources import tables, wal
from strata.streaming import changelog

LOG = "user_key string, seq long, vtype int, value string"


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def pairs(df):
    return sorted((r.user_key, r.seq) for r in df.collect())


def test_snapshots(spark):
    x = log(spark, [("x", 1, 1, "v1"), ("x", 3, 1, "v3"), ("x", 5, 2, ""), ("x", 7, 1, "v7")])
    seen = {s: [r.value for r in reads.latest_live(x, s).collect()] for s in (2, 4, 6, 8)}
    assert seen == {2: ["v1"], 4: ["v3"], 6: [], 8: ["v7"]}
    assert [(r.old_value, r.new_value) for r in reads.snapshot_diff(x, 4, 6).collect()] == [("v3", None)]


def test_retaining_compaction(spark):
    x = log(spark, [("apple", 10, 1, "a10"), ("apple", 2, 1, "a2"), ("zebra", 1, 1, "z1"), ("apple", 8, 1, "a8"), ("apple", 1, 2, ""), ("mango", 3, 1, "m3")])
    assert pairs(maintenance.compact_retaining(x, 4)) == [("apple", 2), ("apple", 8), ("apple", 10), ("mango", 3), ("zebra", 1)]
    assert pairs(maintenance.compact_retaining(log(spark, [("gone", 1, 2, "")]), 10)) == []


def test_tombstones_and_bounds(spark):
    x = log(spark, [("", 1, 1, ""), ("a", 2, 1, "1"), ("a", 9, 2, ""), ("b", 3, 1, "2"), ("é", 4, 1, "3"), ("c", 5, 1, "4"), ("c", 6, 1, "5")])
    assert pairs(reads.latest_live(x)) == [("", 1), ("b", 3), ("c", 6), ("é", 4)]
    assert pairs(reads.range_scan(x, "b", "c")) == [("b", 3)]
    assert pairs(reads.seek(x, "b", 2)) == [("b", 3), ("c", 6)]
    assert {r.user_key: r.status for r in reads.multi_get(x, ["a", "b", "zz"]).collect()} == {"a": "NOT_FOUND", "b": "OK", "zz": "NOT_FOUND"}
    assert pairs(maintenance.compact(x, drop_tombstones=False)) == [("", 1), ("a", 9), ("b", 3), ("c", 6), ("é", 4)]
    assert reads.range_delete(x, "b", "d", 9).count() == 2


def test_manifest(spark):
    edits = spark.createDataFrame([(1, "add", 0, 1), (2, "add", 0, 2), (3, "del", 0, 1), (4, "add", 1, 9)], "edit_no long, type string, level long, file_no long")
    assert sorted((r.level, r.file_no) for r in maintenance.manifest_live(edits).collect()) == [(0, 2), (1, 9)]
    reset = edits.unionByName(spark.createDataFrame([(5, "reset", 0, 0), (6, "add", 0, 7)], edits.schema))
    assert [(r.level, r.file_no) for r in maintenance.manifest_live(reset).collect()] == [(0, 7)]


def murmur(data, seed):
    m, h = 0x5BD1E995, seed ^ len(data)
    while len(data) >= 4:
        k = int.from_bytes(data[:4], "little") * m & 0xFFFFFFFF
        k = (k ^ k >> 24) * m & 0xFFFFFFFF
        h, data = (h * m & 0xFFFFFFFF) ^ k, data[4:]
    if data:
        h = (h ^ int.from_bytes(data, "little")) * m & 0xFFFFFFFF
    h = (h ^ h >> 13) * m & 0xFFFFFFFF
    return h ^ h >> 15


def test_hashes(spark):
    keys = ["", "a", "ab", "abc", "abcd", "abcde", "hello world", "ключ", "x" * 33]
    seed = hashing.FILTER_SEEDS[1]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", hashing.murmur2(F.col("k"), seed).alias("m"), hashing.murmur2(F.col("k"), 0).alias("z"), hashing.fnv1a(F.col("k")).alias("f"), hashing.crc32c(F.col("k")).alias("c")).collect()
    for r in rows:
        data, h = r.k.encode(), 2166136261
        for octet in data:
            h = (h ^ octet) * 16777619 & 0xFFFFFFFF
        assert (r.m, r.z, r.f, r.c) == (murmur(data, seed), murmur(data, 0), h, wal.crc32c(data))
    assert wal.crc32c(b"123456789") == 0xE3069283


def test_filter(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"))
    bits = 3000 * 10
    built = hashing.build_filter(keys, "k", bits, 7)
    assert hashing.probe_filter(keys, "k", built, bits, 7).where("not might_contain").count() == 0
    absent = spark.range(3000).select(F.concat(F.lit("z"), "id").alias("k"))
    assert hashing.probe_filter(absent, "k", built, bits, 7).where("might_contain").count() < 0.02 * 3000
    assert hashing.integer_filter(0.01) == (12, 6)


def test_codecs(spark):
    df = spark.createDataFrame([("a\0", 2**55 + 3, 1), ("", 0, 2), ("clé", 258, 1)], "k string, s long, t int")
    key, seq, kind = codec.decode_internal_key(F.col("p"))
    for r in df.withColumn("p", codec.internal_key(F.col("k"), F.col("s"), F.col("t"))).select("k", "s", "t", key.alias("k2"), seq.alias("s2"), kind.alias("t2"), "p").collect():
        assert (r.k, r.s, r.t) == (r.k2, r.s2, r.t2)
        assert bytes(r.p) == r.k.encode() + (r.s << 8 | r.t).to_bytes(8, "little")
    numbers = [0, 1, 127, 128, 255, 256, 16383, 16384, 1000000, 2**32 - 1]
    for r in spark.createDataFrame([(n,) for n in numbers], "n long").select("n", codec.varint(F.col("n")).alias("v"), codec.varint_length(F.col("n")).alias("l")).collect():
        assert len(r.v) == r.l and sum((b & 127) << (7 * i) for i, b in enumerate(bytes(r.v))) == r.n
    assert len(spark.range(1).select(codec.request_frame("put", F.lit("k"), F.lit("v")).alias("f")).first().f) == 13


def test_wal(spark, tmp_path):
    spark.dataSource.register(wal.WalDataSource)
    folder = str(tmp_path / "wal")
    rows = [(f"k{i % 7}", 1 + (i % 5 == 0), f"v{i}") for i in range(40)]
    spark.createDataFrame(rows, "user_key string, vtype int, value string").coalesce(1).write.format("strata_wal").option("batch", "6").mode("append").save(folder)
    got = wal.recovered(spark.read.format("strata_wal").load(folder)).orderBy("seq").collect()
    assert [(r.user_key, r.vtype, r.value) for r in got] == rows and [r.seq for r in got] == list(range(1, 41))
    assert wal.read_logs(spark, folder).count() == 40
    whole = wal.frame(b"one") + wal.frame(b"two")
    assert list(wal.frames(whole[:-1])) == [b"one"]
    assert list(wal.frames(whole[:8] + b"x" + whole[9:])) == []


def test_text_sources(spark, tmp_path):
    state = spark.createDataFrame([("a", "1"), ("b", '2"\n')], "key string, value string")
    path = str(tmp_path / "sse")
    (tmp_path / "sse").mkdir()
    (tmp_path / "sse" / "part").write_text("".join(r.frame for r in tables.sse_frames(state).collect()))
    assert sorted(map(tuple, tables.read_sse(spark, path).collect())) == sorted(map(tuple, state.collect()))
    assert sorted(map(tuple, tables.restore_json(tables.snapshot_json(state)).collect())) == sorted(map(tuple, state.collect()))
    commands = spark.createDataFrame([(1, '{"op":"put","key":"a","value":"1"}'), (2, '{"op":"put","key":"b","value":"2"}'), (3, '{"op":"del","key":"a"}')], "index long, command string")
    assert list(map(tuple, tables.apply_commands(commands).collect())) == [("b", "2")]
    assert tables.settings("server:\n  port: 80 # x\nups:\n  - a\n  - b\n") == {"server": {"port": "80"}, "ups": ["a", "b"]}


def test_balancing(spark):
    assert placement.smooth_period([("a", 5), ("b", 1), ("c", 1)]) == list("aabacaa")
    keys = spark.range(300).select(F.concat(F.lit("key-"), "id").alias("user_key"))
    counts = {r.node: r["count"] for r in placement.locate(keys, placement.ring(spark, ["a", "b", "c"], 32)).groupBy("node").count().collect()}
    assert sum(counts.values()) == 300 and len(counts) == 3 and min(counts.values()) > 20


def test_access(spark):
    requests = spark.createDataFrame([(1, "reader", "GET"), (2, "reader", "PUT"), (3, "nobody", "GET"), (4, "admin", "DELETE")], "id long, role string, method string")
    assert sorted(r.id for r in access.allowed(requests).collect()) == [1, 4]
    routes = [("GET", "/hello", "hello"), ("GET", "/c/:name", "one")]
    got = spark.createDataFrame([("/hello",), ("/c/x",), ("/c/x/y",)], "p string").select(access.match_pattern(F.lit("GET"), F.col("p"), routes).alias("r"))
    assert [r.r for r in got.collect()] == ["hello", "one", "404"]


def test_lru_and_health(spark):
    trace = [("c", i, k) for i, k in enumerate("abacbadd")]
    got = {r.at: r.hit for r in stateful.lru(spark.createDataFrame(trace, "cache string, at long, key string"), 2).collect()}
    held, want = [], {}
    for _, i, k in trace:
        want[i] = k in held
        held = [x for x in held if x != k][-1:] + [k] if k not in held else [x for x in held if x != k] + [k]
    assert got == want
    probes = spark.createDataFrame([("u", i, ok) for i, ok in enumerate([True, False, False, False, True, True])], "upstream string, at long, ok boolean")
    assert [r.healthy for r in stateful.probe_health(probes, 3, 2).orderBy("at").collect()] == [True, True, True, False, False, True]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from strata.views import kv_log

    rows = kv_log(spark, sf_dir).select("user_key", "seq", "vtype", "value").repartition(3)
    rows.write.parquet(str(tmp_path / "in"))
    stream = changelog.read_stream(spark, str(tmp_path / "in"), rows.schema)
    changelog.upsert_latest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "generation=0"))
    assert pairs(got) == pairs(reads.latest(rows))


def test_stream_buckets(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = changelog.token_buckets(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), 2, 43_200_000_000)
    name = f"buckets{random.randrange(10**9)}"
    stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    batch = stateful.token_bucket(events, 2, 43_200_000_000)
    assert sorted(map(tuple, spark.table(name).collect())) == sorted((r.event_id, r.allowed) for r in batch.collect())
