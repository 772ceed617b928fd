"""Appended operations, ordered scans, listings without secrets."""

from strata.operators import access, reads, writes


def test_put_then_delete(spark):
    log = spark.createDataFrame([("a", 1, 1, "old")], "user_key string, seq long, vtype int, value string")
    log = writes.put(log, spark.createDataFrame([(1, "k", "v"), (2, "a", "new"), (3, "e", None)], "pos long, user_key string, value string"))
    assert {(r.user_key, r.seq, r.value) for r in reads.latest_live(log).collect()} == {("k", 2, "v"), ("a", 3, "new"), ("e", 4, "")}
    log = writes.delete(log, spark.createDataFrame([(1, "k")], "pos long, user_key string"))
    assert [r.user_key for r in reads.ordered_scan(log).collect()] == ["a", "e"]
    assert [r.user_key for r in reads.ordered_scan(log, snapshot=4).collect()] == ["a", "e", "k"]
    empty = log.where("false")
    assert writes.put(empty, spark.createDataFrame([(1, "k", "v")], "pos long, user_key string, value string")).first().seq == 1


def test_public(spark):
    rows = spark.createDataFrame([(1, "x", "h")], "id long, name string, key_hash string")
    assert access.public(rows).columns == ["id", "name"]


def test_range_delete_numbers_each_live_key_once(spark):
    from strata.operators import reads

    rows = [(f"k{i:04d}", i + 1, 1, "v") for i in range(3000)] + [(f"k{i:04d}", 4000 + i, 2, "") for i in range(0, 3000, 3)]
    log = spark.createDataFrame(rows, "user_key string, seq long, vtype int, value string")
    got = reads.range_delete(log, "k0100", "k2000", 9000).collect()
    assert sorted(r.user_key for r in got) == [f"k{i:04d}" for i in range(100, 2000) if i % 3]
    assert sorted(r.seq for r in got) == list(range(9001, 9001 + len(got))) and {(r.vtype, r.value) for r in got} == {(2, "")}
    assert reads.range_delete(log, "x", "y", 9000).count() == 0
