"""Every query with SQL, against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from strata import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def shown(rows, columns):
    return sorted(tuple(repr(float(r[c])) if isinstance(r[c], float) else repr(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.sql(SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert shown(got.collect(), columns) == shown([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.fixture(scope="module")
def long_log(spark, tmp_path_factory):
    """A log of more records than any run, group of runs or prefix holds."""
    path = str(tmp_path_factory.mktemp("long"))
    spark.range(9500).selectExpr("id as event_id", "id % 37 as user_id", "if(id % 5 = 0, 'error', 'click') as event_type", "concat('n', id) as props", "timestamp_seconds(id) as ts").write.parquet(f"{path}/events.parquet")
    return path


def test_crc32c_of_the_whole_log(spark, long_log):
    from strata.sources import wal

    got = {r.seq: r.crc for r in QUERIES["crc32c_values"](spark, long_log).collect()}
    assert got == {i + 1: wal.crc32c(b"" if i % 5 == 0 else f"n{i}".encode()) for i in range(9500)}


def test_internal_keys_of_the_whole_log(spark, long_log):
    got = {(r.user_key, r.seq, r.vtype, r.internal_key) for r in QUERIES["internal_key_codec"](spark, long_log).collect()}
    rows = [(f"u{i % 37:08d}", i + 1, 2 if i % 5 == 0 else 1) for i in range(9500)]
    assert got == {(k, s, t, (k.encode() + ((s << 8) | t).to_bytes(8, "little")).hex().upper()) for k, s, t in rows}


def test_every_run_is_merged_and_compacted(spark, long_log):
    merged = QUERIES["merge_runs"](spark, long_log).collect()
    versions = sorted(((s // 4000, f"u{(s - 1) % 37:08d}", s) for s in range(1, 9501)), key=lambda x: (x[0], x[1], -x[2]))
    ranks, last = [], None
    for g, k, s in versions:
        ranks.append((g, k, s, ranks[-1][3] + 1 if last == (g, k) else 1))
        last = (g, k)
    assert sorted(tuple(r)[:3] + (r.version_rank,) for r in merged) == sorted(ranks)
    kept = QUERIES["compact_l0_keep"](spark, long_log).collect()
    assert sorted((r.run_group, r.user_key, r.seq) for r in kept) == sorted(x[:3] for x in ranks if x[3] == 1)
    assert {r.value for r in kept if r.vtype == 2} == {""} and {r.run_group for r in kept} == {0, 1, 2}


def test_bloom_rate_of_many_keys(spark, tmp_path):
    path = str(tmp_path)
    spark.range(12000).selectExpr("id as event_id", "id as user_id", "'click' as event_type", "'v' as props", "timestamp_seconds(id) as ts").write.parquet(f"{path}/events.parquet")
    got = {r.present: r for r in QUERIES["bloom_probe"](spark, path).collect()}
    assert got[True].n == got[True].n_might_contain == 12000 and got[False].n_might_contain < 0.03 * 12000
