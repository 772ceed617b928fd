"""The query catalogue: each entry is a Spark plan over the driver's tables and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import codec, hashing
from strata.operators import access, maintenance, metrics, placement, reads, stateful, writes
from strata.views import kv_log

SNAPSHOT = 5000
ROWS_PER_RUN = 1000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_LOG = """log as (select 'u' || lpad(cast(user_id as varchar), 8, '0') as user_key, event_id + 1 as seq,
  case when event_type = 'error' then 2 else 1 end as vtype, case when event_type = 'error' then '' else props end as value, ts from events)"""


def _newest(source: str) -> str:
    return f"(select * from (select *, row_number() over (partition by user_key order by seq desc, vtype) as rn from {source}) where rn = 1)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = f"with {_LOG} {sql}"
        return fn

    return add


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv_log(spark, sf_dir)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


_KV = ("user_key", "seq", "value")


@query("latest_live", f"select user_key, seq, value from {_newest('log')} where vtype = 1")
def _(s, d):
    return reads.latest_live(_log(s, d)).select(*_KV)


@query("latest_tombstones", f"select user_key, seq from {_newest('log')} where vtype = 2")
def _(s, d):
    return reads.latest(_log(s, d)).where("vtype = 2").select("user_key", "seq")


_GET = f"select k.user_key, case when l.user_key is null then 'NOT_FOUND' else 'OK' end as status, l.value from (values {{}}) k(user_key) left join (select * from {_newest('log')} where vtype = 1) l on k.user_key = l.user_key"


@query("point_get", _GET.format("('u00000007')"))
def _(s, d):
    return reads.point_get(_log(s, d), "u00000007")


_KEYS = [f"u{n:08d}" for n in (1, 2, 3, 5, 8, 13, 21, 34, 55, 9999999)]


@query("multi_get_status", _GET.format(", ".join(f"('{k}')" for k in _KEYS)))
def _(s, d):
    return reads.multi_get(_log(s, d), _KEYS)


def _range_query(name: str, start: str, end: str) -> None:
    test = " and ".join(["vtype = 1"] + ([f"user_key >= '{start}'"] if start else []) + ([f"user_key < '{end}'"] if end else []))

    @query(name, f"select user_key, seq, value from {_newest('log')} where {test}")
    def _(s, d):
        return reads.range_scan(_log(s, d), start, end).select(*_KV)


_range_query("range_scan", "u00000020", "u00000050")
_range_query("open_start_scan", "", "u00000030")
_range_query("open_end_scan", "u00000100", "")


@query("prefix_scan", f"select user_key, seq, value from {_newest('log')} where vtype = 1 and starts_with(user_key, 'u0000001')")
def _(s, d):
    return reads.prefix_scan(_log(s, d), "u0000001").select(*_KV)


@query("seek_limit", f"select user_key, seq, value from {_newest('log')} where vtype = 1 and user_key >= 'u00000033' order by user_key limit 20")
def _(s, d):
    return reads.seek(_log(s, d), "u00000033", 20).select(*_KV)


_AT = "(select * from log where seq <= {})"


@query("snapshot_scan", f"select user_key, seq, value from {_newest(_AT.format(SNAPSHOT))} where vtype = 1")
def _(s, d):
    return reads.latest_live(_log(s, d), SNAPSHOT).select(*_KV)


@query(
    "snapshot_diff",
    f"select coalesce(o.user_key, n.user_key) as user_key, o.value as old_value, n.value as new_value from (select * from {_newest(_AT.format(SNAPSHOT))} where vtype = 1) o "
    f"full join (select * from {_newest(_AT.format(2 * SNAPSHOT))} where vtype = 1) n on o.user_key = n.user_key where o.value is distinct from n.value",
)
def _(s, d):
    return reads.snapshot_diff(_log(s, d), SNAPSHOT, 2 * SNAPSHOT)


@query("count_live", f"select count(*) as n_live from {_newest('log')} where vtype = 1")
def _(s, d):
    return reads.count_live(_log(s, d))


@query("batch_explode", "select cast((seq - 1) // 10 as bigint) as batch_no, cast((seq - 1) % 10 as bigint) as pos, seq, user_key, cast(vtype as bigint) as vtype from log")
def _(s, d):
    # batches arrive as arrays of operations without sequence numbers
    number = F.floor((F.col("seq") - 1) / 10).cast("long")
    batches = _log(s, d).groupBy(number.alias("batch_no")).agg(F.array_sort(F.collect_list(F.struct(F.col("seq").alias("at"), "user_key", "vtype"))).alias("ops"))
    batches = batches.select("batch_no", F.transform("ops", lambda o: F.struct(o["user_key"].alias("user_key"), o["vtype"].alias("vtype"))).alias("ops"), (F.col("batch_no") * 10).alias("base"))
    return maintenance.explode_batches(batches).select("batch_no", F.col("pos").cast("long").alias("pos"), "seq", "user_key", F.col("vtype").cast("long").alias("vtype"))


_RUNS = f"(select *, seq // {ROWS_PER_RUN} as run_id from log)"


@query("flush_runs", f"select run_id, count(*) as n_rows, min(user_key) as min_key, max(user_key) as max_key, cast(sum(strlen(user_key) + strlen(value)) as bigint) as n_bytes, cast(sum(case when vtype = 2 then 1 else 0 end) as bigint) as n_tombstones from {_RUNS} group by run_id")
def _(s, d):
    return maintenance.flush_stats(maintenance.with_run(_log(s, d), ROWS_PER_RUN))


_GROUPS = f"(select *, row_number() over (partition by run_id // 4, user_key order by seq desc, vtype) as version_rank from {_RUNS})"


@query("merge_runs", f"select run_id // 4 as run_group, user_key, seq, cast(vtype as bigint) as vtype, cast(version_rank as bigint) as version_rank from {_GROUPS}")
def _(s, d):
    merged = maintenance.merge_groups(maintenance.with_run(_log(s, d), ROWS_PER_RUN), 4)
    return merged.select("run_group", "user_key", "seq", F.col("vtype").cast("long").alias("vtype"), F.col("version_rank").cast("long").alias("version_rank"))


@query("compact_l0_keep", f"select run_id // 4 as run_group, user_key, seq, cast(vtype as bigint) as vtype, value from {_GROUPS} where version_rank = 1")
def _(s, d):
    kept = maintenance.compact_groups(maintenance.with_run(_log(s, d), ROWS_PER_RUN), 4)
    return kept.select("run_group", "user_key", "seq", F.col("vtype").cast("long").alias("vtype"), "value")


@query("compact_l0_final", f"select user_key, seq, value from {_newest('log')} where vtype = 1")
def _(s, d):
    return maintenance.compact(maintenance.with_run(_log(s, d), ROWS_PER_RUN), drop_tombstones=True).select(*_KV)


@query(
    "compact_min_snapshot",
    f", kept as (select * from (select *, row_number() over (partition by user_key, seq < {SNAPSHOT} order by seq desc, vtype) as b from log) where seq >= {SNAPSHOT} or b = 1) "
    f"select user_key, seq, cast(vtype as bigint) as vtype from (select *, count(*) over (partition by user_key) as n from kept) where not (n = 1 and vtype = 2 and seq < {SNAPSHOT})",
)
def _(s, d):
    return maintenance.compact_retaining(_log(s, d), SNAPSHOT).select("user_key", "seq", F.col("vtype").cast("long").alias("vtype"))


@query("write_amplification", f"select run_id // 4 as run_group, count(*) as rows_in, count(distinct user_key) as rows_kept from {_RUNS} group by 1")
def _(s, d):
    return maintenance.write_amplification(maintenance.with_run(_log(s, d), ROWS_PER_RUN), 4)


_FILES = f"(select distinct (seq // {ROWS_PER_RUN}) % 3 as level, seq // {ROWS_PER_RUN} as file_no from log)"


def _files(s, d):
    runs = maintenance.with_run(_log(s, d), ROWS_PER_RUN).select("run_id").distinct()
    return runs.select(F.pmod("run_id", F.lit(3)).alias("level"), F.col("run_id").alias("file_no"))


@query("level_stats", f"select level, count(*) as n_files, max(file_no) as max_file_no from {_FILES} group by level")
def _(s, d):
    return maintenance.level_stats(_files(s, d))


@query("compaction_due", f"select level, count(*) as n_files, max(file_no) as max_file_no from {_FILES} group by level having count(*) >= 4")
def _(s, d):
    return maintenance.compaction_due(_files(s, d), 4)


_EDITS = f"""(select run_id * 2 as edit_no, 'add' as type, 0 as level, run_id as file_no from (select distinct seq // 100 as run_id from log)
  union all select run_id * 2 + 21, 'del', 0, run_id from (select distinct seq // 100 as run_id from log) where run_id % 3 = 0
  union all select 51, 'reset', 0, -1)"""


@query(
    "manifest_live",
    f", edits as {_EDITS}, live as (select *, row_number() over (partition by level, file_no order by edit_no desc) as r from edits where type <> 'reset' and edit_no > (select max(edit_no) from edits where type = 'reset')) "
    "select cast(level as bigint) as level, file_no from live where r = 1 and type = 'add'",
)
def _(s, d):
    runs = _log(s, d).select(F.floor(F.col("seq") / 100).cast("long").alias("run_id")).distinct()
    adds = runs.select((F.col("run_id") * 2).alias("edit_no"), F.lit("add").alias("type"), F.lit(0).cast("long").alias("level"), F.col("run_id").alias("file_no"))
    dels = runs.where("run_id % 3 = 0").select((F.col("run_id") * 2 + 21).alias("edit_no"), F.lit("del").alias("type"), F.lit(0).cast("long").alias("level"), F.col("run_id").alias("file_no"))
    reset = s.createDataFrame([(51, "reset", 0, -1)], "edit_no long, type string, level long, file_no long")
    return maintenance.manifest_live(adds.unionByName(dels).unionByName(reset))


def _internal_keys(log):
    packed = codec.internal_key(F.col("user_key"), F.col("seq"), F.col("vtype"))
    key, seq, vtype = codec.decode_internal_key(F.col("packed"))
    return log.select(packed.alias("packed")).select(key.alias("user_key"), seq.alias("seq"), vtype.alias("vtype"), F.hex("packed").alias("internal_key"))


@query("internal_key_codec", "select user_key, seq, cast(vtype as bigint) as vtype, hex(encode(user_key)) || (select string_agg(lpad(hex((((seq << 8) | vtype) >> (8 * i)) & 255), 2, '0'), '' order by i) from range(8) t(i)) as internal_key from log")
def _(s, d):
    return _internal_keys(_log(s, d))


_KEYS_SQL = "(select distinct user_key from log)"


def _keys(s, d):
    return _log(s, d).select("user_key").distinct()


def _fnv_sql(text: str) -> str:
    return f"list_reduce(list_prepend(cast(2166136261 as bigint), list_transform(range(1, strlen({text}) + 1), lambda i: cast(ascii(substring({text}, i, 1)) as bigint))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query("fnv_hash", f"select user_key, {_fnv_sql('user_key')} as hash from {_KEYS_SQL}")
def _(s, d):
    return _keys(s, d).select("user_key", hashing.fnv1a(F.col("user_key")).alias("hash"))


@query("murmur2_hash")
def _(s, d):
    return _keys(s, d).select("user_key", *(hashing.murmur2(F.col("user_key"), seed).alias(f"hash_{i}") for i, seed in enumerate(hashing.FILTER_SEEDS)))


@query("crc32c_values")
def _(s, d):
    return _log(s, d).select("seq", hashing.crc32c(F.col("value")).alias("crc"))


@query("bloom_probe")
def _(s, d):
    live = reads.latest_live(_log(s, d)).select("user_key")
    per_key, hashes = hashing.integer_filter(0.01)
    bits = max(64, per_key * live.count())
    built = hashing.build_filter(live, "user_key", bits, hashes)
    absent = live.select(F.concat(F.lit("absent-"), "user_key").alias("user_key"))
    probes = live.withColumn("present", F.lit(True)).unionByName(absent.withColumn("present", F.lit(False)))
    hits = hashing.probe_filter(probes, "user_key", built, bits, hashes)
    return probes.join(hits, "user_key").groupBy("present").agg(F.count("*").alias("n"), F.sum(F.col("might_contain").cast("long")).alias("n_might_contain"))


_SIZES = [(1e6, 0.01), (1e5, 0.01), (1e4, 0.001), (1e7, 0.05), (5.0, 0.5)]
_SIZES_SQL = ", ".join(f"(cast({n} as double), cast({p} as double))" for n, p in _SIZES)


@query("bloom_sizing", f"select n, p, cast(m as bigint) as m, cast(k as bigint) as k, round(pow(1 - exp(-k * n / m), k), 6) as fpr from (select *, round(m / n * ln(2)) as k from (select n, p, ceil(-n * ln(p) / pow(ln(2), 2)) as m from (values {_SIZES_SQL}) t(n, p)))")
def _(s, d):
    bits, hashes, rate = hashing.filter_size(F.col("n"), F.col("p"))
    return s.createDataFrame(_SIZES, "n double, p double").select("n", "p", bits.cast("long").alias("m"), hashes.cast("long").alias("k"), F.round(rate, 6).alias("fpr"))


@query("sha256_keys", f"select user_key, sha256(user_key) as digest from {_KEYS_SQL}")
def _(s, d):
    return _keys(s, d).select("user_key", F.sha2(F.col("user_key").cast("binary"), 256).alias("digest"))


@query("varint_length", "select seq, cast(case when seq * 37 < 128 then 1 when seq * 37 < 16384 then 2 when seq * 37 < 2097152 then 3 when seq * 37 < 268435456 then 4 else 5 end as bigint) as n from log")
def _(s, d):
    return _log(s, d).select("seq", codec.varint_length(F.col("seq") * 37).cast("long").alias("n"))


@query("json_pairs", f"""select user_key, '{{"key":"' || user_key || '","value":"' || replace(value, '"', '\\"') || '"}}' as pair from {_newest('log')} where vtype = 1""")
def _(s, d):
    return reads.latest_live(_log(s, d)).select("user_key", codec.json_pair(F.col("user_key"), F.col("value")).alias("pair"))


@query("fsm_snapshot_rows", f"select user_key, value from {_newest('log')} where vtype = 1")
def _(s, d):
    # one JSON map for each bucket of keys, so that no row holds the whole state
    live = reads.latest_live(_log(s, d))
    maps = live.groupBy(F.pmod(F.xxhash64("user_key"), F.lit(16)).alias("bucket")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("user_key", "value")))).alias("state"))
    return maps.select(F.explode(F.from_json("state", "map<string,string>")).alias("user_key", "value"))


_CATALOG = """(select n_name as name, 1 as version, 'create' as op, n_regionkey * 3600 as ttl from nation
  union all select n_name, 2, 'update', 60 from nation where n_nationkey % 2 = 0 union all select n_name, 3, 'delete', 0 from nation where n_nationkey % 5 = 0)"""


@query("catalog_list", f"select name, cast(version as bigint) as version, cast(ttl as bigint) as ttl from (select *, row_number() over (partition by name order by version desc) as r from {_CATALOG}) where r = 1 and op <> 'delete'")
def _(s, d):
    nation = s.read.parquet(f"{d}/nation.parquet")
    log = nation.select(F.col("n_name").alias("name"), F.lit(1).alias("version"), F.lit("create").alias("op"), (F.col("n_regionkey") * 3600).alias("ttl"))
    log = log.unionByName(nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.lit(2).alias("version"), F.lit("update").alias("op"), F.lit(60).alias("ttl")))
    log = log.unionByName(nation.where("n_nationkey % 5 = 0").select(F.col("n_name").alias("name"), F.lit(3).alias("version"), F.lit("delete").alias("op"), F.lit(0).alias("ttl")))
    return access.collections(log).select("name", F.col("version").cast("long").alias("version"), F.col("ttl").cast("long").alias("ttl"))


@query(
    "apikey_verify",
    "select c_custkey as key_id, c_nationkey as user_id, case when c_nationkey % 3 = 0 then 'admin' when c_nationkey % 3 = 1 then 'writer' else 'reader' end as role from customer "
    "where c_custkey % 2 = 0 and c_custkey % 7 <> 0 and (c_custkey % 5 = 0 or c_custkey % 5 > 2) and c_nationkey < 20",
)
def _(s, d):
    customers = s.read.parquet(f"{d}/customer.parquet")
    expiry = F.when(F.col("c_custkey") % 5 == 0, 0).when(F.col("c_custkey") % 5 > 2, 2000).otherwise(500)
    keys = customers.select(F.col("c_custkey").alias("key_id"), F.col("c_nationkey").alias("user_id"), F.sha2(F.col("c_name").cast("binary"), 256).alias("key_hash"), (F.col("c_custkey") % 7 == 0).alias("revoked"), expiry.alias("expires_at"))
    role = F.when(F.col("n_nationkey") % 3 == 0, "admin").when(F.col("n_nationkey") % 3 == 1, "writer").otherwise("reader")
    users = s.read.parquet(f"{d}/nation.parquet").where("n_nationkey < 20").select(F.col("n_nationkey").alias("user_id"), role.alias("role"))
    presented = customers.where("c_custkey % 2 = 0").select(F.col("c_name").alias("plain"))
    return access.verify_keys(presented, keys, users, F.lit(1000))


def _requests(s, d):
    role = F.when(F.col("user_id") % 4 == 0, "admin").when(F.col("user_id") % 4 == 1, "writer").when(F.col("user_id") % 4 == 2, "reader").otherwise("guest")
    method = F.when(F.col("event_type") == "error", "DELETE").when(F.col("event_type") == "purchase", "POST").when(F.col("event_type") == "signup", "PUT").otherwise("GET")
    return s.read.parquet(f"{d}/events.parquet").select("event_id", role.alias("role"), method.alias("method"))


@query(
    "rbac_allowed",
    ", req as (select event_id, case when user_id % 4 = 0 then 'admin' when user_id % 4 = 1 then 'writer' when user_id % 4 = 2 then 'reader' else 'guest' end as role, "
    "case when event_type = 'error' then 'DELETE' when event_type = 'purchase' then 'POST' when event_type = 'signup' then 'PUT' else 'GET' end as method from events) "
    "select event_id, role, method from req where role = 'admin' or (role = 'writer' and method <> 'DELETE') or (role = 'reader' and method = 'GET')",
)
def _(s, d):
    return access.allowed(_requests(s, d)).select("event_id", "role", "method")


@query("not_revoked", "select c_custkey as jti from customer where not exists (select 1 from (select s_suppkey * 2 as jti, 900 + s_suppkey % 200 as expires_at from supplier) r where r.jti = c_custkey and r.expires_at > 1000)")
def _(s, d):
    tokens = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("jti"))
    revoked = s.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") * 2).alias("jti"), (F.col("s_suppkey") % 200 + 900).alias("expires_at"))
    return access.not_revoked(tokens, revoked, F.lit(1000)).select("jti")


_ROUTES = [("/en", "english"), ("/en/8", "english-8"), ("/fr", "french"), ("/de/", "german")]
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query("route_match", f"select page_id, {_PATH} as path, (select r.route from (values {', '.join(str(r) for r in _ROUTES)}) r(prefix, route) where starts_with({_PATH}, r.prefix) order by length(r.prefix) desc limit 1) as route from pages")
def _(s, d):
    pages = s.read.parquet(f"{d}/pages.parquet").select("page_id", codec.url_path(F.col("url")).alias("path"))
    return access.match_prefix(pages, _ROUTES)


@query("http_parse", rf"select page_id, 'GET' as method, {_PATH} as path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) as query, 'HTTP/1.1' as version from pages")
def _(s, d):
    url = F.col("url")
    line = F.concat(F.lit("GET "), codec.url_path(url), F.when(codec.url_query(url) != "", F.concat(F.lit("?"), codec.url_query(url))).otherwise(""), F.lit(" HTTP/1.1"))
    method, path, q, version = codec.request_line(F.col("line"))
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", line.alias("line")).select("page_id", method.alias("method"), path.alias("path"), q.alias("query"), version.alias("version"))


def _ring_sql(name: str, nodes: list[str], vnodes: int = 32) -> str:
    listed = ", ".join(f"({i}, '{n}')" for i, n in enumerate(nodes))
    spots = f"(select n || '#' || v as label, n as node, i * {vnodes} + v as ord from (values {listed}) t(i, n), range({vnodes}) r(v))"
    return f"{name} as (select pos, arg_max(node, ord) as node from (select *, {_fnv_sql('label')} as pos from {spots}) group by pos)"


def _located_sql(ring: str) -> str:
    return f"(select k.user_key, k.key_hash, coalesce(r.node, (select arg_min(node, pos) from {ring})) as node from (select user_key, {_fnv_sql('user_key')} as key_hash from {_KEYS_SQL}) k asof left join {ring} r on k.key_hash <= r.pos)"


_NODES = ["node-a", "node-b", "node-c"]


@query("ring_locate", f", {_ring_sql('ring', _NODES)} select user_key, key_hash, node from {_located_sql('ring')}")
def _(s, d):
    return placement.locate(_keys(s, d), placement.ring(s, _NODES, 32)).select("user_key", "key_hash", "node")


@query("ring_distribution", f", {_ring_sql('ring', _NODES)}, c as (select node, count(*) as n_keys from {_located_sql('ring')} group by node) select node, n_keys, round(n_keys / (select sum(n_keys) from c), 6) as share, round(pow(n_keys - (select avg(n_keys) from c), 2) / (select avg(n_keys) from c), 6) as chi_term from c")
def _(s, d):
    counts = placement.spread(placement.locate(_keys(s, d), placement.ring(s, _NODES, 32)), "node")
    return counts.select("node", "n_keys", F.round("share", 6).alias("share"), F.round("chi_term", 6).alias("chi_term"))


@query("ring_migration", f", {_ring_sql('ring', _NODES)}, {_ring_sql('ring2', [*_NODES, 'node-d'])} select o.node as old_node, n.node as new_node, count(*) as n_keys from {_located_sql('ring')} o join {_located_sql('ring2')} n using (user_key) group by all")
def _(s, d):
    moved = placement.migrated(_keys(s, d), placement.ring(s, _NODES, 32), placement.ring(s, [*_NODES, "node-d"], 32))
    return moved.groupBy("old_node", "new_node").agg(F.count("*").alias("n_keys"))


@query("round_robin", "select event_id, ['up-0', 'up-1', 'up-2'][event_id % 3 + 1] as upstream from events")
def _(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", placement.round_robin(F.col("event_id"), ["up-0", "up-1", "up-2"]).alias("upstream"))


@query("smooth_wrr", "select event_id, ['a', 'a', 'b', 'a', 'c', 'a', 'a'][event_id % 7 + 1] as upstream from events")
def _(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", placement.smooth_round_robin(F.col("event_id"), [("a", 5), ("b", 1), ("c", 1)]).alias("upstream"))


@query("least_conn", "select n_regionkey, arg_min(n_name, connections * 1000 + n_nationkey) as name from (select *, (n_nationkey * 7) % 4 as connections from nation where n_nationkey % 6 <> 0) group by n_regionkey")
def _(s, d):
    nation = s.read.parquet(f"{d}/nation.parquet")
    ups = nation.select("n_regionkey", F.col("n_name").alias("name"), (F.col("n_nationkey") % 6 != 0).alias("healthy"), ((F.col("n_nationkey") * 7) % 4).alias("connections"), F.col("n_nationkey").alias("ordinal"))
    return placement.least_connections(ups, "n_regionkey")


@query("shard_counts", f"select {_fnv_sql('user_key')} % 8 as shard, count(*) as n_keys from {_KEYS_SQL} group by 1")
def _(s, d):
    return _keys(s, d).select(placement.shard(hashing.fnv1a(F.col("user_key")), 8).alias("shard")).groupBy("shard").agg(F.count("*").alias("n_keys"))


def _window_query(name: str, unit: str, seconds: int) -> None:
    sql = f"select cast(epoch(date_trunc('{unit}', ts)) as bigint) as window_start, count(*) as n_events, round(count(*) / {seconds}, 6) as qps, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.99), 6) as p99 from events group by 1"

    @query(name, sql)
    def _(s, d):
        return metrics.windowed(_events(s, d), f"1 {unit}", seconds=seconds)


_window_query("metrics_second", "second", 1)
_window_query("metrics_minute", "minute", 60)
_window_query("metrics_hour", "hour", 3600)


@query("metrics_sliding_5m", "select w as window_start, count(*) as n_events, round(count(*) / 300.0, 6) as avg_qps from (select unnest(generate_series((cast(floor(epoch(ts)) as bigint) // 60) * 60 - 240, (cast(floor(epoch(ts)) as bigint) // 60) * 60, 60)) as w from events) group by w")
def _(s, d):
    return metrics.sliding_counts(_events(s, d), 5, 1)


@query("health_rollup", "select window_start, n_events, round(share, 6) as error_share, case when share >= 0.4 then 'down' when share >= 0.2 then 'degraded' else 'ok' end as status from (select cast(epoch(date_trunc('hour', ts)) as bigint) as window_start, count(*) as n_events, avg(case when event_type = 'error' then 1.0 else 0.0 end) as share from events group by 1)")
def _(s, d):
    return metrics.health(_events(s, d), "1 hour", 0.2, 0.4)


@query("storage_bytes", f"select a.b as all_bytes, l.b as live_bytes, round(a.b / l.b, 6) as space_amplification from (select cast(sum(strlen(user_key) + strlen(value)) as bigint) as b from log) a, (select cast(sum(strlen(user_key) + strlen(value)) as bigint) as b from {_newest('log')} where vtype = 1) l")
def _(s, d):
    log = _log(s, d)
    return metrics.storage(log, reads.latest_live(log))


@query(
    "inflight",
    "select event_id, pool, cast(sum(step) over (partition by pool order by event_id) as bigint) as inflight from (select event_id, user_id % 8 as pool, case when event_type in ('click', 'view') then 1 else -1 end as step from events)",
)
def _(s, d):
    step = F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1)
    steps = s.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("user_id") % 8).alias("pool"), F.col("event_id").alias("at"), step.alias("step"))
    return metrics.inflight(steps, 100).select("event_id", "pool", F.col("inflight").cast("long").alias("inflight"))


@query(
    "token_bucket",
    ", ev as (select event_id, user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as n from events), "
    "walk as (select event_id, user_id, us, n, 86400000000 - 43200000000 as credit, true as allowed from ev where n = 1 union all "
    "select e.event_id, e.user_id, e.us, e.n, least(86400000000, w.credit + e.us - w.us) - case when least(86400000000, w.credit + e.us - w.us) >= 43200000000 then 43200000000 else 0 end, "
    "least(86400000000, w.credit + e.us - w.us) >= 43200000000 from walk w join ev e on e.user_id = w.user_id and e.n = w.n + 1) select event_id, allowed from walk",
)
def _(s, d):
    events = _events(s, d).withColumn("at", F.unix_micros("ts"))
    return stateful.token_bucket(events, 2, 43_200_000_000).select("event_id", "allowed")


SQL["token_bucket"] = SQL["token_bucket"].replace("with log", "with recursive log", 1)


@query("ttl_live", f"select user_key, seq from {_newest('log')} where vtype = 1 and epoch(ts) + 604800 > epoch(timestamp '2024-01-30 00:00:00')")
def _(s, d):
    return stateful.ttl_live(reads.latest_live(_log(s, d)), 604_800, 1_706_572_800).select("user_key", "seq")


@query("lru_cache")
def _(s, d):
    trace = s.read.parquet(f"{d}/events.parquet").select((F.col("event_id") % 4).alias("cache"), F.col("event_id").alias("at"), F.col("user_id").alias("key"))
    return stateful.lru(trace, 10).groupBy("cache").agg(F.sum(F.col("hit").cast("long")).alias("hits"), F.count("*").alias("n"))


@query("timers_due", "select event_id as timer_id, event_id % 50 + greatest(1, cast(ceil(value / 10) as bigint)) as expire_tick, (event_id % 50 + greatest(1, cast(ceil(value / 10) as bigint))) % 64 as slot from events where event_type <> 'error' and event_id % 50 + greatest(1, cast(ceil(value / 10) as bigint)) <= 40")
def _(s, d):
    timers = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("timer_id"), (F.col("event_id") % 50).alias("start_tick"), F.col("value").alias("timeout_ms"), (F.col("event_type") == "error").alias("canceled"))
    return stateful.timers_due(timers, 40, 10, 64).select("timer_id", "expire_tick", F.col("slot").cast("long").alias("slot"))


@query("health_probes", ", p as (select user_id as upstream, event_id as probe_no, event_type <> 'error' as ok from events) select upstream, probe_no, ok as healthy from p")
def _(s, d):
    probes = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("upstream"), F.col("event_id").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return stateful.probe_health(probes).select("upstream", F.col("at").alias("probe_no"), "healthy")


@query("majority_vote", "select term, count(*) as votes, sum(case when ok then 1 else 0 end) >= count(*) // 2 + 1 as elected from (select event_id // 5 as term, event_type in ('click', 'view', 'signup') as ok from events) group by term")
def _(s, d):
    votes = s.read.parquet(f"{d}/events.parquet").select(F.floor(F.col("event_id") / 5).alias("term"), F.col("event_type").isin("click", "view", "signup").cast("int").alias("ok"))
    return votes.groupBy("term").agg(F.count("*").alias("votes"), (F.sum("ok") >= F.floor(F.count("*") / 2) + 1).alias("elected"))


@query("ordered_scan", f"select user_key, seq, value from {_newest('log')} where vtype = 1 and user_key >= 'u00000010' order by user_key")
def _(s, d):
    return reads.ordered_scan(_log(s, d), "u00000010").select(*_KV)


_WRITTEN = """(select user_key, seq, vtype, value from log union all
  select 'u' || lpad(cast(c_custkey as varchar), 8, '0'), (select max(seq) from log) + c_custkey, case when c_custkey % 3 = 0 then 2 else 1 end, case when c_custkey % 3 = 0 then '' else c_name end from customer)"""


@query("put_delete", f"select user_key, seq, value from {_newest(_WRITTEN)} where vtype = 1")
def _(s, d):
    op = F.when(F.col("c_custkey") % 3 == 0, "delete").otherwise("put")
    batch = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("pos"), op.alias("op"), F.concat(F.lit("u"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("user_key"), F.col("c_name").alias("value"))
    return reads.latest_live(writes.append(_log(s, d), batch)).select(*_KV)


@query("manifest_snapshot", f", edits as {_EDITS}, live as (select *, row_number() over (partition by level, file_no order by edit_no desc) as r from edits where type <> 'reset' and edit_no > (select max(edit_no) from edits where type = 'reset')) "
    "select (select max(edit_no) from edits) + 2 as edit_no, 'add' as type, cast(level as bigint) as level, file_no from live where r = 1 and type = 'add' union all select max(edit_no) + 1, 'reset', cast(0 as bigint), cast(-1 as bigint) from edits")
def _(s, d):
    runs = _log(s, d).select(F.floor(F.col("seq") / 100).cast("long").alias("run_id")).distinct()
    edit = lambda df, number, kind: df.select(number.alias("edit_no"), F.lit(kind).alias("type"), F.lit(0).cast("long").alias("level"), F.col("run_id").alias("file_no"))
    edits = edit(runs, F.col("run_id") * 2, "add").unionByName(edit(runs.where("run_id % 3 = 0"), F.col("run_id") * 2 + 21, "del"))
    return maintenance.manifest_snapshot(edits.unionByName(s.createDataFrame([(51, "reset", 0, -1)], "edit_no long, type string, level long, file_no long")))


@query("collection_counts", f"select c.name, count(x.c_custkey) as n_keys from (select *, row_number() over (partition by name order by version desc) as r from {_CATALOG}) c left join (select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey) x on x.n_name = c.name where r = 1 and op <> 'delete' group by c.name")
def _(s, d):
    nation = s.read.parquet(f"{d}/nation.parquet")
    entry = lambda df, version, op: df.select(F.col("n_name").alias("name"), F.lit(version).alias("version"), F.lit(op).alias("op"))
    log = entry(nation, 1, "create").unionByName(entry(nation.where("n_nationkey % 2 = 0"), 2, "update")).unionByName(entry(nation.where("n_nationkey % 5 = 0"), 3, "delete"))
    rows = s.read.parquet(f"{d}/customer.parquet").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"))
    return access.collection_counts(log, rows)


@query("apikey_list", "select c_custkey as key_id, cast(case when c_custkey % 4 = 0 then 2 else 1 end as bigint) as version, c_name as name from customer where c_custkey % 6 <> 0")
def _(s, d):
    customers = s.read.parquet(f"{d}/customer.parquet")
    version = lambda df, number, op: df.select(F.col("c_custkey").alias("key_id"), F.lit(number).cast("long").alias("version"), F.lit(op).alias("op"), F.col("c_name").alias("name"), F.sha2(F.col("c_name").cast("binary"), 256).alias("key_hash"))
    log = version(customers, 1, "issue").unionByName(version(customers.where("c_custkey % 4 = 0"), 2, "rename")).unionByName(version(customers.where("c_custkey % 6 = 0"), 3, "revoke"))
    return access.public(access.current(log, "key_id")).drop("op")


@query("url_codec", "select seq, url_encode(value) as escaped, value as plain from log")
def _(s, d):
    return _log(s, d).select("seq", codec.url_escape(F.col("value")).alias("escaped")).withColumn("plain", codec.url_unescape(F.col("escaped")))


@query("base64_values", "select seq, to_base64(encode(value)) as encoded, value as decoded from log")
def _(s, d):
    return _log(s, d).select("seq", F.base64(F.col("value").cast("binary")).alias("encoded")).withColumn("decoded", F.unbase64("encoded").cast("string"))


@query("text_tools", "select p_partkey, lower(p_name) as lowered, trim('  ' || p_name || ' ') as trimmed, regexp_matches(cast(p_size as varchar), '^[0-9]+$') as size_digits, regexp_matches(p_brand, '^[0-9]+$') as brand_digits from part")
def _(s, d):
    name = F.col("p_name")
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.lower(name).alias("lowered"), F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"), codec.digits_only(F.col("p_size").cast("string")).alias("size_digits"), codec.digits_only(F.col("p_brand")).alias("brand_digits"))


@query("fnv64_hash", f"select user_key, cast(list_reduce(list_prepend(cast(14695981039346656037 as hugeint), list_transform(range(1, strlen(user_key) + 1), lambda i: cast(ascii(substring(user_key, i, 1)) as hugeint))), lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616) as varchar) as hash from {_KEYS_SQL}")
def _(s, d):
    return _keys(s, d).select("user_key", hashing.fnv1a_64(F.col("user_key")).cast("decimal(20,0)").cast("string").alias("hash"))


@query("health_transitions", ", p as (select user_id as upstream, event_id as probe_no, event_type <> 'error' as ok from events), "
    "g as (select *, row_number() over (partition by upstream order by probe_no) - row_number() over (partition by upstream, ok order by probe_no) as g from p), "
    "n as (select *, row_number() over (partition by upstream, ok, g order by probe_no) as r from g), f as (select *, case when ok and r >= 2 then true when not ok and r >= 3 then false end as flip from n) "
    "select upstream, probe_no, coalesce(last_value(flip ignore nulls) over (partition by upstream order by probe_no), true) as healthy from f")
def _(s, d):
    probes = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("upstream"), F.col("event_id").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return stateful.probe_health(probes, down_after=3, up_after=2).select("upstream", F.col("at").alias("probe_no"), "healthy")


@query("admission_cap", "select event_id, inflight <= 5 as admitted from (select event_id, sum(case when event_type in ('click', 'view') then 1 else -1 end) over (partition by user_id % 8 order by event_id) as inflight from events)")
def _(s, d):
    step = F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1)
    steps = s.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("user_id") % 8).alias("pool"), F.col("event_id").alias("at"), step.alias("step"))
    return metrics.inflight(steps, 5).select("event_id", "admitted")
