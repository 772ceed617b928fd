"""Catalogue, credentials, permissions, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: which role may do what
ROLE_PERMISSIONS = {
    "admin": ("kv:get", "kv:put", "kv:delete", "collection:create", "collection:delete", "user:manage", "apikey:issue"),
    "writer": ("kv:get", "kv:put", "collection:create"),
    "reader": ("kv:get",),
}
# fixed values: the permission that an HTTP method needs
METHOD_PERMISSIONS = {"GET": "kv:get", "POST": "kv:put", "PUT": "kv:put", "DELETE": "kv:delete"}


def collections(log: DataFrame) -> DataFrame:
    """Current rows of a catalogue log (name, version, op, ...): the newest version of a name unless it is a delete."""
    order = Window.partitionBy("name").orderBy(F.desc("version"))
    return log.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r").where(F.col("op") != "delete")


def alive(expires_at: Column, now: Column) -> Column:
    """Whether something has not expired; a null or zero expiry is never."""
    return expires_at.isNull() | (expires_at == 0) | (expires_at > now)


def verify_keys(presented: DataFrame, keys: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """(key_id, user_id, role) of presented plain keys: hash known, not revoked, not expired, user exists."""
    hashed = presented.withColumn("key_hash", F.sha2(F.col("plain").cast("binary"), 256))
    valid = keys.where(~F.col("revoked") & alive(F.col("expires_at"), now))
    return hashed.join(valid, "key_hash").join(users, "user_id").select("key_id", "user_id", "role")


def permissions(spark) -> DataFrame:
    return spark.createDataFrame([(r, p) for r, all_ in ROLE_PERMISSIONS.items() for p in all_], "role string, perm string")


def needed_permission(method: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, perm in METHOD_PERMISSIONS.items():
        out = F.when(method == name, F.lit(perm)).otherwise(out)
    return out


def allowed(requests: DataFrame) -> DataFrame:
    """Requests (role, method, ...) that the role's permissions cover; unknown roles have none."""
    asked = requests.withColumn("perm", needed_permission(F.col("method")))
    return asked.join(F.broadcast(permissions(requests.sparkSession)), ["role", "perm"], "left_semi")


def not_revoked(tokens: DataFrame, revoked: DataFrame, now: Column) -> DataFrame:
    """Tokens whose id is in no revocation that still holds."""
    return tokens.join(revoked.where(F.col("expires_at") > now), "jti", "left_anti")


def match_prefix(requests: DataFrame, prefixes: list[tuple[str, str]], path: str = "path") -> DataFrame:
    """Add ``route`` of the longest prefix that a path begins with (null: none). Prefixes are a literal list."""
    out = F.lit(None).cast("string")
    for prefix, route in sorted(prefixes, key=lambda p: (len(p[0]), p[0])):
        out = F.when(F.startswith(path, F.lit(prefix)), F.lit(route)).otherwise(out)
    return requests.withColumn("route", out)


def match_pattern(method: Column, path: Column, routes: list[tuple[str, str, str]]) -> Column:
    """Name of the first registered route (method, pattern with :params, name) that fits; 404 otherwise."""
    out = F.lit("404")
    for verb, pattern, name in reversed(routes):
        regex = "^" + "/".join("[^/]+" if part.startswith(":") else part for part in pattern.split("/")) + "$"
        out = F.when((method == verb) & path.rlike(regex), F.lit(name)).otherwise(out)
    return out


def parameters(path: Column, pattern: str) -> Column:
    """map<string,string> of a pattern's :params in a path that it fits."""
    parts = F.split(path, "/")
    pairs = [v for i, part in enumerate(pattern.split("/")) if part.startswith(":") for v in (F.lit(part[1:]), F.get(parts, F.lit(i)))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def retryable(status: Column) -> Column:
    return (status >= 500) | (status == 429)


def backoff_ms(attempt: Column) -> Column:
    """Wait before a retry, without its jitter."""
    return (F.pow(F.lit(2.0), attempt) * 100).cast("long")


#: Columns that listings never show.
SECRETS = ("key_hash", "password_hash", "secret")


def public(rows: DataFrame) -> DataFrame:
    """Rows of users or keys without their secrets."""
    return rows.drop(*(c for c in rows.columns if c in SECRETS))


def current(log: DataFrame, key: str) -> DataFrame:
    """The newest version of each user or key of a log (key, version, op, ...), unless it is a delete or a revocation."""
    order = Window.partitionBy(key).orderBy(F.desc("version"))
    return log.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r").where(~F.col("op").isin("delete", "revoke"))


def collection_counts(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """(name, n_keys) of each collection of a catalogue log, those without rows (name, ...) too."""
    counts = rows.groupBy("name").agg(F.count("*").alias("n_keys"))
    return collections(catalog).select("name").join(counts, "name", "left").select("name", F.coalesce("n_keys", F.lit(0)).alias("n_keys"))
