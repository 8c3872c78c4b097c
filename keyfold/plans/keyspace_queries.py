"""Queries over keys: scans, expiry, types, strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.operators import keyspace as ks
from keyfold.operators import oplog
from keyfold.operators import strings as st
from keyfold.plans.registry import query
from keyfold.sources import fixtures as fx
from keyfold.sources.fixtures import NOW_MS


@query("SELECT key, value FROM strings WHERE starts_with(key, 'order:1') ORDER BY key LIMIT 100")
def prefix_scan(spark: SparkSession, sf: str) -> DataFrame:
    return ks.prefix_scan(fx.stored_strings(spark, sf), "order:1", 100)


@query("SELECT key, value FROM strings WHERE key >= 'order:9'")
def iterator_seek(spark: SparkSession, sf: str) -> DataFrame:
    return ks.seek(fx.stored_strings(spark, sf), "order:9")


@query("SELECT key, value FROM strings WHERE key > (SELECT max(key) FROM (SELECT key FROM strings ORDER BY key LIMIT 100)) ORDER BY key LIMIT 50")
def scan_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.stored_strings(spark, sf)
    after = None
    for _ in range(2):
        after = ks.scan_page(rows, after, 50).agg(F.max("key")).first()[0]
    return ks.scan_page(rows, after, 50)


@query("SELECT 'prefix' AS pattern, key FROM strings WHERE starts_with(key, 'order:12') UNION ALL SELECT 'exact', key FROM strings WHERE key = 'order:77'")
def keys_pattern(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.strings(spark, sf)
    return ks.keys(rows, "order:12*").select(F.lit("prefix").alias("pattern"), "key").union(ks.keys(rows, "order:77").select(F.lit("exact"), "key"))


@query("SELECT key FROM strings ORDER BY md5('7:' || key), key LIMIT 1")
def random_key(spark: SparkSession, sf: str) -> DataFrame:
    return ks.random_key(fx.strings(spark, sf), 7)


_REQUESTS = "SELECT range AS pos, 'order:' || (range * 37 % 20000) AS key FROM range(500)"


def _requests(spark: SparkSession) -> DataFrame:
    return spark.range(500).select(F.col("id").alias("pos"), F.concat(F.lit("order:"), (F.col("id") * 37 % 20000).cast("string")).alias("key"))


@query(f"SELECT r.pos, r.key, s.value FROM ({_REQUESTS}) r LEFT JOIN strings s ON r.key = s.key")
def mget(spark: SparkSession, sf: str) -> DataFrame:
    return st.mget(_requests(spark), fx.strings(spark, sf))


@query(f"SELECT count(*) AS n FROM (SELECT key FROM ({_REQUESTS}) UNION ALL SELECT key FROM ({_REQUESTS}) WHERE pos % 2 = 0) WHERE key IN (SELECT key FROM strings)")
def exists_count(spark: SparkSession, sf: str) -> DataFrame:
    r = _requests(spark).select("pos", "key")
    return ks.exists(r.select("key").union(r.where("pos % 2 = 0").select("key")), fx.strings(spark, sf))


@query("SELECT count(*) AS n FROM (SELECT arg_max(op, seq) AS op FROM kv_log GROUP BY key) WHERE op <> 'DEL'")
def dbsize(spark: SparkSession, sf: str) -> DataFrame:
    return oplog.fold_max_by(fx.kv_log(spark, sf), ["value"]).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT 'cust:' || c_custkey AS key, 0 AS place FROM customer UNION ALL SELECT 'cust:' || (o_orderkey % 3000), 4 FROM orders
UNION ALL SELECT 'cust:' || (s_suppkey * 40), 2 FROM supplier UNION ALL SELECT 'cust:' || (p_partkey + 1000), 3 FROM part)
SELECT key, ['hash', 'list', 'set', 'zset', 'string'][min(place) + 1] AS type FROM t GROUP BY key""")
def type_probe(spark: SparkSession, sf: str) -> DataFrame:
    def named(table: str, expr: str) -> DataFrame:
        return spark.read.parquet(f"{sf}/{table}.parquet").select(F.concat(F.lit("cust:"), F.expr(expr).cast("string")).alias("key"))

    return ks.types({"hash": named("customer", "c_custkey"), "string": named("orders", "o_orderkey % 3000"), "set": named("supplier", "s_suppkey * 40"), "zset": named("part", "p_partkey + 1000")})


@query(f"SELECT key, CASE WHEN expire_at > {NOW_MS} THEN (expire_at - {NOW_MS}) // 1000 ELSE -2 END AS ttl, CASE WHEN expire_at > {NOW_MS} THEN expire_at - {NOW_MS} ELSE -2 END AS pttl FROM ttl")
def ttl_remaining(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit(NOW_MS)
    return fx.ttl(spark, sf).select("key", ks.remaining(now, F.col("expire_at")).alias("ttl"), ks.remaining(now, F.col("expire_at"), 1).alias("pttl"))


_LIVE = "SELECT key, arg_max(value, seq) AS value FROM kv_log GROUP BY key HAVING arg_max(op, seq) <> 'DEL'"


@query(f"SELECT key, value FROM ({_LIVE}) WHERE key NOT IN (SELECT key FROM ttl WHERE expire_at <= {NOW_MS})")
def ttl_live(spark: SparkSession, sf: str) -> DataFrame:
    rows = oplog.fold_max_by(fx.kv_log(spark, sf), ["value"]).select("key", "value")
    return ks.live(rows, fx.ttl(spark, sf), F.lit(NOW_MS))


@query(f"SELECT key, value FROM ({_LIVE}) WHERE key IN (SELECT key FROM ttl WHERE expire_at <= {NOW_MS})")
def ttl_expired(spark: SparkSession, sf: str) -> DataFrame:
    rows = oplog.fold_max_by(fx.kv_log(spark, sf), ["value"]).select("key", "value")
    return ks.expired(rows, fx.ttl(spark, sf), F.lit(NOW_MS))


@query("SELECT s.key, coalesce(t.expire_at // 1000, -1) AS at FROM (SELECT DISTINCT key FROM sets UNION SELECT 'user:missing') s LEFT JOIN ttl t ON s.key = t.key")
def expiretime(spark: SparkSession, sf: str) -> DataFrame:
    names = fx.sets(spark, sf).select("key").union(spark.createDataFrame([("user:missing",)], "key string")).distinct()
    return names.join(fx.ttl(spark, sf), "key", "left").select("key", F.coalesce(F.floor(F.col("expire_at") / 1000), F.lit(-1)).cast("long").alias("at"))


@query("SELECT key FROM sets WHERE key NOT IN (SELECT key FROM ttl WHERE expire_at % 2 = 0) GROUP BY key")
def persist_keys(spark: SparkSession, sf: str) -> DataFrame:
    even = fx.ttl(spark, sf).where("expire_at % 2 = 0").select("key")
    return fx.sets(spark, sf).select("key").distinct().join(even, "key", "left_anti")


def _moves(spark: SparkSession) -> DataFrame:
    return spark.range(1, 41).select(F.concat(F.lit("order:"), (F.col("id") * 3).cast("string")).alias("src"), F.concat(F.lit("moved:"), F.col("id").cast("string")).alias("dst"))


_MOVES = "SELECT 'order:' || (range * 3) AS src, 'moved:' || range AS dst FROM range(1, 41)"


@query(f"SELECT coalesce(m.dst, s.key) AS key, s.value FROM strings s LEFT JOIN ({_MOVES}) m ON s.key = m.src")
def rename_move(spark: SparkSession, sf: str) -> DataFrame:
    return ks.rename(fx.strings(spark, sf), _moves(spark)).select("key", "value")


@query("""WITH m AS (SELECT 'order:' || range AS src, 'order:' || (range + 14990) AS dst FROM range(1, 41)),
r AS (SELECT * FROM m WHERE src IN (SELECT key FROM strings) AND dst NOT IN (SELECT key FROM strings))
SELECT coalesce(r.dst, s.key) AS key, s.value FROM strings s LEFT JOIN r ON s.key = r.src""")
def renamenx_move(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda x: F.concat(F.lit("order:"), x.cast("string"))
    moves = spark.range(1, 41).select(name(F.col("id")).alias("src"), name(F.col("id") + 14990).alias("dst"))
    return ks.rename(fx.strings(spark, sf), moves, new_only=True).select("key", "value")


@query("""SELECT doc_id, strlen(text)::BIGINT AS size, hex(encode(text)[1:8]) AS head, hex(encode(text)[-4:]) AS tail FROM documents""".replace("strlen(text)::BIGINT", "coalesce(strlen(text), 0)::BIGINT"))
def getrange_strlen(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", st.strlen(F.col("text")).alias("size"), F.hex(st.getrange(F.col("text"), 0, 7)).alias("head"), F.hex(st.getrange(F.col("text"), -4, -1)).alias("tail"))


@query("""SELECT key, arg_max(value, (seq, pos)) AS value FROM (SELECT seq // 5 AS seq, seq % 5 AS pos, key, value FROM kv_log) GROUP BY key""")
def mset_last(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.kv_log(spark, sf).select(F.floor(F.col("seq") / 5).alias("seq"), (F.col("seq") % 5).alias("pos"), "key", F.lit("PUT").alias("op"), "value")
    return st.set_last(log).select("key", "value")


@query(f"""SELECT r.key, CASE WHEN l.key IS NULL THEN 0 ELSE 1 END AS reply, CASE WHEN l.key IS NOT NULL THEN {NOW_MS} + r.ms END AS expire_at
FROM (SELECT 'user:' || range AS key, range * 1000 AS ms FROM range(400)) r LEFT JOIN ({_LIVE}) l ON r.key = l.key""")
def expire_keys(spark: SparkSession, sf: str) -> DataFrame:
    """EXPIRE on live and missing keys."""
    requests = spark.range(400).select(F.concat(F.lit("user:"), F.col("id").cast("string")).alias("key"), (F.col("id") * 1000).alias("ms"))
    return ks.expire(requests, oplog.fold_max_by(fx.kv_log(spark, sf), ["value"]), F.lit(NOW_MS))


@query(f"""SELECT key, value FROM (SELECT *, epoch_us(ts) // 1000 + floor(amount * 60000)::BIGINT AS expire_at FROM kv_log
QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op <> 'DEL' AND expire_at > {NOW_MS - 3_600_000}""")
def setex_state(spark: SparkSession, sf: str) -> DataFrame:
    """SETEX: values and expiries set together."""
    at = F.unix_millis(F.col("ts").cast("timestamp")) + F.floor(F.col("amount") * 60000).cast("long")
    return st.setex(fx.kv_log(spark, sf).withColumn("expire_at", at), F.lit(NOW_MS - 3_600_000)).select("key", "value")


@query("""SELECT key, seq, CASE WHEN last_op <> 'DEL' THEN last_value END AS old FROM
(SELECT *, lag(op) OVER w AS last_op, lag(value) OVER w AS last_value FROM kv_log WINDOW w AS (PARTITION BY key ORDER BY seq)) WHERE op = 'DEL'""")
def getdel_reply(spark: SparkSession, sf: str) -> DataFrame:
    return st.getdel(fx.kv_log(spark, sf)).select("key", "seq", "old")


@query("""SELECT key, hex(encode(substr(value, 1, 2))) || '58595A' || hex(encode(substr(value, 6))) AS inside,
hex(encode(substr(value, 1, 12))) || repeat('00', (12 - least(12, length(value)))::INTEGER) || '58595A' || hex(encode(substr(value, 16))) AS beyond FROM strings""")
def setrange_bytes(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return fx.strings(spark, sf).select("key", F.hex(st.setrange(v, 2, b"XYZ")).alias("inside"), F.hex(st.setrange(v, 12, b"XYZ")).alias("beyond"))


@query("SELECT key, value FROM strings WHERE starts_with(key, 'order:2')")
def snapshot_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A prefix scan of a stored snapshot: its sorted runs are read where the prefix can be."""
    return fx.stored_strings(spark, sf).where(F.col("key").startswith("order:2"))


@query("SELECT key, value FROM strings WHERE key IN ('order:777', 'order:777x', 'order:1234')")
def bloom_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Point reads of a stored snapshot: statistics and bloom filters of keys skip what can't hold them."""
    return fx.stored_strings(spark, sf).where(F.col("key").isin("order:777", "order:777x", "order:1234"))
