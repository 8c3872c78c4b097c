"""Queries over hashes, lists and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.operators import hashes as hs
from keyfold.operators import lists as ls
from keyfold.operators import sets as ss
from keyfold.plans.registry import query
from keyfold.sources import fixtures as fx


def _hash_log(spark: SparkSession, sf: str) -> DataFrame:
    """Writes of several fields: five events share a write."""
    return fx.part_log(spark, sf).select(F.floor(F.col("seq") / 5).alias("seq"), (F.col("seq") % 5).alias("pos"), "op", "key", F.col("part").alias("field"))


def added_sql(log: str, part: str, order: str) -> str:
    """Rows of a log that put a part, with ``new``: whether the last operation on it since the key's
    last deletion was not a put."""
    return f"""SELECT *, CASE WHEN coalesce(last_op, 'REM') = 'PUT' THEN 0 ELSE 1 END AS new FROM (SELECT *, lag(op) OVER (PARTITION BY key, epoch, {part} ORDER BY {order}) AS last_op
FROM (SELECT *, count(*) FILTER (op = 'DEL') OVER (PARTITION BY key ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch FROM ({log}))) WHERE op = 'PUT'"""


def sums_sql(log: str, part: str, delta: str) -> str:
    """Running sums of a part's puts since it, or the key, was last deleted."""
    so_far = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""SELECT * FROM (SELECT *, (sum(CASE WHEN op = 'PUT' THEN {delta} END) OVER (PARTITION BY key, epoch, {part}, life ORDER BY seq {so_far}))::BIGINT AS reply
FROM (SELECT *, count(*) FILTER (op = 'REM') OVER (PARTITION BY key, epoch, {part} ORDER BY seq {so_far}) AS life
FROM (SELECT *, count(*) FILTER (op = 'DEL') OVER (PARTITION BY key ORDER BY seq {so_far}) AS epoch FROM ({log})))) WHERE op = 'PUT'"""


_HASH_LOG = "SELECT seq // 5 AS seq, seq % 5 AS pos, op, key, part AS field FROM part_log"


@query(f"SELECT seq, key, sum(new)::BIGINT AS reply FROM ({added_sql(_HASH_LOG, 'field', 'seq, pos')}) GROUP BY seq, key")
def hset_new_fields(spark: SparkSession, sf: str) -> DataFrame:
    return hs.hset(_hash_log(spark, sf))


@query("""SELECT l.key, part AS field, arg_max(seq, seq)::VARCHAR AS value FROM part_log l LEFT JOIN (SELECT key, max(seq) AS gone FROM part_log WHERE op = 'DEL' GROUP BY key) d ON l.key = d.key
WHERE op <> 'DEL' AND seq > coalesce(gone, 0) GROUP BY l.key, part HAVING arg_max(op, seq) = 'PUT'""")
def hmset_state(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes after writes and deletions of fields and keys."""
    log = fx.part_log(spark, sf).withColumnRenamed("part", "field").withColumn("value", F.col("seq").cast("string"))
    return hs.hmset(log)


@query("SELECT key, string_agg(field || '=' || value, ',' ORDER BY field) AS fields FROM hashes GROUP BY key")
def hgetall(spark: SparkSession, sf: str) -> DataFrame:
    text = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e.key, F.lit("="), e.value)), ",")
    return hs.hgetall(fx.hashes(spark, sf)).select("key", text.alias("fields"))


_FIELDS = "SELECT r.range AS pos, 'cust:' || (r.range * 13 % 2000) AS key, f.field FROM range(300) r, (VALUES ('name'), ('cents'), ('none')) f(field)"


def _fields(spark: SparkSession) -> DataFrame:
    fields = F.array(*[F.lit(x) for x in ("name", "cents", "none")])
    return spark.range(300).select(F.col("id").alias("pos"), F.concat(F.lit("cust:"), (F.col("id") * 13 % 2000).cast("string")).alias("key"), F.explode(fields).alias("field"))


@query(f"SELECT r.pos, r.key, r.field, h.value FROM ({_FIELDS}) r LEFT JOIN hashes h ON r.key = h.key AND r.field = h.field")
def hmget(spark: SparkSession, sf: str) -> DataFrame:
    return hs.hmget(fx.hashes(spark, sf), _fields(spark))


@query("SELECT key, count(*) AS n FROM hashes GROUP BY key")
def hlen(spark: SparkSession, sf: str) -> DataFrame:
    return hs.hlen(fx.hashes(spark, sf))


@query("SELECT key, string_agg(field, ',' ORDER BY field) AS fields, string_agg(value, ',' ORDER BY field) AS vals FROM hashes GROUP BY key")
def hkeys_hvals(spark: SparkSession, sf: str) -> DataFrame:
    return hs.hgetall(fx.hashes(spark, sf)).select("key", F.array_join(F.map_keys("fields"), ",").alias("fields"), F.array_join(F.map_values("fields"), ",").alias("vals"))


@query(f"SELECT key, seq, field, reply FROM ({sums_sql('SELECT *, part AS field FROM part_log', 'field', 'round(amount)::BIGINT')})")
def hincrby(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.part_log(spark, sf).withColumnRenamed("part", "field")
    return hs.hincrby(log, F.round("amount").cast("long")).select("key", "seq", "field", "reply")


@query("SELECT key, strlen(value)::BIGINT AS size FROM hashes WHERE field = 'name'")
def hstrlen(spark: SparkSession, sf: str) -> DataFrame:
    return fx.hashes(spark, sf).where("field = 'name'").select("key", F.octet_length("value").cast("long").alias("size"))


@query(f"SELECT r.pos, r.key, r.field, CASE WHEN h.key IS NULL THEN 0 ELSE 1 END AS there FROM ({_FIELDS}) r LEFT JOIN hashes h ON r.key = h.key AND r.field = h.field")
def hexists(spark: SparkSession, sf: str) -> DataFrame:
    return hs.hexists(fx.hashes(spark, sf), _fields(spark)).select("pos", "key", "field", "there")


@query(f"SELECT key, field, value FROM hashes h WHERE NOT EXISTS (SELECT 1 FROM ({_FIELDS}) r WHERE r.key = h.key AND r.field = h.field)")
def hdel(spark: SparkSession, sf: str) -> DataFrame:
    return hs.hdel(fx.hashes(spark, sf), _fields(spark).select("key", "field")).select("key", "field", "value")


@query(f"SELECT seq, pos, key, field, new::BIGINT AS reply FROM ({added_sql(_HASH_LOG, 'field', 'seq, pos')})")
def hsetnx_first(spark: SparkSession, sf: str) -> DataFrame:
    return hs.hset_if_missing(_hash_log(spark, sf)).select("seq", "pos", "key", "field", "reply")


@query("SELECT key, field, value FROM hashes WHERE key = 'cust:7' AND field > 'cents' ORDER BY field LIMIT 2")
def hscan_page(spark: SparkSession, sf: str) -> DataFrame:
    return hs.hscan(fx.hashes(spark, sf), "cust:7", "cents", 2)


_PLACED = "SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM lists"


@query(f"SELECT key, pos, value FROM ({_PLACED}) WHERE pos BETWEEN greatest(n - 3, 0) AND n - 1")
def lrange_pos(spark: SparkSession, sf: str) -> DataFrame:
    return ls.lrange(fx.lists(spark, sf), -3, -1).select("key", F.col("pos").cast("long").alias("pos"), "value")


@query(f"SELECT key, value FROM ({_PLACED}) WHERE pos = n - 2")
def lindex_neg(spark: SparkSession, sf: str) -> DataFrame:
    return ls.lindex(fx.lists(spark, sf), -2).select("key", "value")


@query("SELECT key, count(*) AS n FROM lists GROUP BY key")
def llen(spark: SparkSession, sf: str) -> DataFrame:
    return ls.llen(fx.lists(spark, sf))


@query("SELECT key, seq, n AS reply, -n AS idx FROM (SELECT key, seq, count(*) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM kv_log)")
def lpush_order(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.kv_log(spark, sf).select("seq", F.lit(0).alias("pos"), "key", "value")
    return ls.push(log, left=True).select("key", "seq", "reply", "idx")


@query("SELECT key, seq, n AS reply, n - 1 AS idx FROM (SELECT key, seq, count(*) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM kv_log)")
def rpush_order(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.kv_log(spark, sf).select("seq", F.lit(0).alias("pos"), "key", "value")
    return ls.push(log, left=False).select("key", "seq", "reply", "idx")


@query(f"SELECT key, pos - 1 AS idx, value FROM ({_PLACED}) WHERE pos BETWEEN 1 AND 3")
def ltrim(spark: SparkSession, sf: str) -> DataFrame:
    return ls.ltrim(fx.lists(spark, sf), 1, 3)


def _lrem_sql(order: str, test: str) -> str:
    return f"""SELECT key, row_number() OVER (PARTITION BY key ORDER BY idx) - 1 AS idx, value FROM
    (SELECT *, row_number() OVER (PARTITION BY key, value ORDER BY idx {order}) AS nth FROM lists) WHERE NOT (value = 'user' AND {test})"""


@query(_lrem_sql("ASC", "nth <= 1"))
def lrem_first(spark: SparkSession, sf: str) -> DataFrame:
    return ls.lrem(fx.lists(spark, sf), 1, F.lit("user"))


@query(_lrem_sql("DESC", "nth <= 2"))
def lrem_last(spark: SparkSession, sf: str) -> DataFrame:
    return ls.lrem(fx.lists(spark, sf), -2, F.lit("user"))


@query(_lrem_sql("ASC", "true"))
def lrem_all(spark: SparkSession, sf: str) -> DataFrame:
    return ls.lrem(fx.lists(spark, sf), 0, F.lit("user"))


@query(f"SELECT key, idx, CASE WHEN pos = n - 1 THEN 'last' ELSE value END AS value FROM ({_PLACED})")
def lset(spark: SparkSession, sf: str) -> DataFrame:
    return ls.lset(fx.lists(spark, sf), -1, F.lit("last"))


@query("SELECT key, arg_min(value, idx) AS head, arg_max(value, idx) AS tail FROM lists GROUP BY key")
def pop_ends(spark: SparkSession, sf: str) -> DataFrame:
    return ls.ends(fx.lists(spark, sf))


@query("""WITH p AS (SELECT key, min(idx) AS place FROM lists WHERE value = 'assistant' GROUP BY key),
a AS (SELECT key, idx * 2 AS idx, value FROM lists UNION ALL SELECT key, place * 2 - 1, 'new' FROM p)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY idx) - 1 AS idx, value FROM a""")
def linsert_before(spark: SparkSession, sf: str) -> DataFrame:
    return ls.linsert(fx.lists(spark, sf), F.lit("assistant"), F.lit("new"))


_PUSHES = "CASE value WHEN 'error' THEN 'RPOP' WHEN 'signup' THEN 'LPOP' WHEN 'view' THEN 'LPUSH' ELSE 'RPUSH' END"


@query(f"""WITH RECURSIVE l AS (SELECT key, {_PUSHES} AS op, seq::VARCHAR AS v, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM kv_log),
r AS (SELECT DISTINCT key, 0::BIGINT AS n, []::VARCHAR[] AS items FROM kv_log UNION ALL
  SELECT l.key, l.n, CASE l.op WHEN 'LPUSH' THEN list_prepend(l.v, r.items) WHEN 'RPUSH' THEN list_append(r.items, l.v)
    WHEN 'LPOP' THEN list_slice(r.items, 2, len(r.items)) ELSE list_slice(r.items, 1, len(r.items) - 1) END FROM r JOIN l ON l.key = r.key AND l.n = r.n + 1)
SELECT r.key, coalesce(array_to_string(items, ','), '') AS items FROM r JOIN (SELECT key, max(n) AS n FROM l GROUP BY key) m ON r.key = m.key AND r.n = m.n""")
def list_log(spark: SparkSession, sf: str) -> DataFrame:
    """Pushes and pops in any order."""
    op = F.expr(_PUSHES)
    log = fx.kv_log(spark, sf).select("seq", "key", op.alias("op"), F.col("seq").cast("string").alias("value"))
    return ls.interleaved(log).select("key", F.array_join("items", ",").alias("items"))


@query(f"SELECT key, seq, new AS reply FROM ({added_sql('SELECT *, part AS member FROM part_log', 'member', 'seq')})")
def sadd_new(spark: SparkSession, sf: str) -> DataFrame:
    return ss.sadd(fx.part_log(spark, sf).withColumnRenamed("part", "member")).select("key", "seq", "reply")


@query("SELECT key, string_agg(member, ',' ORDER BY member) AS members FROM sets GROUP BY key")
def smembers(spark: SparkSession, sf: str) -> DataFrame:
    return ss.smembers(fx.sets(spark, sf)).select("key", F.array_join("members", ",").alias("members"))


@query("SELECT key, count(DISTINCT member) AS n FROM supplier_parts GROUP BY key")
def scard(spark: SparkSession, sf: str) -> DataFrame:
    return ss.scard(fx.supplier_parts(spark, sf))


@query("""SELECT r.key, r.member, CASE WHEN s.key IS NULL THEN 0 ELSE 1 END AS there FROM
(SELECT DISTINCT 'user:' || (range * 7 % 300) AS key, ['click', 'view', 'buy'][range % 3 + 1] AS member FROM range(300)) r LEFT JOIN sets s ON r.key = s.key AND r.member = s.member""")
def sismember(spark: SparkSession, sf: str) -> DataFrame:
    member = F.element_at(F.array(*[F.lit(x) for x in ("click", "view", "buy")]), (F.col("id") % 3 + 1).cast("int"))
    r = spark.range(300).select(F.concat(F.lit("user:"), (F.col("id") * 7 % 300).cast("string")).alias("key"), member.alias("member")).distinct()
    return ss.sismember(fx.sets(spark, sf), r)


@query("SELECT key, member FROM sets WHERE member NOT IN ('click', 'error')")
def srem(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.sets(spark, sf)
    return ss.srem(rows, rows.where("member IN ('click', 'error')"))


@query("SELECT key, max(member) AS member FROM sets GROUP BY key")
def spop_max(spark: SparkSession, sf: str) -> DataFrame:
    return ss.spop(fx.sets(spark, sf))


@query("SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM sets) WHERE pos = n // 2")
def srandmember_mid(spark: SparkSession, sf: str) -> DataFrame:
    return ss.srandmember(fx.sets(spark, sf))


@query("""SELECT DISTINCT CASE WHEN key = 'user:1' AND member = 'view' THEN 'user:2' ELSE key END AS key, member FROM sets""")
def smove(spark: SparkSession, sf: str) -> DataFrame:
    return ss.smove(fx.sets(spark, sf), "user:1", "user:2", "view")


_OF = "SELECT member FROM supplier_parts WHERE key = 'supp:{}'"


@query(f"{_OF.format(1)} INTERSECT {_OF.format(2)}")
def sinter(spark: SparkSession, sf: str) -> DataFrame:
    return ss.sinter(fx.supplier_parts(spark, sf), "supp:1", "supp:2")


@query(f"{_OF.format(1)} UNION {_OF.format(2)}")
def sunion(spark: SparkSession, sf: str) -> DataFrame:
    return ss.sunion(fx.supplier_parts(spark, sf), "supp:1", "supp:2")


@query(f"{_OF.format(1)} EXCEPT {_OF.format(2)}")
def sdiff(spark: SparkSession, sf: str) -> DataFrame:
    return ss.sdiff(fx.supplier_parts(spark, sf), "supp:1", "supp:2")
