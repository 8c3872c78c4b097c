"""Queries over the operation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.operators import keyspace, oplog
from keyfold.operators import strings as st
from keyfold.plans.asof import as_of
from keyfold.plans.registry import query
from keyfold.sources import fixtures as fx

_LAST = "SELECT * FROM kv_log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1"


@query(f"SELECT key, seq, value FROM ({_LAST}) WHERE op <> 'DEL'")
def lww_fold(spark: SparkSession, sf: str) -> DataFrame:
    return oplog.fold(fx.kv_log(spark, sf)).select("key", "seq", "value")


@query("SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM kv_log GROUP BY key HAVING arg_max(op, seq) <> 'DEL'")
def lww_fold_maxby(spark: SparkSession, sf: str) -> DataFrame:
    return oplog.fold_max_by(fx.kv_log(spark, sf), ["value"])


@query("SELECT key, seq, value FROM (SELECT * FROM kv_log WHERE seq <= 5000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op <> 'DEL'")
def snapshot_read(spark: SparkSession, sf: str) -> DataFrame:
    return oplog.fold(fx.kv_log(spark, sf), snapshot=5000).select("key", "seq", "value")


_TOMBSTONES = [("user:1", "user:2", 9000), ("user:5", "user:55", 100000000), ("user:9", "user:95", 5)]


@query(f"""WITH t(begin_key, end_key, seq) AS (VALUES {", ".join(map(str, _TOMBSTONES))})
SELECT key, seq, value FROM ({_LAST}) l WHERE op <> 'DEL'
  AND NOT EXISTS (SELECT 1 FROM t WHERE l.key >= begin_key AND l.key < end_key AND t.seq > l.seq)""")
def range_tombstone(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.createDataFrame(_TOMBSTONES, "begin_key string, end_key string, seq long")
    return oplog.fold(fx.kv_log(spark, sf), tombstones=t).select("key", "seq", "value")


_MANY = """SELECT 'user:' || (user_id - event_id % 7) AS begin_key, 'user:' || (user_id + event_id % 5) AS end_key, event_id + event_id % 11 * 40 AS seq
FROM events WHERE event_id % 10 = 3"""


@query(f"""WITH t AS ({_MANY}) SELECT key, seq, value FROM ({_LAST}) l WHERE op <> 'DEL'
  AND NOT EXISTS (SELECT 1 FROM t WHERE begin_key < end_key AND l.key >= begin_key AND l.key < end_key AND t.seq > l.seq)""")
def range_tombstones_many(spark: SparkSession, sf: str) -> DataFrame:
    """As many range deletions as a tenth of the log, of any width, one over another."""
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_id % 10 = 3")
    name = lambda x: F.concat(F.lit("user:"), F.expr(x).cast("string"))
    t = e.select(name("user_id - event_id % 7").alias("begin_key"), name("user_id + event_id % 5").alias("end_key"), F.expr("event_id + event_id % 11 * 40").alias("seq"))
    return oplog.fold(fx.kv_log(spark, sf), tombstones=t).select("key", "seq", "value")


@query("SELECT seq // 10 AS batch, seq, key FROM kv_log WHERE seq % 97 <> 13 QUALIFY count(*) OVER (PARTITION BY seq // 10) = 10")
def batch_commit(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.kv_log(spark, sf).where("seq % 97 <> 13")
    batch = F.floor(F.col("seq") / 10)
    return oplog.commit_batches(log, batch, 10).select(batch.alias("batch"), "seq", "key")


@query("""WITH b AS (SELECT key, op, value, seq FROM kv_log WHERE seq <= 4000
  UNION ALL SELECT key, CASE WHEN seq % 3 = 0 THEN 'DEL' ELSE 'PUT' END, 'txn', seq + 4000 FROM kv_log WHERE seq BETWEEN 6000 AND 6050)
SELECT key, value FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op <> 'DEL'""")
def txn_overlay(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.kv_log(spark, sf).select("seq", "key", "op", "value")
    own = log.where("seq BETWEEN 6000 AND 6050").select("seq", "key", F.expr("CASE WHEN seq % 3 = 0 THEN 'DEL' ELSE 'PUT' END").alias("op"), F.lit("txn").alias("value"))
    return oplog.overlay(log, own, 4000).select("key", "value")


@query("""SELECT prefix, sum(n)::BIGINT AS n_in, count(*) FILTER (op <> 'DEL') AS n_out, (sum(n) - count(*) FILTER (op <> 'DEL'))::BIGINT AS n_dropped
FROM (SELECT substr(key, 1, 6) AS prefix, arg_max(op, seq) AS op, count(*) AS n FROM kv_log GROUP BY key) GROUP BY prefix""")
def compaction_stats(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.kv_log(spark, sf)
    sizes = log.groupBy(F.substring("key", 1, 6).alias("prefix")).agg(F.count(F.lit(1)).alias("n_in"))
    kept = oplog.compact(log).groupBy(F.substring("key", 1, 6).alias("prefix")).agg(F.count(F.lit(1)).alias("n_out"))
    n_out = F.coalesce("n_out", F.lit(0).cast("long"))
    return sizes.join(kept, "prefix", "left").select("prefix", "n_in", n_out.alias("n_out"), (F.col("n_in") - n_out).alias("n_dropped"))


@query("""WITH v AS (SELECT key, seq, op, CASE WHEN seq <= 2500 THEN 0 WHEN seq <= 5000 THEN 1 WHEN seq <= 7500 THEN 2 ELSE 3 END AS i FROM kv_log),
k AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY key, i ORDER BY seq DESC) = 1)
SELECT key, seq, op FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS nth FROM k) WHERE NOT (nth = 1 AND op = 'DEL')""")
def versions_per_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return oplog.compact(fx.kv_log(spark, sf), (2500, 5000, 7500)).select("key", "seq", "op")


@query(f"SELECT key, seq, value FROM ({_LAST}) WHERE op <> 'DEL'")
def merge_runs(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.kv_log(spark, sf)
    runs = [log.where((F.col("seq") % 4) == i) for i in range(4)]
    return oplog.merge_runs(runs).select("key", "seq", "value")


@query("""SELECT o.o_orderkey AS orderkey, e.value FROM (SELECT *, o_orderkey % 100 AS user_id FROM orders) o
ASOF JOIN kv_log e ON e.user_id = o.user_id AND e.seq <= o.o_orderkey""")
def asof_lookup(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 100).alias("user_id"))
    found = as_of(o, fx.kv_log(spark, sf).select("user_id", "seq", "value"), ["user_id"], "o_orderkey", "seq", ["value"])
    return found.where("value IS NOT NULL").select(F.col("o_orderkey").alias("orderkey"), "value")


_SO_FAR = "PARTITION BY key, epoch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_EPOCHS = "SELECT *, sum(CASE WHEN op = 'DEL' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch FROM kv_log"


@query(f"""SELECT key, seq, reply FROM (SELECT *, (sum(CASE WHEN op = 'DEL' THEN 0 ELSE round(amount * 100)::BIGINT END) OVER ({_SO_FAR}))::BIGINT AS reply
FROM ({_EPOCHS})) WHERE op <> 'DEL'""")
def incr_running(spark: SparkSession, sf: str) -> DataFrame:
    return st.incr(fx.kv_log(spark, sf), F.round(F.col("amount") * 100).cast("long")).select("key", "seq", "reply")


@query("""SELECT key, seq, CASE WHEN last_op <> 'DEL' THEN last_value END AS old FROM
(SELECT *, lag(op) OVER w AS last_op, lag(value) OVER w AS last_value FROM kv_log WINDOW w AS (PARTITION BY key ORDER BY seq)) WHERE op <> 'DEL'""")
def getset_lag(spark: SparkSession, sf: str) -> DataFrame:
    return st.getset(fx.kv_log(spark, sf)).select("key", "seq", "old")


@query(f"SELECT key, seq, CASE WHEN row_number() OVER (PARTITION BY key, epoch ORDER BY seq) = 1 THEN 1 ELSE 0 END AS reply FROM ({_EPOCHS}) WHERE op <> 'DEL'")
def setnx_first(spark: SparkSession, sf: str) -> DataFrame:
    return st.setnx(fx.kv_log(spark, sf)).select("key", "seq", "reply")


@query(f"""SELECT key, seq, reply FROM (SELECT *, (sum(CASE WHEN op = 'DEL' THEN 0 ELSE strlen(value) END) OVER ({_SO_FAR}))::BIGINT AS reply FROM ({_EPOCHS})) WHERE op <> 'DEL'""")
def append_len(spark: SparkSession, sf: str) -> DataFrame:
    return st.append(fx.kv_log(spark, sf)).select("key", "seq", "reply")


@query(f"""SELECT key, string_agg(value, '' ORDER BY seq) AS value FROM (SELECT *, max(epoch) OVER (PARTITION BY key) AS last FROM ({_EPOCHS}))
WHERE op <> 'DEL' AND epoch = last GROUP BY key""")
def append_value(spark: SparkSession, sf: str) -> DataFrame:
    return st.appended(fx.kv_log(spark, sf))


@query(f"""SELECT key, seq, printf('%.6f', reply / 4.0::DOUBLE) AS text FROM (SELECT *, (sum(CASE WHEN op = 'DEL' THEN 0 ELSE round(amount * 4)::BIGINT END) OVER ({_SO_FAR}))::BIGINT AS reply
FROM ({_EPOCHS})) WHERE op <> 'DEL'""")
def incrbyfloat_text(spark: SparkSession, sf: str) -> DataFrame:
    """Running sums of fractions, as text; quarters add up exactly whatever the order of sums."""
    return st.incrbyfloat(fx.kv_log(spark, sf), F.round(F.col("amount") * 4) / 4).select("key", "seq", F.col("reply").alias("text"))


@query("""SELECT count(*) FILTER (op = 'PUT') AS n_put, count(*) FILTER (op = 'DEL') AS n_del, count(*) AS n_all FROM kv_log""")
def stats_counters(spark: SparkSession, sf: str) -> DataFrame:
    return keyspace.stats(fx.kv_log(spark, sf), ("PUT", "DEL"))


@query("SELECT seq, key, amount FROM kv_log WHERE amount >= 40 ORDER BY seq DESC LIMIT 25")
def slowlog_topn(spark: SparkSession, sf: str) -> DataFrame:
    return keyspace.slow_log(fx.kv_log(spark, sf), F.col("amount") >= 40, 25).select("seq", "key", "amount")
