"""Queries over feeds and streams, run until they have read everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.plans.registry import query
from keyfold.session import new_folder
from keyfold.sources import fixtures as fx
from keyfold.streaming import feeds
from keyfold.streaming.expiry import expired

#: Files of the log may come in any order, so rows may be as late as the log is long.
_LATE = "60 days"
_COLUMNS = ("seq", "key", "op", "value", "ts")


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The log as a stream of several files."""
    log = fx.kv_log(spark, sf).select(*_COLUMNS)
    path = new_folder(spark, "log")
    log.repartitionByRange(3, "seq").write.parquet(path)
    return feeds.log_stream(spark, path, log.schema, 1)


@query("""SELECT 'user:1*' AS pattern, key, op AS event, seq AS revision FROM kv_log WHERE starts_with(key, 'user:1')
UNION ALL SELECT 'user:17', key, op, seq FROM kv_log WHERE key = 'user:17'""")
def watch_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.watch(fx.kv_log(spark, sf), ["user:1*", "user:17"])


@query("SELECT 'user:1*' AS pattern, key, op AS event, seq AS revision FROM kv_log WHERE starts_with(key, 'user:1')")
def watch_stream(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.run_once(feeds.watch(_stream(spark, sf), ["user:1*"]), "append")


@query("""SELECT seq, (stop - size)::BIGINT AS begin_at, stop::BIGINT AS end_at FROM (SELECT seq, strlen(value) + 8 AS size,
sum(strlen(value) + 8) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM kv_log)""")
def repl_offsets(spark: SparkSession, sf: str) -> DataFrame:
    placed = feeds.offsets(fx.kv_log(spark, sf).select("seq", "value"))
    return placed.select("seq", F.col("begin").alias("begin_at"), F.col("end").alias("end_at"))


@query("""SELECT s.subscriber, 'channel:' || value AS channel, seq AS message FROM kv_log JOIN
(VALUES ('a', 'click'), ('b', 'click'), ('b', 'view')) s(subscriber, name) ON kv_log.value = s.name""")
def publish_channels(spark: SparkSession, sf: str) -> DataFrame:
    channel = lambda c: F.concat(F.lit("channel:"), c)
    messages = fx.kv_log(spark, sf).select(channel(F.col("value")).alias("channel"), F.col("seq").alias("message"))
    subs = spark.createDataFrame([("a", "click"), ("b", "click"), ("b", "view")], "subscriber string, name string")
    return feeds.publish(messages, subs.select("subscriber", channel(F.col("name")).alias("channel"))).select("subscriber", "channel", "message")


@query("SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM kv_log GROUP BY key HAVING arg_max(op, seq) <> 'DEL'")
def stream_fold(spark: SparkSession, sf: str) -> DataFrame:
    folded = feeds.latest_of_updates(feeds.run_once(feeds.folded_stream(_stream(spark, sf)), "update"), ["key"])
    return folded.where("op <> 'DEL'").select("key", "seq", "value")


@query("""WITH l AS (SELECT key, seq, op, value, epoch_us(ts) // 1000 + floor(amount * 60000)::BIGINT AS expire_at FROM kv_log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
SELECT key, seq, value, expire_at FROM l WHERE op <> 'DEL' AND expire_at <= (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM kv_log)""")
def stream_ttl_expired(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that a stream drops when the watermark passes their expiry."""
    log = fx.kv_log(spark, sf).select("seq", "key", "op", "value", F.col("ts").cast("timestamp").alias("ts"), (F.unix_millis(F.col("ts").cast("timestamp")) + F.floor(F.col("amount") * 60000).cast("long")).alias("expire_at"))
    path = new_folder(spark, "log")
    log.write.parquet(path)
    return feeds.run_once(expired(feeds.log_stream(spark, path, log.schema)), "append")


@query("""WITH l AS (SELECT key, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM kv_log WINDOW w AS (PARTITION BY key ORDER BY seq)),
s AS (SELECT key, ts, sum(new) OVER (PARTITION BY key ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM l)
SELECT key, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s GROUP BY key, run""")
def stream_ttl_sessions(spark: SparkSession, sf: str) -> DataFrame:
    found = feeds.run_once(feeds.sessions(_stream(spark, sf), "6 hours", _LATE), "complete")
    return found.select("key", F.unix_micros("start").alias("start_us"), (F.unix_micros("end") - 6 * 3600 * 1_000_000).alias("last_us"), "n")


@query("SELECT key, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, count(*) AS n FROM kv_log GROUP BY ALL")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    found = feeds.latest_of_updates(feeds.run_once(feeds.windows(_stream(spark, sf), "1 day", late=_LATE), "update"), ["key", "start"])
    return found.select("key", F.unix_micros("start").alias("start_us"), "n")
