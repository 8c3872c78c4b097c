"""The data model's tables from the supplied ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.session import exists, new_folder, table


def _name(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def kv_log(spark: SparkSession, sf: str) -> DataFrame:
    """(seq, key, op, value, amount, ts): events as operations on users; an error deletes."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        _name("user:", "user_id").alias("key"),
        F.when(F.col("event_type") == "error", "DEL").otherwise("PUT").alias("op"),
        F.col("event_type").alias("value"),
        F.col("value").alias("amount"),
        "ts",
        "user_id",
    )


def part_log(spark: SparkSession, sf: str) -> DataFrame:
    """(seq, op, key, part, amount): writes to parts of users' hashes and sets; a sign-up removes a
    part, an error the whole key."""
    op = F.when(F.col("value") == "error", "DEL").when(F.col("value") == "signup", "REM").otherwise("PUT")
    return kv_log(spark, sf).select("seq", op.alias("op"), "key", F.concat(F.lit("part"), (F.col("seq") % 4).cast("string")).alias("part"), "amount")


def strings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(_name("order:", "o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"))


_stored: dict = {}


def stored_strings(spark: SparkSession, sf: str) -> DataFrame:
    """``strings`` as a stored snapshot of sorted runs, written once a session."""
    from keyfold.sources.storage import write_snapshot

    key = (spark.sparkContext.applicationId, sf)
    if key not in _stored or not exists(spark, _stored[key]):
        path = new_folder(spark, "snapshot")
        write_snapshot(strings(spark, sf), path)
        _stored[key] = path
    return spark.read.schema("key string, value string").parquet(_stored[key])


def hashes(spark: SparkSession, sf: str) -> DataFrame:
    """(key, field, value): customers' name, nation, segment and balance in cents."""
    c = table(spark, sf, "customer")
    fields = {
        "name": F.col("c_name"),
        "nation": F.col("c_nationkey").cast("string"),
        "segment": F.col("c_mktsegment"),
        "cents": F.round(F.col("c_acctbal") * 100).cast("long").cast("string"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in fields.items()])
    return c.select(_name("cust:", "c_custkey").alias("key"), F.inline(pairs))


def lists(spark: SparkSession, sf: str) -> DataFrame:
    """(key, idx, value): roles of a conversation's turns."""
    c = table(spark, sf, "conversations")
    return c.select(_name("conv:", "conv_id").alias("key"), F.col("turn").alias("idx"), F.col("role").alias("value"))


def sets(spark: SparkSession, sf: str) -> DataFrame:
    """(key, member): event types of each user."""
    return kv_log(spark, sf).select("key", F.col("value").alias("member")).distinct()


def supplier_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(_name("supp:", "l_suppkey").alias("key"), _name("part:", "l_partkey").alias("member"))
    return rows.distinct()


def zsets(spark: SparkSession, sf: str) -> DataFrame:
    """(key, member, score): customers of a segment by balance."""
    c = table(spark, sf, "customer")
    return c.select(F.col("c_mktsegment").alias("key"), _name("cust:", "c_custkey").alias("member"), F.col("c_acctbal").alias("score"))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.lit("parts").alias("key"), _name("part:", "p_partkey").alias("member"), F.col("p_retailprice").alias("score"))


def bitmaps(spark: SparkSession, sf: str) -> DataFrame:
    """(key, offset): users seen on a day."""
    rows = kv_log(spark, sf).select(F.date_format("ts", "yyyy-MM-dd").alias("key"), F.col("user_id").alias("offset"))
    return rows.distinct()


def places(spark: SparkSession, sf: str) -> DataFrame:
    """(key, member, lon, lat): customers at places worked out from their numbers."""
    c = table(spark, sf, "customer")
    lon = (F.col("c_custkey") * 7919 % 360000) / 1000.0 - 180.0 + 0.00041
    lat = (F.col("c_custkey") * 104729 % 160000) / 1000.0 - 80.0 + 0.00037
    return c.select(F.lit("customers").alias("key"), _name("cust:", "c_custkey").alias("member"), lon.alias("lon"), lat.alias("lat"))


def ttl(spark: SparkSession, sf: str) -> DataFrame:
    """(key, expire_at ms): each user's last event plus its amount in minutes."""
    last = kv_log(spark, sf).groupBy("key").agg(F.max_by(F.struct("ts", "amount"), "seq").alias("e"))
    at = F.unix_millis(F.col("e.ts").cast("timestamp")) + F.floor(F.col("e.amount") * 60000).cast("long")
    return last.select("key", at.alias("expire_at"))


#: A fixed "now" inside the events' time, in ms: 2024-01-30 00:00 UTC.
NOW_MS = 1706572800000

#: The same tables for the oracle, by name.
SQL = {
    "kv_log": "SELECT event_id AS seq, 'user:' || user_id AS key, CASE WHEN event_type = 'error' THEN 'DEL' ELSE 'PUT' END AS op, event_type AS value, value AS amount, ts, user_id FROM events",
    "part_log": """SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'DEL' WHEN 'signup' THEN 'REM' ELSE 'PUT' END AS op, 'user:' || user_id AS key,
      'part' || (event_id % 4) AS part, value AS amount FROM events""",
    "strings": "SELECT 'order:' || o_orderkey AS key, o_orderpriority AS value FROM orders",
    "hashes": """SELECT 'cust:' || c_custkey AS key, unnest(['name', 'nation', 'segment', 'cents']) AS field,
      unnest([c_name, c_nationkey::VARCHAR, c_mktsegment, (round(c_acctbal * 100)::BIGINT)::VARCHAR]) AS value FROM customer""",
    "lists": "SELECT 'conv:' || conv_id AS key, turn AS idx, role AS value FROM conversations",
    "sets": "SELECT DISTINCT 'user:' || user_id AS key, event_type AS member FROM events",
    "supplier_parts": "SELECT DISTINCT 'supp:' || l_suppkey AS key, 'part:' || l_partkey AS member FROM lineitem",
    "zsets": "SELECT c_mktsegment AS key, 'cust:' || c_custkey AS member, c_acctbal AS score FROM customer",
    "parts": "SELECT 'parts' AS key, 'part:' || p_partkey AS member, p_retailprice AS score FROM part",
    "bitmaps": "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS key, user_id AS \"offset\" FROM events",
    "places": """SELECT 'customers' AS key, 'cust:' || c_custkey AS member,
      (c_custkey * 7919 % 360000)::DOUBLE / 1000.0::DOUBLE - 180.0::DOUBLE + 0.00041::DOUBLE AS lon,
      (c_custkey * 104729 % 160000)::DOUBLE / 1000.0::DOUBLE - 80.0::DOUBLE + 0.00037::DOUBLE AS lat FROM customer""",
    "ttl": """SELECT 'user:' || user_id AS key, epoch_us(arg_max(ts, event_id)) // 1000 + floor(arg_max(value, event_id) * 60000)::BIGINT AS expire_at
      FROM events GROUP BY user_id""",
}


def with_tables(sql: str) -> str:
    """SQL with the named tables that it mentions in front, as common table expressions."""
    import re

    used = [n for n in SQL if re.search(rf"\b{n}\b", sql)]
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in used)
    if not ctes:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
