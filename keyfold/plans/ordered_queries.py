"""Queries over sorted sets, bitmaps, sketches, places and slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.functions import bytes as B
from keyfold.functions import geo as G
from keyfold.functions.slots import key_slot
from keyfold.operators import bitmaps as bm
from keyfold.operators import cluster as cl
from keyfold.operators import geo as gx
from keyfold.operators import oplog
from keyfold.operators import sketches as sk
from keyfold.operators import zsets as zs
from keyfold.operators.strings import float_text
from keyfold.plans.rank import global_rank
from keyfold.plans.registry import query
from keyfold.plans.typed_queries import added_sql, sums_sql
from keyfold.sources import fixtures as fx


@query("SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM zsets QUALIFY rank BETWEEN 10 AND 19")
def zrange(spark: SparkSession, sf: str) -> DataFrame:
    return zs.zrange(fx.zsets(spark, sf), 10, 19).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank FROM zsets QUALIFY rank < 10")
def zrevrange(spark: SparkSession, sf: str) -> DataFrame:
    return zs.zrange(fx.zsets(spark, sf), 0, 9, reverse=True).withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank,
row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS revrank FROM zsets""")
def zrank_zrevrank(spark: SparkSession, sf: str) -> DataFrame:
    return zs.zranks(fx.zsets(spark, sf)).select("key", "member", F.col("rank").cast("long").alias("rank"), F.col("revrank").cast("long").alias("revrank"))


@query("SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank FROM zsets")
def zrevrank_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks in sets that may be larger than a task: each spreads over ranges."""
    return zs.zrank_spread(fx.zsets(spark, sf), reverse=True).select("key", "member", F.col("rank").cast("long").alias("rank"))


@query("SELECT member, score, row_number() OVER (ORDER BY score, member) - 1 AS rank FROM parts")
def zrank_global(spark: SparkSession, sf: str) -> DataFrame:
    return global_rank(fx.parts(spark, sf), zs.order(), 4).select("member", "score", F.col("rank").cast("long").alias("rank"))


@query("SELECT key, count(*) AS n FROM zsets WHERE score > 1000 AND score < 5000 GROUP BY key")
def zcount_excl(spark: SparkSession, sf: str) -> DataFrame:
    return zs.zcount(fx.zsets(spark, sf), "(1000", "(5000")


@query("SELECT member, score FROM parts WHERE score >= 1000 ORDER BY score, member LIMIT 30 OFFSET 20")
def zrangebyscore_limit(spark: SparkSession, sf: str) -> DataFrame:
    return zs.zrangebyscore(fx.parts(spark, sf), "1000", "+inf", 20, 30).select("member", "score")


@query("SELECT member, printf('%.6f', score) AS text FROM parts")
def zscore_text(spark: SparkSession, sf: str) -> DataFrame:
    return fx.parts(spark, sf).select("member", float_text(F.col("score")).alias("text"))


@query("SELECT value AS key, key AS member, arg_max(amount, seq) AS score FROM kv_log GROUP BY value, key")
def zadd_update(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.kv_log(spark, sf).select("seq", F.lit(0).alias("pos"), F.col("value").alias("key"), F.col("key").alias("member"), F.col("amount").alias("score"))
    return zs.zadd(log)


@query(f"SELECT seq, new AS reply FROM ({added_sql('SELECT *, part AS member FROM part_log', 'member', 'seq')})")
def zadd_new(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.part_log(spark, sf).withColumn("pos", F.lit(0)).withColumnRenamed("part", "member")
    return zs.zadd_replies(log).select("seq", "reply")


@query("SELECT key, count(*) AS n FROM zsets WHERE score >= 0 GROUP BY key")
def zrem_card(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.zsets(spark, sf)
    return zs.zcard(zs.zrem(rows, rows.where("score < 0").select("key", "member")))


@query(f"SELECT key, member, seq, reply FROM ({sums_sql('SELECT *, part AS member FROM part_log', 'member', 'round(amount * 100)::BIGINT')})")
def zincrby(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.part_log(spark, sf).withColumnRenamed("part", "member")
    return zs.zincrby(log, F.round(F.col("amount") * 100).cast("long")).select("key", "member", "seq", "reply")


@query("""SELECT member, score FROM (SELECT key AS member, (sum(round(amount * 100)::BIGINT))::BIGINT AS score FROM kv_log WHERE seq <= 8000 AND
key IN (SELECT key FROM kv_log WHERE seq <= 8000 GROUP BY key HAVING arg_max(op, seq) <> 'DEL') GROUP BY key) ORDER BY score DESC, member DESC LIMIT 10""")
def live_top(spark: SparkSession, sf: str) -> DataFrame:
    """Live users at a snapshot, ranked by what their events add up to: log, fold, sorted set, top."""
    log = oplog.at_snapshot(fx.kv_log(spark, sf), 8000)
    totals = log.groupBy("key").agg(F.sum(F.round(F.col("amount") * 100).cast("long")).alias("score"), F.max_by("op", "seq").alias("op"))
    scores = totals.where("op <> 'DEL'").select(F.col("key").alias("member"), "score")
    return zs.top(scores, 10)


@query("SELECT key, count(*) AS n FROM bitmaps GROUP BY key")
def bitcount_day(spark: SparkSession, sf: str) -> DataFrame:
    return bm.bitcount(fx.bitmaps(spark, sf))


@query("""SELECT b.key, count(*) AS n FROM bitmaps b JOIN (SELECT key, max("offset") // 8 + 1 AS size FROM bitmaps GROUP BY key) s ON b.key = s.key
WHERE b."offset" // 8 BETWEEN 1 AND size - 2 GROUP BY b.key""")
def bitcount_range(spark: SparkSession, sf: str) -> DataFrame:
    return bm.bitcount(fx.bitmaps(spark, sf), 1, -2)


@query("""SELECT d.key, u.range AS "offset", CASE WHEN b.key IS NULL THEN 0 ELSE 1 END AS bit FROM (SELECT DISTINCT key FROM bitmaps) d, range(50) u LEFT JOIN bitmaps b ON b.key = d.key AND b."offset" = u.range""")
def getbit(spark: SparkSession, sf: str) -> DataFrame:
    bits = fx.bitmaps(spark, sf)
    wanted = bits.select("key").distinct().withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))))
    return bm.getbit(bits, wanted).select("key", "offset", "bit")


@query("""SELECT key, seq, coalesce(lag(bit) OVER (PARTITION BY key, "offset" ORDER BY seq), 0) AS old FROM
(SELECT strftime(ts, '%Y-%m-%d') AS key, seq, user_id AS "offset", CASE WHEN op = 'DEL' THEN 0 ELSE 1 END AS bit FROM kv_log)""")
def setbit_old(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.kv_log(spark, sf).select(F.date_format("ts", "yyyy-MM-dd").alias("key"), "seq", F.col("user_id").alias("offset"), F.expr("CASE WHEN op = 'DEL' THEN 0 ELSE 1 END").alias("bit"))
    return bm.setbit(log).select("key", "seq", "old")


@query("""SELECT o.key, o.one, coalesce(z.zero, 0) AS zero FROM (SELECT key, min("offset") AS one FROM bitmaps GROUP BY key) o LEFT JOIN
(SELECT key, max("offset") + 1 AS zero FROM (SELECT key, "offset", row_number() OVER (PARTITION BY key ORDER BY "offset") - 1 AS nth FROM bitmaps) WHERE "offset" = nth GROUP BY key) z ON o.key = z.key""")
def bitpos(spark: SparkSession, sf: str) -> DataFrame:
    bits = fx.bitmaps(spark, sf)
    return bm.bitpos(bits, 1).withColumnRenamed("pos", "one").join(bm.bitpos(bits, 0).withColumnRenamed("pos", "zero"), "key")


_DAYS = ("2024-01-05", "2024-01-06")
_DAY = "SELECT \"offset\" FROM bitmaps WHERE key = '{}'"
_A, _B = _DAY.format(_DAYS[0]), _DAY.format(_DAYS[1])


@query(f"""SELECT 'AND' AS op, "offset" FROM ({_A} INTERSECT {_B}) UNION ALL SELECT 'OR', "offset" FROM ({_A} UNION {_B})
UNION ALL SELECT 'XOR', "offset" FROM (({_A} EXCEPT {_B}) UNION ({_B} EXCEPT {_A}))""")
def bitop_and_or_xor(spark: SparkSession, sf: str) -> DataFrame:
    bits, out = fx.bitmaps(spark, sf), None
    for op in ("AND", "OR", "XOR"):
        part = bm.bitop(bits, op, *_DAYS).select(F.lit(op).alias("op"), "offset")
        out = part if out is None else out.union(part)
    return out


@query("SELECT key, CAST(list_sum(list_transform(range(1, length(value) + 1), lambda i: bit_count(ord(substr(value, i, 1))::UTINYINT))) AS BIGINT) AS n FROM strings")
def bitcount_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return fx.strings(spark, sf).select("key", B.bit_count(F.col("value").cast("binary")).alias("n"))


@query("SELECT value AS key, true AS within FROM kv_log GROUP BY value")
def pfcount_bound(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.kv_log(spark, sf).select(F.col("value").alias("key"), "user_id")
    exact = rows.groupBy("key").agg(F.count_distinct("user_id").alias("exact"))
    guess = sk.pfcount(sk.pfadd(rows, F.col("user_id")))
    return guess.join(exact, "key").select("key", (F.abs(F.col("n") - F.col("exact")) <= 0.05 * F.col("exact")).alias("within"))


@query("SELECT true AS within")
def pfmerge_bound(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.kv_log(spark, sf).select(F.date_format("ts", "yyyy-MM-dd").alias("key"), "user_id")
    n = sk.pfcount(sk.pfmerge(sk.pfadd(rows, F.col("user_id")), "both", *_DAYS))
    exact = rows.where(F.col("key").isin(*_DAYS)).agg(F.count_distinct("user_id").alias("exact"))
    return n.join(exact, F.col("n") >= 0).select((F.abs(F.col("n") - F.col("exact")) <= 0.05 * F.col("exact")).alias("within"))


_REGISTERS = """SELECT {cols}, (('0x' || substr(md5(user_id::VARCHAR), 1, 4))::INTEGER // 4)::INTEGER AS register,
(33 - length(ltrim(bin(('0x' || substr(md5(user_id::VARCHAR), 5, 8))::BIGINT), '0')))::INTEGER AS rank FROM kv_log"""


@query(f"SELECT key, register, max(rank) AS rank FROM ({_REGISTERS.format(cols='value AS key')}) GROUP BY key, register")
def pfadd_registers(spark: SparkSession, sf: str) -> DataFrame:
    return sk.registers(fx.kv_log(spark, sf).select(F.col("value").alias("key"), "user_id"), F.col("user_id"))


@query(f"""SELECT seq, CASE WHEN rank > coalesce(max(rank) OVER (PARTITION BY key, register ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END AS reply
FROM ({_REGISTERS.format(cols='seq, value AS key')})""")
def pfadd_reply(spark: SparkSession, sf: str) -> DataFrame:
    return sk.pfadd_replies(fx.kv_log(spark, sf).select("seq", F.col("value").alias("key"), "user_id"), F.col("user_id")).select("seq", "reply")


_STEPS = """SELECT key, member, CAST(floor((lon + 180.0::DOUBLE) / 360.0::DOUBLE * 67108864) AS BIGINT) AS x,
CAST(floor((lat + 85.05112878::DOUBLE) / 170.10225756::DOUBLE * 67108864) AS BIGINT) AS y FROM places"""
_CENTRES = f"SELECT key, member, (x + 0.5::DOUBLE) / 67108864 * 360.0::DOUBLE - 180.0::DOUBLE AS lon, (y + 0.5::DOUBLE) / 67108864 * 170.10225756::DOUBLE - 85.05112878::DOUBLE AS lat FROM ({_STEPS})"


@query(f"SELECT member, CAST(list_sum(list_transform(range(26), lambda i: (((x >> i::BIGINT) & 1) << (2 * i + 1)) + (((y >> i::BIGINT) & 1) << (2 * i)))) AS BIGINT) AS cell FROM ({_STEPS})")
def geo_cell(spark: SparkSession, sf: str) -> DataFrame:
    return gx.geoadd(fx.places(spark, sf)).select("member", "cell")


@query(f"SELECT member, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({_CENTRES})")
def geopos_center(spark: SparkSession, sf: str) -> DataFrame:
    return gx.geopos(gx.geoadd(fx.places(spark, sf))).select("member", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


_TEXT = f"""SELECT member, CAST(list_sum(list_transform(range(26), lambda i: (((x >> i::BIGINT) & 1) << (2 * i + 1)) + (((y >> i::BIGINT) & 1) << (2 * i)))) AS BIGINT) AS c FROM
(SELECT member, CAST(floor((lon + 180.0::DOUBLE) / 360.0::DOUBLE * 67108864) AS BIGINT) AS x, CAST(floor((lat + 90.0::DOUBLE) / 180.0::DOUBLE * 67108864) AS BIGINT) AS y FROM ({_CENTRES}))"""


@query(f"""SELECT member, {" || ".join(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', ((c >> {47 - 5 * i}) & 31)::INTEGER + 1, 1)" for i in range(10))} || '0' AS hash FROM ({_TEXT})""")
def geohash_text(spark: SparkSession, sf: str) -> DataFrame:
    at = gx.geopos(gx.geoadd(fx.places(spark, sf)))
    return at.select("member", G.geohash(F.col("lon"), F.col("lat")).alias("hash"))


def _haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"""(CASE WHEN {lat1} IS NOT NULL AND {lat2} IS NOT NULL THEN 2 * 6372797.5::DOUBLE * asin(least(1.0::DOUBLE, sqrt(sin((radians({lat2}) - radians({lat1})) / 2) * sin((radians({lat2}) - radians({lat1})) / 2)
+ cos(radians({lat1})) * cos(radians({lat2})) * sin((radians({lon2}) - radians({lon1})) / 2) * sin((radians({lon2}) - radians({lon1})) / 2)))) END)"""


@query(f"""WITH c AS ({_CENTRES}), p AS (SELECT 'cust:' || range AS a, 'cust:' || (range * 7 % 1400 + 1) AS b FROM range(1, 120)),
d AS (SELECT p.a, p.b, {_haversine('x.lon', 'x.lat', 'y.lon', 'y.lat')} AS m FROM p LEFT JOIN c x ON x.member = p.a LEFT JOIN c y ON y.member = p.b)
SELECT a, b, round(m / 1000, 2) AS km, round(m / 1609.34::DOUBLE, 2) AS mi FROM d""")
def geodist_units(spark: SparkSession, sf: str) -> DataFrame:
    cells = gx.geoadd(fx.places(spark, sf))
    name = lambda x: F.concat(F.lit("cust:"), x.cast("string"))
    pairs = spark.range(1, 120).select(F.lit("customers").alias("key"), name(F.col("id")).alias("a"), name(F.col("id") * 7 % 1400 + 1).alias("b"))
    km = gx.geodist(cells, pairs, "km").select("a", "b", F.round("dist", 2).alias("km"))
    return km.join(gx.geodist(cells, pairs, "mi").select("a", "b", F.round("dist", 2).alias("mi")), ["a", "b"])


@query(f"WITH c AS ({_CENTRES}) SELECT member, round(m / 1000, 1) AS km FROM (SELECT member, {_haversine('10.0::DOUBLE', '50.0::DOUBLE', 'lon', 'lat')} AS m FROM c) WHERE m <= 2000000")
def georadius(spark: SparkSession, sf: str) -> DataFrame:
    found = gx.georadius(gx.geoadd(fx.places(spark, sf)), 10.0, 50.0, 2_000_000.0)
    return found.select("member", F.round(F.col("dist") / 1000, 1).alias("km"))


@query(f"""WITH c AS ({_CENTRES}), o AS (SELECT lon AS lon0, lat AS lat0 FROM c WHERE member = 'cust:5')
SELECT member, round(m / 1000, 1) AS km FROM (SELECT member, {_haversine('lon0', 'lat0', 'lon', 'lat')} AS m FROM c, o) WHERE m <= 3000000""")
def georadius_member(spark: SparkSession, sf: str) -> DataFrame:
    found = gx.georadius_by_member(gx.geoadd(fx.places(spark, sf)), "customers", "cust:5", 3_000_000.0)
    return found.select("member", F.round(F.col("dist") / 1000, 1).alias("km"))


def _slot_sql(key: str) -> str:
    return f"""(list_reduce(list_prepend(0, list_transform(string_split({key}, ''), lambda c: ord(c))), lambda a, x:
list_reduce(list_prepend(xor(a, x << 8), range(8)), lambda r, k: CASE WHEN (r & 32768) <> 0 THEN xor(r << 1, 4129) & 65535 ELSE (r << 1) & 65535 END)) & 16383)::INTEGER"""


_SLOTS = f"SELECT key, {_slot_sql('key')} AS slot FROM (SELECT DISTINCT key FROM kv_log)"


@query(f"""SELECT key, {_slot_sql("CASE WHEN regexp_extract(key, '^[^{]*[{]([^}]+)[}]', 1) = '' THEN key ELSE regexp_extract(key, '^[^{]*[{]([^}]+)[}]', 1) END")} AS slot
FROM (SELECT DISTINCT key FROM kv_log UNION SELECT DISTINCT '{{' || key || '}}:x' FROM kv_log UNION SELECT '{{}}' || key FROM kv_log)""".replace("{{", "{").replace("}}", "}"))
def keyslot(spark: SparkSession, sf: str) -> DataFrame:
    keys = fx.kv_log(spark, sf).select("key").distinct()
    more = keys.select(F.concat(F.lit("{"), "key", F.lit("}:x"))).union(keys.select(F.concat(F.lit("{}"), "key")))
    return keys.union(more).distinct().select("key", key_slot(F.col("key")).alias("slot"))


@query(f"SELECT key, slot, 'node' || least(slot // 5461, 2) AS node FROM ({_SLOTS})")
def slot_owner(spark: SparkSession, sf: str) -> DataFrame:
    nodes = cl.assign(spark, ["node0", "node1", "node2"])
    return cl.owners(fx.kv_log(spark, sf).select("key").distinct(), nodes).select("key", "slot", "node")


@query(f"SELECT slot, count(*) AS n FROM ({_SLOTS}) GROUP BY slot")
def countkeysinslot(spark: SparkSession, sf: str) -> DataFrame:
    return cl.count_keys_in_slot(fx.kv_log(spark, sf).select("key").distinct())


@query(f"SELECT key FROM ({_SLOTS}) WHERE slot BETWEEN 8000 AND 8999 QUALIFY row_number() OVER (ORDER BY slot, key) <= 1")
def getkeysinslot(spark: SparkSession, sf: str) -> DataFrame:
    """The keys of one slot: the first of a thousand that has any."""
    keys = fx.kv_log(spark, sf).select("key").distinct()
    slot = cl.with_slot(keys).where("slot BETWEEN 8000 AND 8999").agg(F.min("slot")).first()[0]
    return cl.keys_in_slot(keys, -1 if slot is None else slot, 1)


@query("SELECT key, value FROM strings WHERE key IN (SELECT 'order:' || l_orderkey FROM lineitem WHERE l_quantity > 49)")
def bloom_prune(spark: SparkSession, sf: str) -> DataFrame:
    """A semi-join; on large tables Spark puts a runtime bloom filter on the scan."""
    wanted = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_quantity > 49").select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("key"))
    return fx.strings(spark, sf).join(wanted, "key", "left_semi")


@query("""WITH m AS (SELECT user_id AS node, max(event_id) AS match_index FROM events GROUP BY user_id)
SELECT match_index AS commit_index FROM (SELECT match_index, row_number() OVER (ORDER BY match_index DESC) AS nth, count(*) OVER () AS n FROM m) WHERE nth = n // 2 + 1""")
def raft_commit_index(spark: SparkSession, sf: str) -> DataFrame:
    """Users as nodes that have acknowledged the log up to their last event."""
    acked = fx.kv_log(spark, sf).groupBy(F.col("user_id").alias("node")).agg(F.max("seq").alias("match_index"))
    return cl.commit_index(acked)
