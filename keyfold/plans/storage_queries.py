"""Queries over stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyfold.operators.oplog import fold
from keyfold.plans.registry import query
from keyfold.session import new_folder
from keyfold.sources import fixtures as fx
from keyfold.sources import storage as so


@query("SELECT count(*) AS n, true AS same FROM strings")
def backup_verify(spark: SparkSession, sf: str) -> DataFrame:
    rows, path = fx.strings(spark, sf), new_folder(spark, "backup")
    same = so.backup(rows, path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).withColumn("same", F.lit(same))


@query("""SELECT 'hash' AS type, count(DISTINCT key) AS n_keys, count(*) AS n_rows FROM hashes WHERE key NOT IN (SELECT 'cust:' || range FROM range(100))
UNION ALL SELECT 'string', count(DISTINCT key), count(*) FROM strings UNION ALL SELECT 'set', count(DISTINCT key), count(*) FROM sets""")
def migrate_stats(spark: SparkSession, sf: str) -> DataFrame:
    done = spark.range(100).select(F.lit("hash").alias("type"), F.concat(F.lit("cust:"), F.col("id").cast("string")).alias("key"))
    tables = {"hash": fx.hashes(spark, sf), "string": fx.strings(spark, sf), "set": fx.sets(spark, sf).withColumnRenamed("member", "value")}
    return so.migration_stats(so.migrate(tables, done))


@query("SELECT true AS disjoint, count(*) AS n_rows, min(key) AS smallest, max(key) AS largest FROM strings")
def manifest_levels(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "runs")
    so.write_snapshot(fx.strings(spark, sf), path, so.Options(files=4))
    files = so.manifest(spark, path)
    before = F.max("largest").over(Window.orderBy("smallest", "largest").rowsBetween(Window.unboundedPreceding, -1))
    overlap = files.withColumn("before", before).where("before >= smallest").count()
    return files.agg(F.sum("n_rows").alias("n_rows"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest")).withColumn("disjoint", F.lit(overlap == 0))


@query("""WITH f AS (SELECT level, file, count(*) AS n_rows FROM (SELECT key, seq, least(2, seq // 1000 // 3)::INTEGER AS level, seq // 500 AS file FROM kv_log) GROUP BY level, file),
p AS (SELECT level, count(*) AS n, sum(n_rows)::BIGINT AS rows FROM f GROUP BY level)
SELECT level, score FROM (SELECT level, CASE WHEN level = 0 THEN n / 4.0::DOUBLE ELSE rows / (20.0::DOUBLE * pow(10.0::DOUBLE, level)) END AS score FROM p) WHERE score >= 1""")
def pick_compaction(spark: SparkSession, sf: str) -> DataFrame:
    """Levels that are due, from files that runs of the log are written to."""
    level = F.least(F.lit(2), F.floor(F.floor(F.col("seq") / 1000) / 3)).cast("int")
    runs = fx.kv_log(spark, sf).select("key", "seq", level.alias("level"), F.floor(F.col("seq") / 500).alias("file"))
    files = runs.groupBy("level", "file").agg(F.count(F.lit(1)).alias("n_rows"))
    return so.pick_compaction(files, 20)


@query("SELECT key, value FROM (SELECT * FROM kv_log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op <> 'DEL'")
def fold_of_compacted(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "compacted")
    log = fx.kv_log(spark, sf)
    so.fold_to_snapshot(log.where("seq <= 6000").select("seq", "op", "key", "value"), path)
    rest = log.where("seq > 6000").select("seq", "op", "key", "value")
    return fold(spark.read.parquet(path).unionByName(rest)).select("key", "value")


@query("SELECT doc_id AS key, strlen(text)::BIGINT AS size, md5(text) AS hash FROM documents")
def large_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values over a limit are kept apart and joined back whole."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("key"), F.col("text").alias("value"))
    small, values = so.split_large(rows, 4000)
    return so.join_large(small, values).select("key", F.octet_length("value").cast("long").alias("size"), F.md5("value").alias("hash"))


@query("SELECT key, value FROM (SELECT * FROM kv_log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op <> 'DEL'")
def truncated_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log cut at a snapshot folds to the same state."""
    log = fx.kv_log(spark, sf).select("seq", "op", "key", "value")
    return fold(so.truncate(log, fold(log, snapshot=5000), 5000)).select("key", "value")


@query("SELECT op, count(*) AS operations, sum(strlen(value))::BIGINT AS bytes, max(seq) AS last_seq FROM kv_log GROUP BY op")
def log_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return so.metrics(fx.kv_log(spark, sf)).select("op", "operations", "bytes", "last_seq")
