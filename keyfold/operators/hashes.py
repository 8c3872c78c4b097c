"""Hashes: rows (key, field, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.operators.oplog import additions, latest, part_sums


def hset(log: DataFrame) -> DataFrame:
    """(seq, key, reply): fields that each write adds; log rows are (seq, pos, key, field), with ``op``
    if fields (REM) or keys (DEL) are deleted in between."""
    return additions(log, "field").groupBy("seq", "key").agg(F.sum("new").alias("reply"))


def hset_if_missing(log: DataFrame) -> DataFrame:
    """Writes with ``reply``: 1 for those that set their field, 0 where it was there."""
    return additions(log, "field").withColumnRenamed("new", "reply")


def hmset(log: DataFrame) -> DataFrame:
    """(key, field, value) after writes and deletions of fields (REM) and keys (DEL); the log has (seq,
    pos) or seq."""
    order = [c for c in ("seq", "pos") if c in log.columns]
    gone = log.where("op = 'DEL'").groupBy("key").agg(F.max(F.struct(*order)).alias("_gone"))
    rows = log.where("op <> 'DEL'").join(gone, "key", "left").where(F.col("_gone").isNull() | (F.struct(*order) > F.col("_gone")))
    return latest(rows, ("key", "field"), order).where("op = 'PUT'").select("key", "field", "value")


def hgetall(rows: DataFrame) -> DataFrame:
    """(key, fields map) in byte order of fields."""
    return rows.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def hmget(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (pos, key, field) with values, null where missing."""
    return requests.join(rows, ["key", "field"], "left").select("pos", "key", "field", "value")


def hlen(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def hdel(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone, ["key", "field"], "left_anti")


def hexists(rows: DataFrame, requests: DataFrame) -> DataFrame:
    there = rows.select("key", "field", F.lit(1).alias("there"))
    return requests.join(there, ["key", "field"], "left").withColumn("there", F.coalesce("there", F.lit(0)))


def hincrby(log: DataFrame, delta: Column) -> DataFrame:
    """Log rows (seq, key, field) with the field's value after each; deletions as in ``hset``."""
    return part_sums(log, "field", delta)


def hscan(rows: DataFrame, key: str, after: str | None, count: int) -> DataFrame:
    page = rows.where(F.col("key") == key)
    if after is not None:
        page = page.where(F.col("field") > after)
    return page.orderBy("field").limit(count)
