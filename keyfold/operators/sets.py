"""Sets: distinct rows (key, member)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyfold.operators.oplog import additions


def sadd(log: DataFrame) -> DataFrame:
    """Log rows (seq, key, member) with ``reply``: 1 where the member was not there. With ``op``,
    members (REM) or keys (DEL) may be deleted in between."""
    return additions(log, "member").withColumn("reply", F.col("new").cast("int")).drop("new")


def smembers(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.array_sort(F.collect_set("member")).alias("members"))


def scard(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count_distinct("member").alias("n"))


def sismember(rows: DataFrame, requests: DataFrame) -> DataFrame:
    there = rows.select("key", "member").distinct().withColumn("there", F.lit(1))
    return requests.join(there, ["key", "member"], "left").withColumn("there", F.coalesce("there", F.lit(0)))


def srem(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone, ["key", "member"], "left_anti")


def spop(rows: DataFrame) -> DataFrame:
    """(key, member): the greatest member of each set, which a pop takes."""
    return rows.groupBy("key").agg(F.max("member").alias("member"))


def srandmember(rows: DataFrame) -> DataFrame:
    """(key, member): the middle member of each set, at half its size from 0."""
    by_member = Window.partitionBy("key").orderBy("member")
    placed = rows.withColumn("_pos", F.row_number().over(by_member) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    return placed.where(F.col("_pos") == F.floor(F.col("_n") / 2)).select("key", "member")


def smove(rows: DataFrame, source: str, target: str, member: str) -> DataFrame:
    """Rows with the member moved from one set to the other if the one has it."""
    moved = rows.where((F.col("key") == source) & (F.col("member") == member)).select(F.lit(target).alias("key"), "member")
    stay = rows.where((F.col("key") != source) | (F.col("member") != member)).select("key", "member")
    return stay.union(moved).distinct()


def _members(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col("key") == key).select("member")


def sinter(rows: DataFrame, a: str, *others: str) -> DataFrame:
    out = _members(rows, a)
    for o in others:
        out = out.intersect(_members(rows, o))
    return out


def sunion(rows: DataFrame, *names: str) -> DataFrame:
    return rows.where(F.col("key").isin(*names)).select("member").distinct()


def sdiff(rows: DataFrame, a: str, *others: str) -> DataFrame:
    out = _members(rows, a)
    for o in others:
        out = out.subtract(_members(rows, o))
    return out
