"""Cardinality sketches of 2^14 registers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRECISION = 14


def pfadd(rows: DataFrame, element: Column, key: str = "key") -> DataFrame:
    """(key, sketch) of the elements of each key."""
    return rows.groupBy(key).agg(F.hll_sketch_agg(element, F.lit(PRECISION)).alias("sketch"))


def pfcount(sketches: DataFrame) -> DataFrame:
    return sketches.select("key", F.hll_sketch_estimate("sketch").alias("n"))


def pfcount_union(sketches: DataFrame, *keys: str) -> DataFrame:
    """One row: the estimate of the union."""
    return sketches.where(F.col("key").isin(*keys)).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def pfmerge(sketches: DataFrame, target: str, *keys: str) -> DataFrame:
    return sketches.where(F.col("key").isin(*keys)).agg(F.hll_union_agg("sketch").alias("sketch")).select(F.lit(target).alias("key"), "sketch")


def registers(rows: DataFrame, element: Column, key: str = "key") -> DataFrame:
    """(key, register, rank): an open form of the sketch, from the element's MD5.

    The first 14 bits choose the register; the rank is the place of the first 1 in the next 32.
    """
    digest = F.md5(element.cast("string"))
    head = F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")
    tail = F.conv(F.substring(digest, 5, 8), 16, 10).cast("long")
    rank = F.when(tail == 0, F.lit(33)).otherwise(F.lit(33) - F.length(F.bin(tail)))
    return rows.select(key, F.floor(head / 4).cast("int").alias("register"), rank.alias("rank")).groupBy(key, "register").agg(F.max("rank").alias("rank"))


def pfadd_replies(log: DataFrame, element: Column) -> DataFrame:
    """Log rows (seq, key) with ``reply``: 1 where a register rises."""
    digest = F.md5(element.cast("string"))
    rows = log.withColumn("register", F.floor(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") / 4).cast("int"))
    tail = F.conv(F.substring(digest, 5, 8), 16, 10).cast("long")
    rows = rows.withColumn("rank", F.when(tail == 0, F.lit(33)).otherwise(F.lit(33) - F.length(F.bin(tail))))
    before = Window.partitionBy("key", "register").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("reply", (F.col("rank") > F.coalesce(F.max("rank").over(before), F.lit(0))).cast("int"))
