"""Bitmaps: rows (key, offset) of set bits, or binaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def setbit(log: DataFrame) -> DataFrame:
    """Log rows (seq, key, offset, bit) with ``old``, the bit before."""
    w = Window.partitionBy("key", "offset").orderBy("seq")
    return log.withColumn("old", F.coalesce(F.lag("bit").over(w), F.lit(0)))


def folded(log: DataFrame) -> DataFrame:
    """(key, offset) of bits that are set after the log."""
    last = log.groupBy("key", "offset").agg(F.max_by("bit", "seq").alias("bit"))
    return last.where("bit = 1").select("key", "offset")


def getbit(bits: DataFrame, requests: DataFrame) -> DataFrame:
    there = bits.select("key", "offset").distinct().withColumn("bit", F.lit(1))
    return requests.join(there, ["key", "offset"], "left").withColumn("bit", F.coalesce("bit", F.lit(0)))


def sizes(bits: DataFrame) -> DataFrame:
    """(key, n_bytes) of the bytes that the greatest set bit needs."""
    return bits.groupBy("key").agg((F.floor(F.max("offset") / 8) + 1).alias("n_bytes"))


def bitcount(bits: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    """(key, n), of a range of bytes if both ends are given."""
    if start is not None and stop is not None:
        rows = bits.join(sizes(bits), "key")
        lo = F.lit(start) if start >= 0 else F.greatest(F.col("n_bytes") + start, F.lit(0))
        hi = F.lit(stop) if stop >= 0 else F.col("n_bytes") + stop
        bits = rows.where(F.floor(F.col("offset") / 8).between(lo, hi))
    return bits.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def bitpos(bits: DataFrame, bit: int) -> DataFrame:
    """(key, pos): the first bit that is set, or clear; in all ones the first after them."""
    if bit == 1:
        return bits.groupBy("key").agg(F.min("offset").alias("pos"))
    w = Window.partitionBy("key").orderBy("offset")
    placed = bits.select("key", "offset").distinct().withColumn("_nth", F.row_number().over(w) - 1)
    run = placed.where(F.col("offset") == F.col("_nth")).groupBy("key").agg((F.max("offset") + 1).alias("pos"))
    return bits.select("key").distinct().join(run, "key", "left").select("key", F.coalesce("pos", F.lit(0)).cast("long").alias("pos"))


def bitop(bits: DataFrame, op: str, *keys: str) -> DataFrame:
    """(offset) of AND, OR or XOR of bitmaps; NOT of one within its bytes."""
    rows = bits.where(F.col("key").isin(*keys)).select("key", "offset").distinct()
    n = rows.groupBy("offset").agg(F.count(F.lit(1)).alias("_n"))
    if op == "NOT":
        size = sizes(rows).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") * 8 - 1)).alias("offset"))
        return size.join(rows.select("offset"), "offset", "left_anti")
    test = {"AND": F.col("_n") == len(set(keys)), "OR": F.col("_n") > 0, "XOR": F.col("_n") % 2 == 1}[op]
    return n.where(test).select("offset")


def to_binary(bits: DataFrame) -> DataFrame:
    """(key, value): bytes with the first bit highest. For bitmaps that fit a value."""
    by_byte = bits.groupBy("key", F.floor(F.col("offset") / 8).alias("i")).agg(
        F.bit_or(F.expr("shiftleft(1, cast(7 - offset % 8 AS int))")).alias("b")
    )
    wide = by_byte.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("i", "b"))).alias("bytes"), F.max("i").alias("last"))
    hexes = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at("bytes", i), F.lit(0)).cast("long")), 2, "0"))
    return wide.select("key", F.unhex(F.array_join(hexes, "")).alias("value"))
