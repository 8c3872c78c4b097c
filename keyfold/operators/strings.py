"""Strings and counters: replies of write commands are windows over the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfold.functions.bytes import byte_range
from keyfold.operators.oplog import epochs, fold, running

_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def get(strings: DataFrame, key: str) -> DataFrame:
    return strings.where(F.col("key") == key)


def mget(requests: DataFrame, strings: DataFrame) -> DataFrame:
    """requests (pos, key) with values, null where missing; one row a request."""
    return requests.join(strings.select("key", "value"), "key", "left").select("pos", "key", "value")


def incr(log: DataFrame, delta: Column) -> DataFrame:
    """The log's PUT rows with ``reply``, the counter after each; a deleted key starts at 0."""
    rows = epochs(log)
    return rows.withColumn("reply", running(rows, F.when(F.col("op") == "DEL", F.lit(0)).otherwise(delta))).where("op <> 'DEL'")


def float_text(x: Column) -> Column:
    """Text with six decimals, as scores and float counters are given."""
    return F.format_string("%.6f", x.cast("double"))


def incrbyfloat(log: DataFrame, delta: Column) -> DataFrame:
    """The log's PUT rows with ``reply``, the float counter's text after each."""
    rows = epochs(log)
    total = running(rows, F.when(F.col("op") == "DEL", F.lit(0.0)).otherwise(delta))
    return rows.withColumn("reply", float_text(total)).where("op <> 'DEL'")


def getset(log: DataFrame) -> DataFrame:
    """PUT rows with ``old``, the value before; null where the key was missing."""
    w = Window.partitionBy("key").orderBy("seq")
    last = F.lag(F.struct("op", "value")).over(w)
    return log.withColumn("_last", last).withColumn("old", F.when(F.col("_last.op") != "DEL", F.col("_last.value"))).drop("_last").where("op <> 'DEL'")


def getdel(log: DataFrame) -> DataFrame:
    """DEL rows with ``old``, the value that each takes away; null where the key was missing."""
    last = F.lag(F.struct("op", "value")).over(Window.partitionBy("key").orderBy("seq"))
    rows = log.withColumn("_last", last).where("op = 'DEL'")
    return rows.withColumn("old", F.when(F.col("_last.op") != "DEL", F.col("_last.value"))).drop("_last")


def setex(log: DataFrame, now: Column) -> DataFrame:
    """Live rows of a log whose PUTs carry ``expire_at`` (ms), null for none: each sets value and
    expiry together, so the newest row of a key alone says whether it is there."""
    return fold(log).where(F.col("expire_at").isNull() | (F.col("expire_at") > now))


def setrange(value: Column, offset: int, new: bytes) -> Column:
    """Bytes with those from ``offset`` on overwritten; zeros fill a gap before it."""
    b = F.coalesce(value.cast("binary"), F.lit(b""))
    wide = F.call_function("rpad", b, F.greatest(F.octet_length(b), F.lit(offset + len(new))), F.lit(b"\0"))
    return F.when(F.lit(len(new) == 0), b).otherwise(F.overlay(wide, F.lit(new), F.lit(offset + 1), F.lit(len(new))))


def setnx(log: DataFrame) -> DataFrame:
    """PUT rows with ``reply``: 1 for the first in an epoch, which sets the value, else 0."""
    w = Window.partitionBy("key", "epoch").orderBy("seq")
    puts = epochs(log).where("op <> 'DEL'")
    return puts.withColumn("reply", (F.row_number().over(w) == 1).cast("int"))


def append(log: DataFrame) -> DataFrame:
    """PUT rows with ``reply``, the byte length after each."""
    rows = epochs(log)
    size = F.when(F.col("op") == "DEL", F.lit(0)).otherwise(F.octet_length("value"))
    return rows.withColumn("reply", running(rows, size)).where("op <> 'DEL'")


def appended(log: DataFrame) -> DataFrame:
    """(key, value): what a key's appends since its last deletion add up to."""
    last = Window.partitionBy("key")
    puts = epochs(log).withColumn("_last", F.max("epoch").over(last)).where("op <> 'DEL' AND epoch = _last")
    return puts.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x.value), "").alias("value"))


def strlen(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")


def getrange(value: Column, start: int, stop: int) -> Column:
    return byte_range(value, start, stop)


def set_last(log: DataFrame) -> DataFrame:
    """SET and MSET: last writer by (seq, pos)."""
    order = ("seq", "pos") if "pos" in log.columns else ("seq",)
    return fold(log, order=order)
