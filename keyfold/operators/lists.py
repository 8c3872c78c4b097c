"""Lists: rows (key, idx, value). Positions are dense from 0, or from the end if negative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfold.functions.bytes import clamp


def positions(rows: DataFrame) -> DataFrame:
    """Rows with ``pos`` from 0 and the list's length ``n``."""
    by_idx = Window.partitionBy("key").orderBy("idx")
    return rows.withColumn("pos", F.row_number().over(by_idx) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))


def lrange(rows: DataFrame, start: int, stop: int) -> DataFrame:
    """Elements start..stop, inclusive."""
    placed = positions(rows)
    lo, hi = clamp(F.lit(start), F.lit(stop), F.col("n"))
    return placed.where(F.col("pos").between(lo, hi))


def ltrim(rows: DataFrame, start: int, stop: int) -> DataFrame:
    """What stays, indexed anew."""
    return lrange(rows, start, stop).select("key", _dense(), "value")


def _dense() -> Column:
    return (F.row_number().over(Window.partitionBy("key").orderBy("idx")) - 1).cast("long").alias("idx")


def lindex(rows: DataFrame, i: int) -> DataFrame:
    placed = positions(rows)
    return placed.where(F.col("pos") == (F.lit(i) if i >= 0 else F.col("n") + i))


def llen(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def lset(rows: DataFrame, i: int, value: Column) -> DataFrame:
    """Rows with element i changed; lists without it stay as they are."""
    placed = positions(rows)
    here = F.col("pos") == (F.lit(i) if i >= 0 else F.col("n") + i)
    return placed.withColumn("value", F.when(here, value).otherwise(F.col("value"))).select("key", "idx", "value")


def lrem(rows: DataFrame, count: int, value: Column) -> DataFrame:
    """Rows without the first ``count`` equal elements, the last if negative, all if 0; indexed anew."""
    order = F.col("idx").desc() if count < 0 else F.col("idx").asc()
    nth = F.row_number().over(Window.partitionBy("key", "value").orderBy(order))
    gone = F.col("value") == value
    if count:
        gone = gone & (F.col("_nth") <= abs(count))
    return rows.withColumn("_nth", nth).where(~gone).select("key", _dense(), "value")


def push(log: DataFrame, left: bool) -> DataFrame:
    """Log rows (seq, pos, key, value) with ``idx`` and ``reply``, the length after each."""
    so_far = Window.partitionBy("key").orderBy("seq", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.count(F.lit(1)).over(so_far)
    return log.withColumn("reply", n).withColumn("idx", -n if left else n - 1)


def ends(rows: DataFrame) -> DataFrame:
    """(key, head, tail): what LPOP and RPOP would give."""
    return rows.groupBy("key").agg(F.min_by("value", "idx").alias("head"), F.max_by("value", "idx").alias("tail"))


def pop(rows: DataFrame, left: bool) -> DataFrame:
    """Rows without their end element."""
    end = rows.groupBy("key").agg((F.min("idx") if left else F.max("idx")).alias("_end"))
    return rows.join(end, "key").where("idx <> _end").drop("_end")


def linsert(rows: DataFrame, pivot: Column, value: Column, before: bool = True) -> DataFrame:
    """Rows with ``value`` beside the first element equal to ``pivot``; others stay as they are."""
    at = rows.where(F.col("value") == pivot).groupBy("key").agg(F.min("idx").alias("idx"))
    new = at.select("key", (F.col("idx") * 2 + (-1 if before else 1)).alias("idx"), value.alias("value"))
    return rows.select("key", (F.col("idx") * 2).alias("idx"), "value").unionByName(new).select("key", _dense(), "value")


def interleaved(log: DataFrame) -> DataFrame:
    """(key, items): lists after pushes and pops in any order; log rows are (seq, key, op, value).

    A key's own log is folded in one expression, so its length bounds the memory of a row.
    """
    step = F.array_sort(F.collect_list(F.struct("seq", "op", F.coalesce("value", F.lit("")).alias("value"))))
    empty = F.array().cast("array<string>")

    def apply(a: Column, s: Column) -> Column:
        n = F.size(a)
        return (
            F.when(s.op == "LPUSH", F.concat(F.array(s.value), a))
            .when(s.op == "RPUSH", F.concat(a, F.array(s.value)))
            .when((s.op == "LPOP") & (n > 0), F.slice(a, 2, F.greatest(n - 1, F.lit(0))))
            .when((s.op == "RPOP") & (n > 0), F.slice(a, 1, F.greatest(n - 1, F.lit(0))))
            .otherwise(a)
        )

    return log.groupBy("key").agg(F.aggregate(step, empty, apply).alias("items"))
