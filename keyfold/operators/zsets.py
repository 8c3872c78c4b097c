"""Sorted sets: rows (key, member, score), in order of (score, member)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfold.functions.bytes import clamp
from keyfold.operators.oplog import additions, part_sums
from keyfold.plans.rank import global_rank


def order(reverse: bool = False) -> list[Column]:
    return [F.col(c).desc() if reverse else F.col(c).asc() for c in ("score", "member")]


def zadd(log: DataFrame) -> DataFrame:
    """(key, member, score): the last score of each; log rows are (seq, pos, key, member, score)."""
    return log.groupBy("key", "member").agg(F.max_by("score", F.struct("seq", "pos")).alias("score"))


def zadd_replies(log: DataFrame) -> DataFrame:
    """Log rows with ``reply``: 1 where the member was not there. With ``op``, members (REM) or keys
    (DEL) may be deleted in between."""
    return additions(log, "member").withColumn("reply", F.col("new").cast("int")).drop("new")


def zincrby(log: DataFrame, delta: Column) -> DataFrame:
    """Log rows with the member's score after each; deletions as in ``zadd_replies``."""
    return part_sums(log, "member", delta)


def zrank(rows: DataFrame, reverse: bool = False) -> DataFrame:
    """Rows with ``rank`` from 0 in their own set."""
    w = Window.partitionBy("key").orderBy(*order(reverse))
    return rows.withColumn("rank", F.row_number().over(w) - 1)


def zranks(rows: DataFrame) -> DataFrame:
    """Rows with ``rank`` and ``revrank`` from 0 in their own set, by one sort."""
    n = F.count(F.lit(1)).over(Window.partitionBy("key"))
    return zrank(rows).withColumn("revrank", n - 1 - F.col("rank"))


def zrank_spread(rows: DataFrame, reverse: bool = False) -> DataFrame:
    """As ``zrank``, for sets too large for a task: a set spreads over ranges of its order."""
    return global_rank(rows, order(reverse), key=("key",))


def zrange(rows: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """Ranks start..stop of each set, inclusive, negatives from the end.

    Without negatives the rank is bounded, so Spark keeps that many rows a set before the shuffle.
    """
    ranked = zrank(rows, reverse)
    if start >= 0 and stop >= 0:
        return ranked.where((F.col("rank") >= start) & (F.col("rank") <= stop))
    ranked = ranked.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    lo, hi = clamp(F.lit(start), F.lit(stop), F.col("_n"))
    return ranked.where(F.col("rank").between(lo, hi)).drop("_n")


def top(rows: DataFrame, n: int, reverse: bool = True) -> DataFrame:
    """The first ``n`` of one set: no full sort."""
    return rows.orderBy(*order(reverse)).limit(n)


def bound(text: str, lower: bool) -> Column:
    """The predicate of a score bound: ``(x`` leaves x out, ``-inf`` and ``+inf`` bound nothing."""
    open_ = text.startswith("(")
    x = float(text[1:] if open_ else text)
    score = F.col("score")
    if lower:
        return score > x if open_ else score >= x
    return score < x if open_ else score <= x


def by_score(rows: DataFrame, low: str, high: str) -> DataFrame:
    return rows.where(bound(low, True) & bound(high, False))


def zcount(rows: DataFrame, low: str, high: str) -> DataFrame:
    return by_score(rows, low, high).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def zrangebyscore(rows: DataFrame, low: str, high: str, offset: int = 0, count: int = -1) -> DataFrame:
    """Rows in the range of scores, in order; ``count`` below 0 takes all."""
    out = by_score(rows, low, high).orderBy(*order())
    if offset:
        out = out.offset(offset)
    return out if count < 0 else out.limit(count)


def zrem(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone, ["key", "member"], "left_anti")


def zcard(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
