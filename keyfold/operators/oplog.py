"""The operation log and its fold: state is the last visible operation of each key.

A log is a DataFrame with ``seq`` (long), ``op`` (PUT or DEL), key columns and values. Rows of one
``seq`` are a batch, ordered by ``pos`` where there is one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfold.plans.rank import global_rank, last_before

#: Range tombstones up to this many are broadcast; more are cut to disjoint ranges.
BROADCAST_TOMBSTONES = 200


def at_snapshot(log: DataFrame, snapshot: int | None) -> DataFrame:
    return log if snapshot is None else log.where(F.col("seq") <= snapshot)


def latest(log: DataFrame, key: Sequence[str] = ("key",), order: Sequence[str] = ("seq",)) -> DataFrame:
    """The newest row of each key, deletions included; Spark cuts to one row a key before the shuffle."""
    newest = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def fold(log: DataFrame, key: Sequence[str] = ("key",), order: Sequence[str] = ("seq",), snapshot: int | None = None, tombstones: DataFrame | None = None) -> DataFrame:
    """Live rows at a snapshot: newest of each key, unless that is a deletion or a newer range
    tombstone covers it."""
    rows = latest(at_snapshot(log, snapshot), key, order).where("op <> 'DEL'")
    if tombstones is not None:
        rows = hide_ranges(rows, at_snapshot(tombstones, snapshot))
    return rows


def fold_max_by(log: DataFrame, values: Sequence[str], key: Sequence[str] = ("key",), snapshot: int | None = None) -> DataFrame:
    """The same by one aggregate, summed up before the shuffle: hot keys cost one row a task."""
    rows = at_snapshot(log, snapshot)
    last = rows.groupBy(*key).agg(F.max_by(F.struct("op", *values), F.col("seq")).alias("last"), F.max("seq").alias("seq"))
    return last.where("last.op <> 'DEL'").select(*key, "seq", *[F.col(f"last.{v}").alias(v) for v in values])


def hide_ranges(rows: DataFrame, tombstones: DataFrame, limit: int = BROADCAST_TOMBSTONES) -> DataFrame:
    """Rows (key, seq) without those in [begin_key, end_key) of a tombstone of a greater seq.

    A few tombstones are broadcast and tested in turn. More are cut to disjoint ranges with the
    greatest seq of each (``covers``), which a sort brings together with the keys: no row meets
    more than one range, whatever the tombstones' number, width or overlaps.
    """
    covered = (F.col("key") >= F.col("begin_key")) & (F.col("key") < F.col("end_key")) & (F.col("t_seq") > F.col("seq"))
    t = tombstones.where("begin_key < end_key").select("begin_key", "end_key", F.col("seq").alias("t_seq"))
    if t.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(t), covered, "left_anti")
    found = last_before(rows, covers(t), "key", "begin_key", "t_seq")
    return found.where("t_seq IS NULL OR t_seq <= seq").drop("t_seq")


def covers(t: DataFrame) -> DataFrame:
    """(begin_key, t_seq): from each key on, up to the next, the greatest t_seq of the ranges
    (begin_key, end_key, t_seq) that lie over it; null where none does.

    The ends of ranges are numbered in order. A range of numbers is a union of aligned blocks of
    2^level numbers, two a level at most, so n ranges make some n log n blocks; a number lies in
    one block of each level and takes the greatest t_seq of those that are there.
    """
    ends = t.select(F.col("begin_key").alias("key")).union(t.select("end_key")).distinct()
    ranked = global_rank(ends, [F.col("key")]).select("key", F.col("rank").cast("long").alias("rank"))
    levels = F.sequence(F.lit(0), F.lit(max(1, ranked.count().bit_length())))
    place = lambda c, n: ranked.select(F.col("key").alias(c), F.col("rank").alias(n))
    placed = t.join(place("begin_key", "a"), "begin_key").join(place("end_key", "b"), "end_key")
    start = F.struct(F.col("a"), F.col("b"), F.array().cast("array<struct<level:int,at:bigint>>").alias("out"))

    def step(s: Column, level: Column) -> Column:
        left, right = (s.a < s.b) & (s.a % 2 == 1), (s.a < s.b) & (s.b % 2 == 1)
        block = lambda test, at: F.when(test, F.array(F.struct(level.alias("level"), at.alias("at")))).otherwise(F.array().cast("array<struct<level:int,at:bigint>>"))
        a, b = F.when(left, s.a + 1).otherwise(s.a), F.when(right, s.b - 1).otherwise(s.b)
        return F.struct(F.shiftright(a, 1).alias("a"), F.shiftright(b, 1).alias("b"), F.concat(s.out, block(left, s.a), block(right, b)).alias("out"))

    blocks = placed.select("t_seq", F.inline(F.aggregate(levels, start, step, lambda s: s.out))).groupBy("level", "at").agg(F.max("t_seq").alias("t_seq"))
    own = ranked.select("key", "rank", F.explode(levels).alias("level")).withColumn("at", F.call_function("shiftright", F.col("rank"), F.col("level")))
    return own.join(blocks, ["level", "at"], "left").groupBy(F.col("key").alias("begin_key")).agg(F.max("t_seq").alias("t_seq"))


def commit_batches(log: DataFrame, batch: Column, size: int) -> DataFrame:
    """Rows of batches that are whole: all ``size`` operations are there."""
    whole = Window.partitionBy("_batch")
    rows = log.withColumn("_batch", batch).withColumn("_n", F.count(F.lit(1)).over(whole))
    return rows.where(F.col("_n") == size).drop("_n", "_batch")


def overlay(state_log: DataFrame, buffered: DataFrame, snapshot: int) -> DataFrame:
    """A transaction's view: its own writes over the log at its snapshot."""
    top = buffered.withColumn("seq", F.col("seq") + F.lit(snapshot))
    return fold(at_snapshot(state_log, snapshot).unionByName(top, allowMissingColumns=True))


def merge_runs(runs: Sequence[DataFrame]) -> DataFrame:
    """Fold of several runs, each key's newest version over all of them."""
    merged = runs[0]
    for r in runs[1:]:
        merged = merged.unionByName(r)
    return fold(merged)


def compact(log: DataFrame, snapshots: Sequence[int] = (), key: Sequence[str] = ("key",)) -> DataFrame:
    """Versions that the newest state or a snapshot needs; deletions go where nothing older is left.

    Each version serves the snapshots from its seq up to the next version's; one per key and
    snapshot interval stays.
    """
    interval = F.lit(len(snapshots))
    for i, s in reversed(list(enumerate(sorted(snapshots)))):
        interval = F.when(F.col("seq") <= s, F.lit(i)).otherwise(interval)
    kept = latest(log.withColumn("_interval", interval), [*key, "_interval"])
    first = Window.partitionBy(*key).orderBy("seq")
    return kept.withColumn("_nth", F.row_number().over(first)).where("NOT (_nth = 1 AND op = 'DEL')").drop("_nth", "_interval")


def epochs(log: DataFrame, key: Sequence[str] = ("key",), order: Sequence[str] = ("seq",), op: str = "DEL", name: str = "epoch") -> DataFrame:
    """The log with ``epoch``: deletions of the key before a row. Running replies restart with it."""
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumn(name, F.sum((F.col("op") == op).cast("long")).over(before))


def running(log: DataFrame, value: Column, key: Sequence[str] = ("key",)) -> Column:
    """Sum of ``value`` over a key's rows so far, for an epoch at a time."""
    return F.sum(value).over(Window.partitionBy(*key, "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _order(log: DataFrame) -> list[str]:
    return [c for c in ("seq", "pos") if c in log.columns]


def additions(log: DataFrame, part: str) -> DataFrame:
    """Writes of a key's parts (fields, members) with ``new``: 1 where the part was not there.

    ``op`` is PUT, REM (the part goes) or DEL (the key goes, with all parts); a log without ``op``
    only puts. Rows come back that put.
    """
    rows = log if "op" in log.columns else log.withColumn("op", F.lit("PUT"))
    rows = epochs(rows, order=_order(log))
    w = Window.partitionBy("key", "epoch", part).orderBy(*_order(log))
    new = F.coalesce(F.lag("op").over(w), F.lit("REM")) != "PUT"
    out = rows.withColumn("new", new.cast("long")).where("op = 'PUT'").drop("epoch")
    return out if "op" in log.columns else out.drop("op")


def part_sums(log: DataFrame, part: str, delta: Column) -> DataFrame:
    """Writes of a key's parts with ``reply``, the sum of ``delta`` so far; it restarts where the part
    or the key was deleted. ``op`` as in ``additions``."""
    rows = log if "op" in log.columns else log.withColumn("op", F.lit("PUT"))
    rows = epochs(epochs(rows, order=_order(log)), ("key", "epoch", part), _order(log), "REM", "_life")
    w = Window.partitionBy("key", "epoch", part, "_life").orderBy(*_order(log)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("reply", F.sum(F.when(F.col("op") == "PUT", delta)).over(w)).where("op = 'PUT'").drop("epoch", "_life")
    return out if "op" in log.columns else out.drop("op")
