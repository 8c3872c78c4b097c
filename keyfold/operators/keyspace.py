"""Keys of all types: scans, existence, expiry, renaming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order in which a name's type is looked for.
TYPES = ("hash", "list", "set", "zset", "string")


def matching(rows: DataFrame, pattern: str, column: str = "key") -> DataFrame:
    """``*``, ``prefix*`` or an exact key."""
    if pattern == "*":
        return rows
    c = F.col(column)
    return rows.where(c.startswith(pattern[:-1]) if pattern.endswith("*") else c == pattern)


def keys(strings: DataFrame, pattern: str) -> DataFrame:
    return matching(strings, pattern).select("key")


def prefix_scan(rows: DataFrame, prefix: str, limit: int) -> DataFrame:
    return rows.where(F.col("key").startswith(prefix)).orderBy("key").limit(limit)


def seek(rows: DataFrame, key: str) -> DataFrame:
    """Rows from the first key not below, in key order."""
    return rows.where(F.col("key") >= key).orderBy("key")


def scan_page(rows: DataFrame, after: str | None, count: int, pattern: str = "*") -> DataFrame:
    """A page of ``count`` keys; the last key is the next page's ``after``."""
    page = matching(rows, pattern)
    if after is not None:
        page = page.where(F.col("key") > after)
    return page.orderBy("key").limit(count)


def random_key(rows: DataFrame, seed: int) -> DataFrame:
    """A key drawn by hash: the same for a seed and a set of keys."""
    return rows.select("key").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key"))), "key").limit(1)


def exists(requests: DataFrame, strings: DataFrame) -> DataFrame:
    """One row: how many requests name a key that is there; repeated ones count each."""
    return requests.join(strings.select("key"), "key", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def remaining(now: Column, expire_at: Column, unit_ms: int = 1000) -> Column:
    """Whole units until ``expire_at`` (ms); -2 where there is none or it is past."""
    left = F.floor((expire_at - now) / unit_ms).cast("long")
    return F.when(expire_at > now, left).otherwise(F.lit(-2).cast("long"))


def expire(requests: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """requests (key, ms) with ``reply``, 1 where the key is there, and then its new ``expire_at``."""
    there = rows.select("key", F.lit(1).alias("reply")).distinct()
    found = requests.join(there, "key", "left").withColumn("reply", F.coalesce("reply", F.lit(0)))
    return found.withColumn("expire_at", F.when(F.col("reply") == 1, now + F.col("ms"))).drop("ms")


def live(rows: DataFrame, ttl: DataFrame, now: Column) -> DataFrame:
    """Rows whose key has not expired; ``ttl`` is (key, expire_at)."""
    gone = ttl.where(F.col("expire_at") <= now).select("key")
    return rows.join(gone, "key", "left_anti")


def expired(rows: DataFrame, ttl: DataFrame, now: Column) -> DataFrame:
    """What an expiry pass deletes: all expired keys, none left to chance."""
    return rows.join(ttl.where(F.col("expire_at") <= now).select("key"), "key", "left_semi")


def types(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(key, type): the first type in TYPES that has the key."""
    found = None
    for place, kind in enumerate(TYPES):
        if kind in tables:
            part = tables[kind].select("key", F.lit(place).alias("place"))
            found = part if found is None else found.union(part)
    first = found.groupBy("key").agg(F.min("place").alias("place"))
    return first.select("key", F.element_at(F.array(*[F.lit(t) for t in TYPES]), F.col("place") + 1).alias("type"))


def rename(rows: DataFrame, moves: DataFrame, new_only: bool = False) -> DataFrame:
    """Rows with keys moved by ``moves`` (src, dst), one batch: values of dst give way.

    ``new_only`` leaves alone what would overwrite. Moves of missing keys do nothing. Applies to
    expiry rows as well.
    """
    real = moves.join(rows.select(F.col("key").alias("src")).distinct(), "src", "left_semi")
    if new_only:
        real = real.join(rows.select(F.col("key").alias("dst")).distinct(), "dst", "left_anti")
    stay = rows.join(real.select(F.col("src").alias("key")).union(real.select(F.col("dst").alias("key"))).distinct(), "key", "left_anti")
    moved = rows.join(real.withColumnRenamed("src", "key"), "key").drop("key").withColumnRenamed("dst", "key")
    return stay.unionByName(moved)


def stats(log: DataFrame, ops: Sequence[str]) -> DataFrame:
    """One row: counts of each op, and of all."""
    return log.agg(*[F.count_if(F.col("op") == o).alias(f"n_{o.lower()}") for o in ops], F.count(F.lit(1)).alias("n_all"))


def slow_log(log: DataFrame, threshold: Column, n: int) -> DataFrame:
    """The last ``n`` operations that took at least the threshold."""
    return log.where(threshold).orderBy(F.desc("seq")).limit(n)
