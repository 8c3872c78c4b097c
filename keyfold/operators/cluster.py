"""Slots and nodes: a dimension (node, first, last) of slot ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.functions.slots import SLOTS, key_slot


def assign(spark: SparkSession, names: list[str]) -> DataFrame:
    """Equal ranges of slots; the last node takes the remainder."""
    each = SLOTS // len(names)
    rows = [(n, i * each, SLOTS - 1 if i == len(names) - 1 else (i + 1) * each - 1, "ok") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "node string, first int, last int, state string")


def add_node(nodes: DataFrame, name: str, first: int, last: int) -> DataFrame:
    """Gives a range of slots to a node, which may be new; other nodes keep what is left of theirs."""
    spark = nodes.sparkSession
    below = nodes.withColumn("last", F.least("last", F.lit(first - 1)))
    above = nodes.withColumn("first", F.greatest("first", F.lit(last + 1)))
    new = spark.createDataFrame([(name, first, last, "ok")], "node string, first int, last int, state string")
    return below.union(above).where("first <= last").union(new)


def remove_node(nodes: DataFrame, name: str, heir: str) -> DataFrame:
    """Another node takes over the slots."""
    return nodes.withColumn("node", F.when(F.col("node") == name, heir).otherwise(F.col("node")))


def mark_failed(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.withColumn("state", F.when(F.col("node") == name, "fail").otherwise(F.col("state")))


def with_slot(rows: DataFrame, key: str = "key") -> DataFrame:
    return rows.withColumn("slot", key_slot(F.col(key)))


def owners(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows with slot and owning node. Ranges are dealt to their slots, SLOTS rows at most, so that
    the broadcast is bounded and the join has an equal key."""
    by_slot = nodes.select("node", F.explode(F.sequence("first", "last")).alias("slot"))
    # never null, so no null test of the slot moves below what made the rows
    slots = with_slot(rows).withColumn("slot", F.coalesce("slot", F.lit(-1)))
    return slots.join(F.broadcast(by_slot), "slot")


def count_keys_in_slot(rows: DataFrame) -> DataFrame:
    return with_slot(rows).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


def keys_in_slot(rows: DataFrame, slot: int, limit: int) -> DataFrame:
    return with_slot(rows).where(F.col("slot") == slot).select("key").orderBy("key").limit(limit)


def commit_index(nodes: DataFrame) -> DataFrame:
    """One row: the greatest index that a majority has; rows are (node, match_index), one a node."""
    ranked = F.sort_array(F.collect_list("match_index"), False)
    return nodes.agg(F.element_at(ranked, F.floor(F.count(F.lit(1)) / 2).cast("int") + 1).alias("commit_index"))


def first_mismatch(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """One row: the least (index, term) of the leader's log that the follower's lacks."""
    return leader.join(follower, ["index", "term"], "left_anti").agg(F.min("index").alias("index"))


def best_candidate(nodes: DataFrame) -> DataFrame:
    """One row: the node whose log is newest by (last_term, last_index), the least name in a tie."""
    return nodes.orderBy(F.desc("last_term"), F.desc("last_index"), "node").limit(1)
