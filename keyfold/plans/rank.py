"""Ranks and nearest marks over a whole table without one task that sorts it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfold.session import new_folder


def _dealt(rows: DataFrame, order: list[Column], partitions: int | None) -> DataFrame:
    """``rows`` dealt by ranges of the order and written once, with the range's number ``_part``."""
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_folder(spark, "ranked")
    dealt = rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def _starts(sums: DataFrame, key: Sequence[str]) -> DataFrame:
    """(_part, key..., _start): what ``_sum`` adds up to in the ranges before, for a key at a time."""
    w = Window.partitionBy(*key) if key else Window
    before = F.sum("_sum").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    names = [F.col(k).alias(f"_own{i}") for i, k in enumerate(key)]
    starts = sums.select(F.col("_part").alias("_own_part"), *names, F.coalesce(before, F.lit(0)).alias("_start"))
    return starts if key else F.broadcast(starts)


def _with_start(dealt: DataFrame, starts: DataFrame, key: Sequence[str]) -> DataFrame:
    same = F.col("_part") == F.col("_own_part")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_own{i}"))
    return dealt.join(starts, same).drop("_own_part", *[f"_own{i}" for i in range(len(key))])


def global_rank(rows: DataFrame, order: list[Column], partitions: int | None = None, key: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``rank`` from 0 in a total order, over all rows or for each ``key`` by itself.

    Rows are dealt by ranges and written once; each range is ranked by itself and starts where
    the ranges before it end. A key of any size spreads over ranges. The counts are one row a range and
    key; without a key their broadcast is bounded by the number of partitions.
    """
    dealt = _dealt(rows, [*map(F.col, key), *order], partitions)
    starts = _starts(dealt.groupBy("_part", *key).agg(F.count(F.lit(1)).alias("_sum")), key)
    within = F.row_number().over(Window.partitionBy("_part", *key).orderBy(*order)) - 1
    ranked = _with_start(dealt.withColumn("_within", within), starts, key)
    return ranked.withColumn("rank", F.col("_start") + F.col("_within")).drop("_part", "_start", "_within")


def running_total(rows: DataFrame, order: list[Column], value: Column, name: str, partitions: int | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each row in a total order, in the way of ``global_rank``."""
    dealt = _dealt(rows.withColumn("_value", value), order, partitions)
    starts = _starts(dealt.groupBy("_part").agg(F.sum("_value").alias("_sum")), ())
    so_far = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = _with_start(dealt.withColumn("_within", F.sum("_value").over(so_far)), starts, ())
    return summed.withColumn(name, F.col("_start") + F.col("_within")).drop("_part", "_start", "_within", "_value")


def last_before(rows: DataFrame, marks: DataFrame, key: str, mark_key: str, value: str, partitions: int | None = None) -> DataFrame:
    """``rows`` with ``value`` of the last of ``marks`` at or before their key; null before the first.

    Keys of ``marks`` are distinct. Both are dealt by ranges of the key and written once. Each range
    carries its marks forward, and begins with the last mark of the ranges before it: one row a
    partition, so their broadcast is bounded. Rows without a key get null.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    a = rows.select(F.col(key).alias("_key"), F.lit(1).alias("_side"), F.struct(*rows.columns).alias("_row"), F.lit(None).alias("_mark"))
    b = marks.select(F.col(mark_key).alias("_key"), F.lit(0).alias("_side"), F.lit(None).alias("_row"), F.struct(value).alias("_mark"))
    path = new_folder(spark, "marked")
    dealt = a.union(b).repartitionByRange(n, "_key").withColumn("_part", F.spark_partition_id())
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    lasts = dealt.where("_side = 0").groupBy("_part").agg(F.max_by("_mark", "_key").alias("_last"))
    parts = spark.range(n).select(F.col("id").cast("int").alias("_part")).join(lasts, "_part", "left")
    before = F.last("_last", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("_part", before.alias("_before"))
    so_far = Window.partitionBy("_part").orderBy(F.col("_key").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = dealt.withColumn("_found", F.last("_mark", ignorenulls=True).over(so_far)).where("_side = 1").join(F.broadcast(starts), "_part", "left")
    there = F.when(F.col("_key").isNotNull(), F.coalesce("_found", "_before"))
    return found.select("_row.*", there[value].alias(value))
