"""As-of joins: the last row at or before a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """``left`` with ``values`` of the last ``right`` row of equal ``on`` at or before ``left_time``.

    Both sides go through one window, sorted by key and time, so nothing is paired: the cost is a
    sort, however many right rows a key has. Left rows without a match get nulls.
    """
    own = [c for c in left.columns if c not in on]
    a = left.select(*on, F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.struct(*own).alias("_row"), F.lit(None).alias("_values"))
    b = right.select(*on, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), F.lit(None).alias("_row"), F.struct(*values).alias("_values"))
    w = Window.partitionBy(*on).orderBy("_time", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.union(b).withColumn("_found", F.last("_values", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*on, "_row.*", *[F.col(f"_found.{v}").alias(v) for v in values])
