"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import free_name

#: The largest mean that one inversion covers; larger means are sums of equal parts.
PART = 16.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of the parts, joined by '|'."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def poisson_cdf(mean: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... until it no longer grows in doubles."""
    p = total = math.exp(-mean)
    cdf, k = [total], 0
    while k < mean or p > 1e-18:
        k += 1
        p *= mean / k
        total += p
        cdf.append(total)
    return cdf


def rates(counts: Mapping[str, int], weights: Mapping[str, float], epochs: float) -> dict[str, float]:
    """Mean copies of a document of each group, so that groups come out in these weights.

    The output has ``epochs`` times the input's rows on average. Groups without rows leave their
    weight to the others.
    """
    present = {g: w for g, w in weights.items() if counts.get(g) and w > 0}
    total, share = sum(counts.values()), sum(present.values())
    return {g: epochs * total * w / share / counts[g] for g, w in present.items()}


def _drawn(cdf: list[float], parts: int, seed: int, key: tuple[Column, ...]) -> Column:
    table = F.array(*[F.lit(x) for x in cdf])

    def one(i: Column) -> Column:
        u = F.array(uniform(F.lit(seed), i, *key))
        return F.element_at(F.transform(u, lambda u: F.size(F.filter(table, lambda c: c <= u))), 1)

    return F.aggregate(F.sequence(F.lit(1), F.lit(parts)), F.lit(0), lambda a, i: a + one(i))


def poisson_count(group: Column, mean: Mapping[str, float], seed: int, *key: Column) -> Column:
    """Copies of a row: inversion of Poisson(mean[group]) at a uniform hashed from seed and key."""
    out = F.lit(0)
    for g, m in sorted(mean.items()):
        if m <= 0:
            continue
        parts = max(1, math.ceil(m / PART))
        drawn = _drawn(poisson_cdf(m / parts), parts, seed, key)
        out = F.when(group == F.lit(g), drawn).otherwise(out)
    return out.cast("int")


def mix(
    docs: DataFrame,
    weights: Mapping[str, float],
    *,
    rest: float = 0.0,
    epochs: float = 1.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    copy_col: str | None = None,
    shuffled: bool = True,
) -> DataFrame:
    """``docs`` with each row as often as its source's target weight asks, in a global shuffle.

    ``weights`` are the sources' shares of output rows; sources not named, null among them, share
    ``rest``. Mean repetitions follow from one count by source, in which all unnamed sources are
    one group: what comes to the driver is as long as ``weights``. A row's copies are the Poisson
    inversion at a uniform hashed from seed, id and the MD5 of its text, so repeated rows draw
    alike, and a retried task draws the same. Copies are exploded, dealt to partitions by a hash
    of (seed, id, text, copy) and sorted by it there. No step groups by source.

    Every column of ``docs`` is kept; ``copy_col``, if given, adds the copy's number from 1; a column
    of that name in ``docs``, in any case, raises ValueError, as neither could be told from the other. Null
    ids and texts hash as empty. An empty table gives an empty result. A source of weight 0 gives
    no rows.
    """
    spark = docs.sparkSession
    if copy_col and copy_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents have a column {copy_col!r} already")
    rest_name = "\x00rest"
    group = F.when(F.col(source_col).isin(*weights), F.col(source_col)).otherwise(F.lit(rest_name)) if weights else F.lit(rest_name)
    counts = {r["g"]: r["count"] for r in docs.groupBy(group.alias("g")).count().collect()}
    mean = rates(counts, {**weights, rest_name: rest}, epochs)
    key = (F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    copy, order = free_name(docs, "_copy"), free_name(docs, "_order")
    out = docs.withColumn(copy, poisson_count(group, mean, seed, *key)).where(F.col(copy) > 0)
    out = out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy))))
    if shuffled:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        out = out.withColumn(order, F.xxhash64(F.lit(seed), *key, F.col(copy)))
        out = out.repartition(n, order).sortWithinPartitions(F.xxhash64(order), order).drop(order)
    return out.withColumnRenamed(copy, copy_col) if copy_col else out.drop(copy)
