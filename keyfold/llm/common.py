"""Shared helpers: tables in the folder all executors see, Arrow batches, components."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.session import new_folder


def new_path(spark: SparkSession, name: str) -> str:
    return new_folder(spark, name)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its path."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` through the shared folder: cuts lineage, survives lost executors."""
    return stored(df, name)[0]


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs, which Spark drops with its own garbage.

    A query of several written steps then needs the disk of its largest step, not of all.
    """
    gc.collect()
    spark._jvm.System.gc()


def delete_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


class Scratch:
    """Tables in the shared folder that go when the block ends: ``keep(df, name)`` writes one and
    reads it back, ``own(df)`` takes over those that ``df`` reads."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        df, path = stored(df, name)
        self.paths.append(path)
        return df

    def own(self, df: DataFrame) -> DataFrame:
        self.paths += {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        return df

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete_path(self.spark, path)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put after it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let_workers_import(spark: SparkSession) -> None:
    """Put this library's folder on the path of Python workers that start from now on, for drivers
    that have it on theirs alone. Executors elsewhere need the library installed."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_batch(
    fn: Callable[[pa.RecordBatch], pa.RecordBatch],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return run


def texts(column: pa.Array, step: int = 256) -> Iterator[str]:
    """The column's texts, null as empty, turned into Python objects a few at a time."""
    for i in range(0, len(column), step):
        for t in column.slice(i, step).to_pylist():
            yield t or ""


def in_steps(column: pa.Array, size: int = 1_000_000) -> Iterator[list[str]]:
    """The column's texts in lists of about ``size`` characters."""
    held, n = [], 0
    for t in texts(column):
        held.append(t)
        n += len(t)
        if n > size:
            yield held
            held, n = [], 0
    if held:
        yield held


_held: dict = {}


def once_a_worker(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept from task to task of a Python worker; only the latest key is held."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


class Memory:
    """Remembers values of keys in two generations of bounded size.

    A full young generation becomes the old one and the old one goes, so frequent keys stay.
    """

    def __init__(self, limit: int) -> None:
        self.half, self.young, self.old = limit // 2, {}, {}

    def fetch(self, keys: list, make: Callable[[list], list]) -> list:
        """The keys' values in order; ``make`` is asked for those not known. Keys are distinct."""
        young, old = self.young, self.old
        out = [young.get(k) for k in keys]
        missing, places = [], []
        for i, v in enumerate(out):
            if v is None:
                k = keys[i]
                v = out[i] = old.get(k)
                if v is None:
                    missing.append(k)
                    places.append(i)
                else:
                    young[k] = v
        if missing:
            made = make(missing)
            for i, v in zip(places, made, strict=True):
                out[i] = v
            if len(missing) < self.half:
                young.update(zip(missing, made, strict=True))
        if len(young) > self.half:
            self.young, self.old = {}, young
        return out


def encode_joined(tokenizer, parts: list[str], separator: str, step: int = 1000) -> Iterator[tuple[list[int], list[int]]]:
    """Ids of parts that the tokenizer never joins, by encoding many at once.

    Yields, for each run of ``step`` parts, all their ids and where each part's ids start.
    """
    for at in range(0, len(parts), step):
        some = parts[at : at + step]
        e = tokenizer.encode(separator.join(some), add_special_tokens=False)
        sizes = np.fromiter(map(len, some), np.int64, len(some)) + len(separator)
        starts = np.cumsum(sizes) - sizes
        first = np.fromiter((a for a, _ in e.offsets), np.int64, len(e))
        yield e.ids, [*np.searchsorted(first, starts).tolist(), len(first)]


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst long); root is the least node reachable.

    Alternates large-star and small-star steps. Each round is a table in the shared folder, so
    lineage stays short and nothing is gathered on the driver but a count and a sum of hashes.
    """
    spark = edges.sparkSession
    now, path = stored(
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(),
        "edges",
    )
    seen = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, large_path = stored(
            _with_least(both)
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct(),
            "large-star",
        )
        delete_path(spark, path)
        least = _with_least(large)
        now, path = stored(
            least.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(large.groupBy("u").agg(F.min("v").alias("v")))
            .where("u <> v")
            .distinct(),
            "small-star",
        )
        delete_path(spark, large_path)
        state = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        ).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the least of u and its neighbours.

    coalesce() hides that the sums are already dealt by u: both sides then get an exchange of
    their own, and AQE can split a hub's partition.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(
        F.coalesce("u", F.lit(0).cast("long")).alias("w"), F.least("u", "m").alias("m")
    )
    return pairs.join(least, pairs.u == least.w).drop("w")
