"""Logs, snapshots, manifests, backups and migration on files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.operators.oplog import fold
from keyfold.session import exists

#: Fixed values of the level scheme: files of level 0 that start a compaction, growth of a level.
LEVEL0_FILES, RATIO = 4, 10


@dataclass(frozen=True)
class Options:
    """Settings of a store; ``from_json`` reads them from a flat object and ignores other keys."""

    path: str = ""
    files: int = 8
    rows_per_file: int = 0
    codec: str = "zstd"
    bloom: bool = True
    max_files_per_trigger: int = 0

    @classmethod
    def from_json(cls, text: str) -> Options:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(text).items() if k in known})

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def _batches(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """(number, whether it was written to its end) of a log's batches, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("batch=")]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted((int(p.getName()[6:]), fs.exists(done(p, "_SUCCESS"))) for p in names)


def append_log(rows: DataFrame, path: str) -> int:
    """One append is one numbered batch: all of its rows become visible together, once its mark of
    success is there. A log has one writer. Gives the batch's number."""
    known = _batches(rows.sparkSession, path)
    number = known[-1][0] + 1 if known else 1
    rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/batch={number:012d}")
    return number


def read_log(spark: SparkSession, path: str, schema=None, torn: str = "stop") -> DataFrame:
    """Rows of a log's batches, in none but whole batches.

    Reading stops before the first batch that was not written to its end, as nothing after it may
    count (``torn="stop"``), or raises ValueError (``torn="raise"``). A batch with a damaged file
    raises when it is read: nothing is passed over, so no older value comes back to life.
    """
    known = _batches(spark, path)
    whole = []
    for number, done in known:
        if not done:
            if torn == "raise":
                raise ValueError(f"batch {number} of {path} was not written to its end")
            break
        whole.append(f"{path}/batch={number:012d}")
    reader = spark.read.option("mergeSchema", "false").option("ignoreCorruptFiles", "false")
    if not whole:
        if schema is None:
            raise ValueError(f"no batches in {path}")
        return spark.createDataFrame([], schema)
    return (reader.schema(schema) if schema else reader).parquet(*whole)


def write_snapshot(rows: DataFrame, path: str, options: Options | None = None, key: str = "key") -> None:
    """Sorted runs of disjoint key ranges: statistics prune files and row groups on the key."""
    o = options or Options()
    writer = rows.repartitionByRange(o.files, key).sortWithinPartitions(key).write.mode("overwrite").option("compression", o.codec)
    if o.bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    if o.rows_per_file:
        writer = writer.option("maxRecordsPerFile", o.rows_per_file)
    writer.parquet(path)


#: Bytes of a value beyond which it is kept apart. Fixed value.
LARGE = 64 * 1024


def split_large(rows: DataFrame, limit: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """Rows with large values left out and ``digest`` in their place, and (digest, value) of those,
    once each. Scans of keys and small values then don't touch large ones."""
    large = F.octet_length("value") > limit
    digest = F.when(large, F.sha2("value", 256))
    values = rows.where(large).select(F.sha2("value", 256).alias("digest"), "value").groupBy("digest").agg(F.first("value").alias("value"))
    return rows.withColumn("digest", digest).withColumn("value", F.when(~large, F.col("value"))), values


def join_large(rows: DataFrame, values: DataFrame) -> DataFrame:
    whole = rows.join(values.withColumnRenamed("value", "_large"), "digest", "left")
    return whole.withColumn("value", F.coalesce("value", "_large")).drop("_large", "digest")


def truncate(log: DataFrame, snapshot: DataFrame, at: int) -> DataFrame:
    """A snapshot's rows as a log's start, then the log after ``at``."""
    return snapshot.unionByName(log.where(F.col("seq") > at))


def metrics(log: DataFrame) -> DataFrame:
    """One row for each op: operations, keys, bytes of values, and the last seq."""
    return log.groupBy("op").agg(
        F.count(F.lit(1)).alias("operations"),
        F.approx_count_distinct("key").alias("keys_about"),
        F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes"),
        F.max("seq").alias("last_seq"),
    )


def manifest(spark: SparkSession, path: str, level: int = 0, key: str = "key") -> DataFrame:
    """(file, level, smallest, largest, n_rows), a row for each file of a table."""
    rows = spark.read.parquet(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col(key).alias("k"))
    return rows.groupBy("file").agg(F.min("k").alias("smallest"), F.max("k").alias("largest"), F.count(F.lit(1)).alias("n_rows")).select("file", F.lit(level).alias("level"), "smallest", "largest", "n_rows")


def pick_compaction(files: DataFrame, base_rows: int) -> DataFrame:
    """(level, score) of levels that are due, most pressing first: files at level 0, rows below."""
    per = files.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("rows"))
    target = F.lit(float(base_rows)) * F.pow(F.lit(float(RATIO)), F.col("level"))
    score = F.when(F.col("level") == 0, F.col("n") / F.lit(LEVEL0_FILES)).otherwise(F.col("rows") / target)
    return per.select("level", score.alias("score")).where("score >= 1").orderBy(F.desc("score"), "level")


def replace_pointer(spark: SparkSession, folder: str, content: Mapping) -> None:
    """Write a small JSON file and rename it over the old one in one step of the file system, so
    readers and crashes see the old or the new one, never none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT")
    temporary = jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT.{uuid.uuid4().hex}")
    out = target.getFileSystem(conf).create(temporary, True)
    out.write(bytearray(json.dumps(dict(content)).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(temporary, target, options)


def read_pointer(spark: SparkSession, folder: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(f"{folder}/CURRENT").collect()))


def checksum(rows: DataFrame) -> DataFrame:
    """One row: how many rows, and a sum of hashes that doesn't depend on their order."""
    total = F.sum(F.xxhash64(*rows.columns).cast("decimal(20,0)"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(total, F.lit(0)).cast("decimal(38,0)").alias("check"))


def backup(rows: DataFrame, path: str) -> bool:
    """Copy a table and compare what was written with what was meant."""
    rows.write.mode("overwrite").parquet(path)
    return checksum(rows).first() == checksum(rows.sparkSession.read.parquet(path).select(*rows.columns)).first()


def fold_to_snapshot(log: DataFrame, path: str, options: Options | None = None) -> None:
    """Compaction to the newest state, sorted and split by key."""
    write_snapshot(fold(log), path, options)


def migrate(tables: Mapping[str, DataFrame], done: DataFrame | None = None, prefix: str = "", keys: Sequence[str] | None = None) -> DataFrame:
    """(type, key, field, value) of everything to move: all, those of a prefix, or those named,
    without keys (type, key) moved before. Expiry isn't moved."""
    out = None
    for kind, rows in tables.items():
        cols = [F.col(c).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("key", "field", "value")]
        part = rows.select(F.lit(kind).alias("type"), *cols)
        out = part if out is None else out.union(part)
    if prefix:
        out = out.where(F.col("key").startswith(prefix))
    if keys is not None:
        out = out.where(F.col("key").isin(*keys))
    return out if done is None else out.join(done.select("type", "key").distinct(), ["type", "key"], "left_anti")


def migrate_to(target: str, tables: Mapping[str, DataFrame], **which) -> DataFrame:
    """Moves rows to a table of ``target``, split by type, and gives what this run moved.

    Keys that the target has already stay as they are, so a run that failed can be run again.
    """
    spark = next(iter(tables.values())).sparkSession
    done = spark.read.schema("type string, key string").parquet(target) if exists(spark, target) else None
    run = uuid.uuid4().hex
    migrate(tables, done, **which).withColumn("run", F.lit(run)).write.mode("append").partitionBy("type", "run").parquet(target)
    moved = spark.read.schema("key string, field string, value string, type string, run string").parquet(target)
    return moved.where(F.col("run") == run).select("type", "key", "field", "value")


def migration_stats(moved: DataFrame) -> DataFrame:
    return moved.groupBy("type").agg(F.count_distinct("key").alias("n_keys"), F.count(F.lit(1)).alias("n_rows"))
