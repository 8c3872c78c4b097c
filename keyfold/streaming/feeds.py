"""Change feeds and streaming folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from keyfold.session import new_folder


def watch(log: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """(pattern, key, event, revision) for each log row and pattern that its key matches.

    Patterns are exact, or prefixes with a trailing ``*``. They are a subscriber's list, named in
    the plan; the log may be a stream.
    """
    key = F.col("key")
    hits = [F.when(key.startswith(p[:-1]) if p.endswith("*") else key == p, F.lit(p)) for p in patterns]
    return log.select(F.explode(F.array_compact(F.array(*hits))).alias("pattern"), "key", F.col("op").alias("event"), F.col("seq").alias("revision"))


def publish(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """messages (channel, message) for each subscription (subscriber, channel) that they reach."""
    return messages.join(subscriptions, "channel")


def offsets(log: DataFrame, size: str = "value") -> DataFrame:
    """Log rows with ``begin`` and ``end`` byte offsets in the replication stream.

    ``size`` names a text whose bytes, with a frame of eight, are sent. The running sum is over
    whole rows in order of seq, range by range; a stream of many files keeps offsets in its source.
    """
    from keyfold.plans.rank import running_total

    bytes_ = F.octet_length(size) + 8
    placed = running_total(log, [F.col("seq")], bytes_, "end")
    return placed.withColumn("begin", F.col("end") - bytes_)


def backlog(placed: DataFrame, from_offset: int, capacity: int) -> tuple[str, DataFrame]:
    """("continue", rows from the offset) if the ring still holds it, else ("full", all rows)."""
    last = placed.agg(F.max("end")).first()[0] or 0
    if max(0, last - capacity) <= from_offset <= last:
        return "continue", placed.where(F.col("begin") >= from_offset)
    return "full", placed


WRITES = ("PUT", "DEL", "RDEL")


def writes_only(log: DataFrame) -> DataFrame:
    return log.where(F.col("op").isin(*WRITES))


def log_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 0) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def folded_stream(log: DataFrame) -> DataFrame:
    """(key, op, value, seq): the newest version of each key, as a streaming aggregate."""
    last = log.groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("last"), F.max("seq").alias("seq"))
    return last.select("key", F.col("last.op").alias("op"), F.col("last.value").alias("value"), "seq")


def sessions(log: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """(key, start, end, n): runs of a key's rows no further apart than ``gap``. In append mode a run
    comes out, and its state goes, when the watermark passes its end; complete mode keeps all."""
    rows = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = rows.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windows(log: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(key, start, n) of tumbling or sliding windows of event time. In append and update mode a
    window's state goes when the watermark passes it; complete mode keeps all."""
    rows = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy("key", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("key", F.col("w.start").alias("start"), "n")


def run_once(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives when it has read all that is there, with ``batch``'s number in update mode.

    Each micro-batch is written under its number, so a batch that is tried again replaces itself.
    In complete mode the last batch is the result; in update mode the caller takes the last row of
    each key. A stream without files gives an empty result. The checkpoint goes at the end.
    """
    spark = stream.sparkSession
    folder = new_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    q: StreamingQuery = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    )
    q.awaitTermination()
    state = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state")
    fs = state.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(state, True)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")):
        out = spark.createDataFrame([], schema)
    else:
        out = spark.read.schema(schema).parquet(f"{folder}/out")
    if mode == "complete":
        last = out.agg(F.max("batch")).first()[0]
        out = out.where(F.col("batch") == F.lit(last)).drop("batch")
    return out if mode == "update" else out.drop("batch")


def latest_of_updates(out: DataFrame, key: Sequence[str]) -> DataFrame:
    """The last row of each key over the batches of an update-mode stream."""
    rest = [c for c in out.columns if c not in (*key, "batch")]
    last = out.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest])
