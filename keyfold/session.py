"""Sessions and tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on, or that suit keyed state. Others are the cluster's.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with this library's settings; ``settings`` use ``__`` for dots."""
    builder = SparkSession.builder.appName("keyfold")
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the folder in spark.checkpoint.dir, which executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="keyfold-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables in the shared folder. Results that read them must be stored first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/keyfold")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/keyfold/{name}-{os.urandom(8).hex()}"
