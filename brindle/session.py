"""Session factory used by tests, the benchmark and scripts."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of the library's files: texts of a kind, such as prompts and answers, take half the room that they take by default.
COMPRESSION = "zstd"


def get_session(app: str = "brindle", cpus: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with adaptive execution and UTC timestamps.

    On a cluster the submitter's own configuration wins: only `spark.sql.*`
    settings that the plans rely on are given here.
    """
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; in a local session without it a new temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="brindle-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, which cuts its lineage; files stay until `discard` or the folder's owner clears them."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", COMPRESSION).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete what `written` wrote for frames that nothing reads any more."""
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)


def remove(spark: SparkSession, folder: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps that are written out and done; its cleaner waits for the driver to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def few_or_dealt(df: DataFrame, most: int) -> DataFrame:
    """A written table for a join: sent to all tasks up to `most` rows, else shuffled. Spark would go by its files, which are far smaller than its rows."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")
