"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("codescan")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CODESCAN_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only where ``spark.checkpoint.dir`` is unset and the master is local (tests) is a
    temporary folder taken.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the executors")
            folder = tempfile.mkdtemp(prefix="codescan-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def clear_work(spark: SparkSession) -> None:
    """Delete everything this session wrote to its shared folder; call it after the last result is stored."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared one, for a table or a stream's state."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Executors may be lost at any time: what follows starts from files, not from lineage.
    Unlike a checkpointed RDD the table has a known size, so later joins can broadcast it
    when it is small.
    """
    path = work_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes in the block delete their shuffles when they end; Spark keeps them until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def lent(df: DataFrame) -> Iterator[DataFrame]:
    """A table as ``cut_lineage`` returns it, deleted at the end of the block: nothing may read it later."""
    spark, path = df.sparkSession, work_folder(df.sparkSession, "table")
    with shuffles_freed(spark):
        df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def work_table(spark: SparkSession, purpose: str) -> str:
    """A new name for a managed table in the shared folder; DROP TABLE deletes its files."""
    folder = f"{shared_dir(spark)}/tables"
    database = f"codescan_{zlib.crc32(folder.encode()):08x}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{folder}'")
    return f"{database}.{purpose}_{uuid.uuid4().hex}"


def write_counted(df: DataFrame, path: str) -> int:
    """Write a table and return its number of rows, counted on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return seen.get["n"]


def write_epoch(rows: DataFrame, path: str, epoch: int) -> None:
    """Write a stream's batch as its own partition; a batch that runs again replaces it."""
    rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)
