"""Session settings and places for stored intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Single-machine session for tests and measurements."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evlog")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "512k")  # small test tables still use all cores
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for a stored intermediate table, below the folder that the cluster names in ``spark.checkpoint.dir``.

    A session that names none is refused: a folder of one machine would not be there for the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share, or name a path for {name}")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The rows, written once by the columns ``by`` below ``spark.checkpoint.dir`` and read again; they go when the driver ends.

    Where that setting is missing, a local session gets a folder of its own; any other session is refused. Shuffle
    files of the step go with it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.master.startswith("local") and not (spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")):
        path = os.path.join(tempfile.gettempdir(), "evlog-shared", f"{name}-{uuid.uuid4().hex}")
    else:
        path = work_path(spark, name)
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)
    files.deleteOnExit(hadoop)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is stored."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop, True)
