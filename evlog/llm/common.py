"""Helpers that several operators share. Columns whose names start with ``_llm`` are their own, for the time of a join."""

from __future__ import annotations

import os
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``; it goes when the driver ends.

    Where that setting is missing, a local session gets a folder of its own; any other session is refused.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = os.path.join(tempfile.gettempdir(), "evlog-shared")
    path = f"{named.rstrip('/')}/llm-{uuid.uuid4().hex}"
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)
    files.deleteOnExit(hadoop)
    return files.makeQualified(hadoop).toString()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go as soon as the job that made them has ended."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs inside hand at most so many rows at once to Python: for rows that are large, or become so."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read again: later steps don't depend on lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rows"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_hash(id_col: str, text_col: str) -> Column:
    """A 64-bit key of a document row, for steps where it does no harm that some pair of rows may share one."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def row_key(id_col: str, text_col: str) -> Column:
    """A 128-bit key of a document row, of two seeds; rows with equal id and text share it."""
    return F.struct(row_hash(id_col, text_col).alias("a"), F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col)).alias("b"))


def bounded_sample(df: DataFrame, want: int, total: int, *columns: str) -> DataFrame:
    """At most ``want`` rows of about ``total``, chosen by a hash of the columns: the same ones on every run.

    A hash threshold leaves about twice as many before they are ordered, so that all tasks together send a bounded number.
    """
    key = F.xxhash64(*columns, F.lit(5))
    if total > 2 * want:
        df = df.filter(F.pmod(key, F.lit(1 << 40)) < int(2 * want / total * (1 << 40)))
    return df.orderBy(key, *columns).limit(want)


def per_process(name: str, make: Callable):
    """``make()`` once for each Python worker process, whatever number of tasks it runs."""
    store = sys.modules.setdefault("_evlog_llm_store", types.ModuleType("_evlog_llm_store")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def latest(slot: str, name: str, make: Callable):
    """As ``per_process``, but a slot holds only the value made last: another name takes its place."""
    store = per_process("latest", dict)
    if store.get(slot, (None,))[0] != name:
        store[slot] = (name, make())
    return store[slot][1]


def texts_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


def join_hot(left: DataFrame, right: DataFrame, key: str, count: str, total: int, hot_share: int = 10_000) -> DataFrame:
    """Left join by ``key`` that deals hot keys out evenly. ``right`` has one row per key and its ``count`` in ``left``.

    Keys with more than ``total / hot_share`` rows number fewer than ``hot_share``, so they may be broadcast; the
    rows they meet are spread over the shuffle by their content. All others meet in an ordinary join.
    """
    least = max(1, total // hot_share)
    values = [c for c in right.columns if c not in (key, count)]
    hot = right.filter(F.col(count) > least).select(F.col(key), F.struct(*values).alias("_llm_hot"))
    cold = right.filter(F.col(count) <= least).select(F.col(key).alias("_llm_cold_key"), F.lit(False).alias("_llm_cold_only"), F.struct(*values).alias("_llm_cold"))
    spread, kind = F.col("_llm_hot").isNotNull(), left.schema[key].dataType
    own = F.xxhash64(*left.columns)
    own = own.cast("string").cast(kind) if kind.typeName() == "binary" else own.cast(kind)
    met = left.join(F.broadcast(hot), key, "left").withColumn("_llm_dealt", F.when(spread, own).otherwise(F.col(key)))
    met = met.withColumn("_llm_is_hot", spread).join(cold, (F.col("_llm_dealt") == F.col("_llm_cold_key")) & (F.col("_llm_is_hot") == F.col("_llm_cold_only")), "left")
    return met.select(*left.columns, *[F.coalesce(F.col("_llm_hot")[v], F.col("_llm_cold")[v]).alias(v) for v in values])
