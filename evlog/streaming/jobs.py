"""The same transforms over a stream of text files: sealed micro-batch by micro-batch, or source by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evlog.operators.frontier import PEAKS, merkle_append, with_root
from evlog.operators.ingest import split_blank
from evlog.operators.merkle import leaf_positions
from evlog.plans.process import process
from evlog.session import drop_path
from evlog.sources.sinks import write_tables


def read_raw_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Lines of files as they arrive, with the place they came from."""
    return (
        spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", max_files).text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("value").alias("raw"),
            F.col("_metadata.file_modification_time").alias("seen"),
        )
    )


def process_stream(stream: DataFrame, out: str, checkpoint: str, registry: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Seal each micro-batch as one batch and write its tables and Merkle root.

    Every table part is keyed by the micro-batch number and overwritten, so a
    micro-batch that runs again after a failure leaves the same result.  The lines
    are landed first; positions and hashes are computed from what was landed, and
    the landed part goes once its tables are written.  Unknown lines of a layout in ``registry`` are mapped by it.
    """

    def seal_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        landing = f"{out}/landing/part={number}"
        batch.withColumn("seq", F.monotonically_increasing_id()).write.mode("overwrite").parquet(landing)
        landed = spark.read.parquet(landing).select(
            F.lit(f"stream-{number}").alias("batch_id"), F.struct("file", "block", "seq").alias("_at"), "raw"
        )
        accepted, blank = split_blank(landed)
        numbered = leaf_positions(accepted, "_at").select("batch_id", "pos", "raw")
        write_tables(process(numbered, registry), out, blank.select("batch_id", "raw", "reason"), part=str(number))
        drop_path(spark, landing)

    return (
        stream.writeStream.foreachBatch(seal_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


# --- batches that follow the source ------------------------------------------

#: Open and sealed batches: what a further line needs to know of the lines before it.
SEALS = f"batch_id string, leaf_count bigint, peaks {PEAKS}, last_seen timestamp, sealed boolean, root string"


def folder_of(file: Column) -> Column:
    """The folder a file lies in."""
    return F.regexp_replace(file, "/[^/]*$", "")


def seals_after(spark: SparkSession, out: str, number: int) -> DataFrame:
    """The batches as micro-batch ``number`` left them; none before the first."""
    if number < 0:
        return spark.createDataFrame([], SEALS)
    return spark.read.schema(SEALS).parquet(f"{out}/seals/part={number}")


def read_seals(spark: SparkSession, out: str) -> DataFrame:
    """Each source's lines so far: leaf_count, root, when its last file was written, and whether it is sealed."""
    every = spark.read.schema(f"{SEALS}, part int").parquet(f"{out}/seals")
    latest = every.agg(F.max("part")).first()[0]
    return every.filter(F.col("part") == latest).drop("part", "peaks")


def seal_stream(stream: DataFrame, out: str, checkpoint: str, source=folder_of, idle: str = "1 hour", registry: DataFrame | None = None, **trigger) -> StreamingQuery:
    """As ``process_stream``, but a batch is a source, whatever number of micro-batches its files arrive in.

    ``source`` names the batch of a file. Lines are numbered on from those before, and the Merkle tree grows by its frontier: each
    micro-batch leaves a row for each source below ``seals`` (count, peaks, root), which the next one goes on from. So the root depends
    on the lines and their order, not on how triggers cut them. A source whose last file was written more than ``idle`` before the
    latest one of all is sealed; lines that come for it later are reported below ``late`` and change nothing.
    A micro-batch that runs again starts from the rows of the one before it and overwrites its own parts.
    """

    def seal_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        landing = f"{out}/landing/part={number}"
        batch.withColumn("seq", F.monotonically_increasing_id()).write.mode("overwrite").parquet(landing)
        landed = spark.read.parquet(landing).withColumn("batch_id", source(F.col("file")))
        before = seals_after(spark, out, number - 1)
        closed = before.filter("sealed").select("batch_id")
        landed.join(closed, "batch_id", "left_semi").select("batch_id", "file", "block", "seq", "raw", "seen").write.mode("overwrite").parquet(f"{out}/late/part={number}")
        fresh = landed.join(closed, "batch_id", "left_anti")
        accepted, blank = split_blank(fresh.select("batch_id", F.struct("file", "block", "seq").alias("_at"), "raw"))
        counts = before.select("batch_id", F.col("leaf_count").alias("_before"))
        numbered = leaf_positions(accepted, "_at").join(counts, "batch_id", "left")
        numbered = numbered.select("batch_id", (F.col("pos") + F.coalesce("_before", F.lit(0))).alias("pos"), "raw")
        leaves = write_tables(process(numbered, registry), out, blank.select("batch_id", "raw", "reason"), part=str(number), roots=False)
        grown = merkle_append(before.select("batch_id", "leaf_count", "peaks"), leaves)[1]
        seen = fresh.groupBy("batch_id").agg(F.max("seen").alias("_seen"))
        both = before.select("batch_id", "last_seen", "sealed").join(seen, "batch_id", "full_outer").join(grown, "batch_id", "left")
        both = both.withColumn("last_seen", F.greatest("last_seen", "_seen"))
        newest = both.agg(F.max("last_seen")).first()[0]
        old = F.col("last_seen") < F.lit(newest) - F.expr(f"interval {idle}")
        after = both.select(
            "batch_id", F.coalesce("leaf_count", F.lit(0).cast("long")).alias("leaf_count"), F.coalesce("peaks", F.create_map().cast(PEAKS)).alias("peaks"),
            "last_seen", (F.coalesce("sealed", F.lit(False)) | F.coalesce(old, F.lit(False))).alias("sealed"),
        )
        with_root(after).write.mode("overwrite").parquet(f"{out}/seals/part={number}")
        drop_path(spark, landing)
        if number > 1:  # a repeated micro-batch needs the rows of the one before it only
            drop_path(spark, f"{out}/seals/part={number - 2}")

    return (
        stream.writeStream.foreachBatch(seal_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
