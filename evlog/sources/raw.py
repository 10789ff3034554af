"""Raw events from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evlog.session import work_path


def read_raw(spark: SparkSession, path, unit: str = "line", counts: str | None = None, start: str = "{") -> DataFrame:
    """(batch_id, pos, raw): one event per line, each whole file as one event, or one per record of several lines.

    A record (``unit="record"``) begins with a line that begins with ``start``: ``{`` for pretty-printed JSON, ``<Event`` for
    elements of that name, a year for lines with traces below them. It holds all lines up to the next such line, without the line
    ends at its own end. The reader cuts files there as it cuts them at line ends, so records are whole at any split
    size, and nothing is stitched or sorted. Lines before a file's first record are an event of their own.

    ``batch_id`` is the file.  Line positions need no sort: within a file block
    the reader's row ids are consecutive, so a line's position is its distance
    from the first row of the block plus the number of lines in earlier blocks.

    One pass counts the lines per block and stores the counts, a row for every
    128 MB or so, at the path ``counts`` (a new one below ``spark.checkpoint.dir`` if
    none is named).  Spark broadcasts them if their measured size is below the
    session's limit, and then the lines themselves are never shuffled.  Should
    the reader cut or pack the files differently in the second pass, some row finds
    no block or lies outside of its ids, and the job fails.
    """
    if unit == "file":
        return spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("batch_id"), F.lit(0).cast("bigint").alias("pos"), F.col("value").alias("raw")
        )
    if unit not in ("line", "record") or not start:
        raise ValueError("unit must be 'line', 'file' or 'record', and a record needs a start")
    lines = spark.read.text(path, lineSep="\n" + (start if unit == "record" else "")).select(
        F.col("_metadata.file_path").alias("batch_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("raw"),
    )
    earlier = Window.partitionBy("batch_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = lines.groupBy("batch_id", "block").agg(
        F.min("seq").alias("first"), F.max("seq").alias("last"), F.count(F.lit(1)).alias("n")
    )
    counts = counts or work_path(spark, "line-counts")
    blocks = counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    blocks.write.mode("overwrite").parquet(counts)
    blocks = spark.read.parquet(counts)
    same = F.coalesce(F.col("seq").between(F.col("first"), F.col("last")), F.lit(False))
    pos = F.when(same, F.col("before") + F.col("seq") - F.col("first")).otherwise(
        F.raise_error(F.lit("the files were split differently when they were read again")).cast("bigint")
    )
    placed = lines.join(blocks, ["batch_id", "block"], "left").select("batch_id", pos.alias("pos"), "raw")
    if unit == "line":
        return placed
    whole = F.when(F.col("pos") == 0, F.col("raw")).otherwise(F.concat(F.lit(start), F.col("raw")))
    return placed.withColumn("raw", F.rtrim(whole, F.lit("\r\n")))
