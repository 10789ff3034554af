"""Exact duplicates by a heavy-hitter split: frequent digests are settled by broadcast, all others by an ordinary shuffle.

Misra-Gries counters (Spark's ``freqItems``) name every digest that more than one row in ``COUNTERS`` has, and perhaps some
others. The named ones are counted exactly, which verifies them; winners of those that are truly frequent number fewer than
``COUNTERS``, so each task can have them all, and rows of frequent texts are settled where they stand. All other
groups are small by this count, and only their rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

#: Misra-Gries counters; fewer digests than that can each have more than one row in so many.
COUNTERS = 2_000
#: The characters that do not count, ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without blanks; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_row (its number in the stored table), _id, _digest (32 bytes), _chars of every row; texts are read here only."""
    chars = F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    digest = F.unhex(F.sha2(normalised(F.col(text_col)), 256))
    return stored(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), digest.alias("_digest"), chars.alias("_chars")))


def frequent(rows: DataFrame, total: int, counters: int = COUNTERS) -> DataFrame:
    """_digest, _size and _best of the digests with more than one row in ``counters``: fewer rows than ``counters``.

    Misra-Gries counters miss no such digest; what else they name goes by the exact count. ``_best`` ranks a row of most
    characters first, then the smallest id (null last), then the row stored first.
    """
    named = rows.select(F.hex("_digest").alias("_digest")).stat.freqItems(["_digest"], 1 / counters)
    named = named.select(F.explode("_digest_freqItems").alias("_digest")).select(F.unhex("_digest").alias("_digest"))
    rank = F.struct((-F.col("_chars")).alias("_less"), F.col("_id").isNull().alias("_none"), F.col("_id").alias("_id"), F.col("_row").alias("_row"))
    found = rows.join(F.broadcast(named), "_digest", "left_semi").groupBy("_digest").agg(F.count("*").alias("_size"), F.min(rank).alias("_best"))
    return found.filter(F.col("_size") * counters > total)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """id, keep_id, group_size, kept and text_sha256 of every row of ``docs``, dropped ones too.

    Texts are equal if they are identical without blanks (``BLANKS``). Of equal texts the row with the most code
    points stays, then that with the smallest id; a null id comes after all others, and of rows that tie in both exactly one is
    kept. A null text is an empty one, and equal to texts of blanks alone. Other columns are left out, whatever
    their names; an empty table gives no rows. The result does not depend on which digests Misra-Gries names.
    """
    rows = digests(docs, id_col, text_col)
    winners = stored(frequent(rows, rows.count(), counters))
    settled = rows.join(F.broadcast(winners), "_digest", "left")
    hot = settled.filter("_size is not null").select("_id", F.col("_best._id").alias("keep_id"), "_size", (F.col("_best._row") == F.col("_row")).alias("kept"), "_digest")
    equal = Window.partitionBy("_digest")
    best = equal.orderBy(F.col("_chars").desc(), F.col("_id").asc_nulls_last(), "_row")
    cold = settled.filter("_size is null").select("_id", F.first("_id").over(best).alias("keep_id"), F.count("*").over(equal).alias("_size"), (F.row_number().over(best) == 1).alias("kept"), "_digest")
    return hot.unionByName(cold).select(F.col("_id").alias(id_col), "keep_id", F.col("_size").alias("group_size"), "kept", F.lower(F.hex("_digest")).alias("text_sha256"))
