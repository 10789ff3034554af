"""Seal raw events and set blank ones aside.  Both are narrow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlog.fixed import BLANK_REASON
from evlog.functions.text import strip


def seal(df: DataFrame) -> DataFrame:
    """Drop every trailing newline and hash the exact remaining text."""
    return df.withColumn("raw", F.rtrim("raw", F.lit("\n"))).withColumn("raw_sha256", F.sha2("raw", 256))


def _blank():
    return F.coalesce(strip(F.col("raw")) == "", F.lit(True))


def mark_blank(df: DataFrame) -> DataFrame:
    """Add ``reason``: why a row is set aside, null for accepted ones.  One pass over the input."""
    return df.withColumn("reason", F.when(_blank(), F.lit(BLANK_REASON)))


def split_blank(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): blank and null events are set aside with a reason.

    Each part is a scan of its own: for a large input store ``mark_blank`` once, partitioned by reason.
    """
    marked = df if "reason" in df.columns else mark_blank(df)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def event_id(batch="batch_id", pos="pos", raw_sha256="raw_sha256"):
    """Deterministic id, so that a retried task writes the same event again."""
    key = F.concat_ws("|", F.col(batch), F.col(pos).cast("string"), F.col(raw_sha256))
    return F.concat(F.lit("evt-"), F.sha2(key, 256))
