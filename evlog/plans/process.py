"""From raw rows to the wide result row: one narrow stage, so batch and stream share it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlog import fixed as X
from evlog.operators.ingest import seal
from evlog.operators.integrity import canonical_hash, integrity_block
from evlog.operators.normalize import normalize
from evlog.functions.text import kept, let
from evlog.operators.keys import KEY_BYTES, KeyRows, key_rows
from evlog.operators.onboard import cells, onboarding, template_records, with_layouts
from evlog.operators.parse import classify, parse, seen_keys
from evlog.operators.validate import validate


def needed_keys(df: DataFrame, keys: DataFrame | None, limit: int = KEY_BYTES) -> KeyRows:
    """Rows of a key registry (format, key, canonical_field) that the lines of ``df`` need; lines are read only if it is over the limit."""
    return () if keys is None else key_rows(keys, None if df.isStreaming else seen_keys(classify(seal(df))), limit)


def canonical_events(df: DataFrame, registry: DataFrame | None = None, keys: DataFrame | None = None, where: Column | str | None = None) -> DataFrame:
    """(batch_id, pos, raw) -> sealed, classified, parsed and normalised rows.

    With a ``registry`` of layouts, unknown lines of a registered layout are mapped by it instead of by position; a registry
    of ``keys`` comes before the built-in key tables. ``where`` is a condition on input columns: it reaches the scan. Any filter
    that follows is applied to rows that are computed already.
    """
    df = df if where is None else df.filter(where)
    found = classify(seal(df))
    rows = needed_keys(df, keys)
    if registry is None:
        return normalize(parse(found, keys=rows))
    found = with_layouts(found, registry, F.col("format") == X.UNKNOWN)
    parsed = parse(found, keys=rows)
    by_layout = let(cells(F.col("raw")), lambda c: template_records(c, F.col("steps")))
    mapped = F.when(F.col("steps").isNotNull(), by_layout).otherwise(F.col("provenance"))
    return normalize(parsed.withColumn("provenance", kept(mapped)).drop("signature", "steps"))


def validated_events(df: DataFrame, registry: DataFrame | None = None, keys: DataFrame | None = None, where: Column | str | None = None) -> DataFrame:
    """``canonical_events`` with ``validation`` and ``understood``."""
    known = (F.col("format") != X.UNKNOWN) & (F.col("parse.status") == "ok")
    found = (F.col("format") == X.UNKNOWN) & (F.size("provenance") > 0)
    return validate(canonical_events(df, registry, keys, where)).withColumn("understood", known | found)


def process(df: DataFrame, registry: DataFrame | None = None, keys: DataFrame | None = None, where: Column | str | None = None) -> DataFrame:
    """The whole result per event (see ``canonical_events``).  ``processed_at`` is in no hash."""
    done = validated_events(df, registry, keys, where).withColumn("_hash", canonical_hash(F.col("canonical")))
    event_id = F.col("canonical.event_id")
    return done.select(
        "batch_id",
        "pos",
        event_id.alias("event_id"),
        F.col("raw").alias("raw_evidence"),
        "raw_sha256",
        "format",
        F.col("detection").alias("format_detection"),
        F.array("parse").alias("parse"),
        F.col("canonical").alias("canonical_event"),
        "provenance",
        "validation",
        integrity_block(F.col("raw_sha256"), F.col("_hash"), event_id).alias("integrity"),
        "understood",
        F.when(F.col("format") == X.UNKNOWN, onboarding(F.col("raw"), F.col("provenance"))).alias("onboarding"),
        F.current_timestamp().alias("processed_at"),
    )
