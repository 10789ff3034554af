"""Batch results: one row per event, and one row per batch with its proof."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlog import fixed as X
from evlog.operators.ingest import seal
from evlog.operators.integrity import canonical_hash
from evlog.operators.merkle import folded_batches
from evlog.plans.process import validated_events


def leaves(df: DataFrame) -> DataFrame:
    """(batch_id, pos, leaf): the raw hash of every event is its leaf."""
    return seal(df).select("batch_id", "pos", F.col("raw_sha256").alias("leaf"))


def process_batch(df: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Per event: raw, raw_sha256, event_id, format, canonical_sha256, validation."""
    return validated_events(df, registry).select(
        "batch_id",
        "pos",
        "raw",
        "raw_sha256",
        F.col("canonical.event_id").alias("event_id"),
        "format",
        canonical_hash(F.col("canonical")).alias("canonical_sha256"),
        F.col("validation.result").alias("validation"),
    )


def batch_summary(df: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Per batch: events, formats, verdicts, Merkle root and the outcome of its own verification.

    One scan: the counts ride along with the leaves in the fold of the tree.
    """
    done = validated_events(df, registry)
    flags = {
        **{f.lower(): F.col("format") == f for f in [*X.KNOWN_FORMATS, X.UNKNOWN]},
        **{n: F.col("validation.result") == r for r, n in (("PASS", "passed"), ("WARNING", "warned"), ("FAIL", "failed"))},
    }
    leaves = done.select(
        "batch_id", "pos", F.col("raw_sha256").alias("leaf"), *[f.cast("int").cast("bigint").alias(n) for n, f in flags.items()]
    )
    folded = folded_batches(leaves, sums=tuple(flags))
    return folded.select(
        "batch_id",
        F.col("leaf_count").alias("processed"),
        *flags,
        F.col("root").alias("merkle_root"),
        "leaf_count",
        F.col("all_leaf_proofs_valid").alias("verified"),
    )
