"""Canonical serialisation, its hash, and the check of raw hashes against a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlog.fixed import DIGEST_LENGTH, DIGEST_REASON
from evlog.functions.text import strip
from evlog.operators.normalize import NETWORK, SOURCE

ALGORITHM = "sha256"


def _struct(event: Column, names) -> Column:
    return F.struct(*[event[n].alias(n) for n in sorted(names)])


def canonical_json(event: Column) -> Column:
    """Stable text of a canonical event: sorted keys, no blanks, nulls written out.

    Map columns are built key-sorted, so only struct fields need ordering here.
    """
    records = F.transform(
        event["provenance"],
        lambda r: F.struct(
            r["canonical_field"].alias("canonical_field"),
            r["confidence"].alias("confidence"),
            r["method"].alias("method"),
            r["source_field"].alias("source_field"),
            r["value"].alias("source_value"),
        ),
    )
    nested = {
        "fields": _struct(event["fields"], ["extra"]),
        "network": _struct(event["network"], NETWORK),
        "source": _struct(event["source"], [*SOURCE, "format"]),
        "provenance": records,
    }
    names = [
        "action", "confidence", "event_id", "fields", "host", "message", "network", "network_protocol",
        "policy_id", "provenance", "raw_sha256", "severity", "signature_id", "source", "timestamp", "user",
    ]
    ordered = F.struct(*[nested.get(n, event[n]).alias(n) for n in names])
    return F.to_json(ordered, {"ignoreNullFields": "false"})


def canonical_hash(event: Column) -> Column:
    return F.sha2(canonical_json(event), 256)


def integrity_block(raw_sha256: Column, canonical_sha256: Column, event_id: Column) -> Column:
    return F.struct(
        raw_sha256.alias("raw_sha256"),
        canonical_sha256.alias("canonical_sha256"),
        event_id.alias("event_id"),
        F.lit(ALGORITHM).alias("algorithm"),
    )


def verify_hashes(sealed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Compare sealed rows with a manifest (batch_id, pos, expected_sha256).

    ``status`` is match, mismatch, missing (only in the manifest) or unexpected.
    """
    got = sealed.select("batch_id", "pos", F.col("raw_sha256").alias("computed_sha256"))
    want = manifest.select(
        "batch_id", "pos", F.lower(strip(F.col("expected_sha256"))).alias("expected_sha256"), F.lit(True).alias("_listed")
    )
    both = got.join(want, ["batch_id", "pos"], "full_outer")
    status = (
        F.when(F.col("computed_sha256").isNull(), "missing")
        .when(F.col("_listed").isNull(), "unexpected")
        .when(F.col("computed_sha256") == F.col("expected_sha256"), "match")
        .otherwise("mismatch")
    )
    return both.select(
        "batch_id", "pos", "computed_sha256", "expected_sha256",
        (status == "match").alias("matches"), status.alias("status"),
    )


def valid_digest(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(usable, quarantined): digests must be texts of 64 characters."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(F.length(c) == DIGEST_LENGTH, F.lit(False))
    return df.filter(ok), df.filter(~ok).withColumn(
        "reason", F.lit(DIGEST_REASON.format(columns=", ".join(columns)))
    )
