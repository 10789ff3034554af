"""Canonical event, confidences and the merge of two field sets."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlog.functions.text import kept, let, value_for
from evlog.operators.ingest import event_id

# leaf of the canonical event -> names under which records may carry it
LEAVES = {
    "timestamp": ["timestamp"],
    "vendor": ["vendor", "source.vendor"],
    "product": ["product", "source.product"],
    "source_ip": ["network.source_ip"],
    "source_port": ["network.source_port"],
    "destination_ip": ["network.destination_ip"],
    "destination_port": ["network.destination_port"],
    "network_protocol": ["network_protocol"],
    "action": ["action"],
    "policy_id": ["policy_id"],
    "severity": ["severity"],
    "signature_id": ["signature_id"],
    "user": ["user"],
    "host": ["host"],
    "message": ["message"],
}
SOURCE = ["vendor", "product"]
NETWORK = ["source_ip", "source_port", "destination_ip", "destination_port"]
TOP = [c for c in LEAVES if c not in SOURCE + NETWORK]


def leaf_struct(records: Column) -> Column:
    """Last value of every canonical leaf in a record array."""

    rev = F.reverse(records)
    return let(
        F.struct(rev["canonical_field"].alias("f"), rev["value"].alias("v")),
        lambda r: F.struct(*[_leaf(r["f"], r["v"], name).alias(name) for name in LEAVES]),
    )


def _leaf(names: Column, values: Column, name: str) -> Column:
    found = F.coalesce(*[value_for(names, values, F.lit(n)) for n in LEAVES[name]])
    return found.try_cast("int") if name.endswith("_port") else found


def merge_fields(parsed: Column, onboarded: Column) -> Column:
    """Leaf by leaf, the onboarding value over the parser's."""
    return F.struct(*[F.coalesce(onboarded[n], parsed[n]).alias(n) for n in LEAVES])


def field_confidence(records: Column) -> Column:
    """Map canonical field -> confidence of its first record, sorted by field."""

    def build(r: Column) -> Column:
        uniq = F.sort_array(F.array_distinct(r["canonical_field"]))
        first = F.transform(uniq, lambda k: value_for(r["canonical_field"], r["confidence"], k))
        return F.map_from_arrays(uniq, first)

    return let(records, build)


def normalize(df: DataFrame) -> DataFrame:
    """Add ``canonical`` to parsed rows and drop what it absorbs."""
    cols = _columns()
    staged = df.select("*", cols["_names"].alias("_names"), cols["_values"].alias("_values"))
    return staged.withColumn("canonical", cols["canonical"]).drop("_names", "_values", "head", "extra")


@cache
def _columns() -> dict[str, Column]:
    # searched as plain columns, outside of any lambda, so the search is compiled
    head = F.col("head")
    value = {n: _leaf(F.col("_names"), F.col("_values"), n) for n in LEAVES}
    for n in ("vendor", "product", "message"):
        value[n] = F.coalesce(value[n], head[n])
    canonical = F.struct(
        event_id().alias("event_id"),
        value["timestamp"].alias("timestamp"),
        F.struct(*[value[n].alias(n) for n in SOURCE], F.col("format").alias("format")).alias("source"),
        F.struct(*[value[n].alias(n) for n in NETWORK]).alias("network"),
        *[value[n].alias(n) for n in TOP if n != "timestamp"],
        F.struct(F.col("extra").alias("extra")).alias("fields"),
        F.col("raw_sha256").alias("raw_sha256"),
        F.col("provenance").alias("provenance"),
        field_confidence(F.col("provenance")).alias("confidence"),
    )
    return {
        "_names": kept(F.reverse("provenance.canonical_field")),
        "_values": kept(F.reverse("provenance.value")),
        "canonical": kept(canonical),
    }
