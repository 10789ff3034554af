"""Tables and reports on where values came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlog.fixed import METHODS, NO_METHOD
from evlog.operators.normalize import LEAVES, NETWORK, SOURCE


def provenance_table(df: DataFrame) -> DataFrame:
    """One row per record."""
    return df.select("batch_id", "pos", F.posexplode("provenance").alias("record_no", "r")).select(
        "batch_id", "pos", "record_no", "r.canonical_field", "r.source_field", "r.value", "r.method", "r.confidence"
    )


def merge_provenance(first: Column, second: Column) -> Column:
    """Order-preserving concatenation; a missing side counts as empty."""
    return F.when(first.isNull(), second).when(second.isNull(), first).otherwise(F.concat(first, second))


def event_summary(records: Column) -> Column:
    """Struct(count, methods, mean_confidence) of one event's records."""
    total = F.aggregate(records, F.lit(0.0), lambda a, r: a + F.coalesce(r["confidence"], F.lit(0.0)))
    methods = F.array_sort(F.array_distinct(records["method"]))
    return F.struct(
        F.size(records).cast("bigint").alias("count"),
        F.map_from_arrays(
            methods, F.transform(methods, lambda m: F.size(F.filter(records, lambda r: r["method"] == m)))
        ).alias("methods"),
        F.when(F.size(records) > 0, F.round(total / F.size(records), 3)).alias("mean_confidence"),
    )


def provenance_summary(df: DataFrame, *by: str) -> DataFrame:
    """Records, records per method and mean confidence per group; events without any count too.

    ``methods`` counts whatever methods occur; the named ones and ``other`` are columns too and add up to the records.
    Each event is reduced to a few numbers per method before the shuffle.
    """
    records = F.col("provenance")
    used = F.transform(records, lambda r: F.coalesce(r["method"], F.lit(NO_METHOD)))
    counts = F.transform(
        F.array_distinct(used),
        lambda m: F.struct(m.alias("method"), F.size(F.filter(used, lambda u: u == m)).cast("bigint").alias("n")),
    )
    # whole millionths add up to the same sum in any order
    millionths = F.transform(records, lambda r: F.round(F.coalesce(r["confidence"], F.lit(0.0)) * 1e6).cast("bigint"))
    total = F.aggregate(millionths, F.lit(0).cast("bigint"), lambda a, c: a + c)
    per_event = df.select(*by, total.alias("_sum"), F.posexplode_outer(counts).alias("_at", "_m"))
    first = F.coalesce(F.col("_at"), F.lit(0)) == 0  # what belongs to the event, not to a method, is counted once
    per_method = per_event.groupBy(*by, F.col("_m.method").alias("_method")).agg(
        F.coalesce(F.sum("_m.n"), F.lit(0)).alias("_n"),
        F.count_if(first).alias("_events"),
        F.sum(F.when(first, F.col("_sum")).cast("decimal(20,0)")).alias("_sum"),
    )

    def of(method):
        return F.coalesce(F.sum(F.when(F.col("_method") == method, F.col("_n"))), F.lit(0))

    entry = F.when(F.col("_method").isNotNull(), F.struct("_method", "_n"))
    other = ~F.coalesce(F.col("_method").isin(METHODS), F.lit(True))
    return (
        per_method.groupBy(*by)
        .agg(
            F.sum("_events").alias("events"),
            F.sum("_n").alias("records"),
            *[of(m).alias(m) for m in METHODS],
            F.coalesce(F.sum(F.when(other, F.col("_n"))), F.lit(0)).alias("other"),
            F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("methods"),
            F.coalesce(F.sum("_sum"), F.lit(0)).alias("_sum"),
        )
        .withColumn("mean_confidence", F.round(F.try_divide(F.col("_sum") / F.lit(1_000_000), "records"), 3).cast("double"))
        .drop("_sum")
    )


def canonical_leaf(name: str) -> Column:
    at = "source." if name in SOURCE else "network." if name in NETWORK else ""
    return F.col(f"canonical.{at}{name}")


def field_coverage(df: DataFrame) -> DataFrame:
    """Populated rows and rate per canonical field and format.

    Counted as columns in one pass; only the few result rows are turned long.
    """
    counts = df.groupBy(F.col("canonical.source.format").alias("format")).agg(
        F.count(F.lit(1)).alias("events"), *[F.count(canonical_leaf(n)).alias(n) for n in LEAVES]
    )
    return counts.unpivot(["format", "events"], list(LEAVES), "canonical_field", "populated").withColumn(
        "rate", F.col("populated") / F.col("events")
    )


def lineage_mismatch(df: DataFrame) -> DataFrame:
    """Network records whose value is not the canonical one, as left behind by repeated keys.

    Both sides sit in the same row, so this needs no join.
    """
    net = F.col("canonical.network")
    value = F.when(F.lit(False), "")
    for n in NETWORK:
        value = value.when(F.col("r.canonical_field") == f"network.{n}", F.col("_net")[n].cast("string"))
    # records of other fields are left out before anything is exploded, and only the network block goes along
    numbered = F.transform("provenance", lambda r, i: F.struct(i.alias("record_no"), r.alias("r")))
    wanted = F.filter(numbered, lambda x: F.startswith(x["r"]["canonical_field"], F.lit("network.")))
    rows = df.select("batch_id", "pos", net.alias("_net"), F.explode(wanted).alias("_x")).select("batch_id", "pos", "_net", "_x.record_no", "_x.r")
    return (
        rows.withColumn("canonical_value", value)
        .filter(~F.col("r.value").eqNullSafe(F.col("canonical_value")))
        .select(
            "batch_id", "pos", "record_no", "r.canonical_field", "r.source_field", "r.value", "canonical_value"
        )
    )
