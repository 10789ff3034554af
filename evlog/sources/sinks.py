"""Result tables and JSON export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evlog.operators.merkle import merkle_nodes, merkle_root
from evlog.operators.provenance import provenance_table
from evlog.operators.validate import FAIL, HELD, USABLE, issues_table

EXPORT = [
    "event_id", "raw_evidence", "raw_sha256", "format_detection", "canonical_event",
    "provenance", "validation", "integrity", "processed_at",
]


#: Columns by which single events are looked up.
LOOKED_UP = ["canonical_event.event_id", "canonical_event.raw_sha256"]

# results that other stored columns hold already
DERIVED = ["provenance", "raw_sha256", "event_id"]


def export_json(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON document per event with evidence, canonical event, provenance and hashes."""
    whole_results(results).select(*EXPORT).write.mode(mode).option("ignoreNullFields", "false").json(path)


def whole_results(events: DataFrame) -> DataFrame:
    """The result rows of a stored events table: columns that are stored once, inside the canonical event, are put back."""
    event = F.col("canonical_event")
    missing = {c: event[c] for c in DERIVED if c not in events.columns}
    return events.withColumns(missing) if missing else events


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events that ``write_tables`` stored, as the rows of ``process`` with their route."""
    return whole_results(spark.read.parquet(f"{path}/events"))


def find_events(spark: SparkSession, path: str, event_ids: list[str] | None = None, raw_hashes: list[str] | None = None) -> DataFrame:
    """Stored events by event ids, by hashes of their raw lines, or by both.

    The Bloom filters of the files tell which of them may hold a value, so the others' rows are not read. Without
    either list nothing is asked for.
    """
    wanted = None
    for column, values in zip(LOOKED_UP, (event_ids, raw_hashes)):
        if values is not None:
            here = F.col(column).isin(list(values))
            wanted = here if wanted is None else wanted & here
    if wanted is None:
        raise ValueError("name event ids or hashes")
    return whole_results(spark.read.parquet(f"{path}/events").filter(wanted))


def write_tables(results: DataFrame, path: str, quarantine: DataFrame | None = None, part: str = "", nodes: bool = False, roots: bool = True) -> DataFrame:
    """Write events, provenance, issues, Merkle roots and quarantine below ``path``, and with ``nodes`` all nodes by level.

    Without ``roots`` the events may be a later part of their batches; the leaves (batch_id, pos, leaf) as stored are returned.

    The events table is computed once and written by route (usable or held back) and format; the other tables are
    read from it, with only the columns they need.  Provenance and hashes are stored once, inside the canonical
    event.  Each part is overwritten as a whole, so writing the same part again changes nothing.  Event ids and raw
    hashes have Bloom filters (``find_events``).
    """
    spark = results.sparkSession

    def at(table):
        return f"{path}/{table}" + (f"/part={part}" if part else "")

    usable = (F.col("validation.result") != FAIL) & F.col("understood")
    routed = results.withColumn("route", F.when(usable, USABLE).otherwise(HELD)).drop(*DERIVED)
    filters = {f"parquet.bloom.filter.enabled#{c}": "true" for c in LOOKED_UP} | {"parquet.bloom.filter.adaptive.enabled": "true"}
    routed.write.mode("overwrite").options(**filters).partitionBy("route", "format").parquet(at("events"))
    events = whole_results(spark.read.schema(routed.schema).parquet(at("events")))
    provenance_table(events).write.mode("overwrite").parquet(at("provenance"))
    issues_table(events).write.mode("overwrite").parquet(at("issues"))
    leaves = events.select("batch_id", "pos", F.col("raw_sha256").alias("leaf"))
    if roots:
        merkle_root(leaves).write.mode("overwrite").parquet(at("roots"))
    if nodes:
        merkle_nodes(leaves).write.mode("overwrite").partitionBy("level").parquet(at("nodes"))
    if quarantine is not None:
        quarantine.write.mode("overwrite").parquet(at("quarantine"))
    return leaves
