import json

import pytest
from pyspark.sql import functions as F

from evlog.operators.merkle import merkle_nodes, merkle_root, tamper_locate
from evlog.plans.batch import batch_summary, leaves, process_batch
from evlog.plans.process import process
from evlog.sources.raw import read_raw
from evlog.sources.sinks import export_json, find_events, read_events, write_tables
from evlog.streaming.jobs import process_stream, read_raw_stream

from lines import CEF, JSON, LEEF, SYSLOG, UNKNOWN, XML

LINES = [UNKNOWN, CEF, "", LEEF, SYSLOG, JSON, XML + "\r"]


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_read_lines_in_file_order(spark, tmp_path, limit):
    folder = tmp_path / "logs"
    folder.mkdir()
    for n in ("one", "two"):
        (folder / f"{n}.log").write_bytes("\n".join([n, *LINES * 400]).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        rows = read_raw(spark, str(folder), counts=str(tmp_path / "counts")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for n in ("one", "two"):
        got = sorted((r.pos, r.raw) for r in rows if r.batch_id.endswith(f"{n}.log"))
        assert [p for p, _ in got] == list(range(len(got))) and [r for _, r in got] == [n, *LINES * 400]


def test_read_whole_files(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps(json.loads(JSON), indent=2) + "\n")
    row = process(read_raw(spark, str(tmp_path), unit="file")).first()
    assert row.format == "JSON" and row.canonical_event.network.source_ip == "198.18.0.14"


def test_tables_and_export(spark, raw_table, tmp_path):
    results = process(raw_table([x for x in LINES if x]))
    out = str(tmp_path / "out")
    write_tables(results, out)
    write_tables(results, out)
    events = read_events(spark, out)
    stored = spark.read.parquet(f"{out}/events")
    assert not {"provenance", "raw_sha256", "event_id"} & set(stored.columns) and set(events.columns) == set(results.columns) | {"route"}
    assert {r.route for r in stored.select("route").distinct().collect()} <= {"usable", "held"}
    assert events.count() == 6 and events.filter("format = 'CEF'").count() == 1
    assert spark.read.parquet(f"{out}/provenance").count() == events.agg(F.sum(F.size("provenance"))).first()[0]
    assert spark.read.parquet(f"{out}/issues").filter("severity = 'PASS'").count() > 0
    root = merkle_root(leaves(raw_table([x for x in LINES if x]))).first().root
    assert spark.read.parquet(f"{out}/roots").first().root == root
    export_json(results, str(tmp_path / "json"))
    docs = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert len(docs) == 6 and all(d["canonical_event"]["raw_sha256"] == d["raw_sha256"] for d in docs)


def test_batch(raw_table):
    table = raw_table([x for x in LINES if x])
    assert process_batch(table).filter("length(canonical_sha256) = 64").count() == 6
    row = batch_summary(table).first()
    assert (row.processed, row.cef, row.unknown, row.leaf_count, row.verified) == (6, 1, 1, 6, True)


def test_narrow_stages_run_on_a_stream(spark, raw_table, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = [x for x in LINES if x]
    (source / "a.log").write_text("\n".join(lines))
    stream = spark.readStream.option("lineSep", "\n").text(str(source)).select(
        F.lit("s").alias("batch_id"), F.lit(0).cast("bigint").alias("pos"), F.col("value").alias("raw")
    )
    query = process(stream).writeStream.format("memory").queryName("narrow").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("narrow").select("raw_sha256", "format", "validation.result").collect()
    batch = process(raw_table(lines)).select("raw_sha256", "format", "validation.result").collect()
    assert sorted(got) == sorted(batch)


def test_stream_equals_batch(spark, raw_table, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.log").write_text("\n".join(LINES))
    stream = read_raw_stream(spark, str(source))
    for _ in range(2):  # the second run finds nothing new
        process_stream(stream, out, str(tmp_path / "chk")).awaitTermination()
    events = read_events(spark, out)
    assert not list((tmp_path / "out" / "landing").glob("part=*"))
    batch = process(raw_table([x for x in LINES if x], batch="stream-0"))
    columns = ["pos", "event_id", "raw_sha256", "integrity.canonical_sha256", "validation.result"]
    assert sorted(events.select(columns).collect()) == sorted(batch.select(columns).collect())
    assert spark.read.parquet(f"{out}/quarantine").count() == 1
    expected = merkle_root(leaves(raw_table([x for x in LINES if x]))).first().root
    assert spark.read.parquet(f"{out}/roots").first().root == expected


def test_counts_need_a_place(spark, tmp_path):
    (tmp_path / "a.log").write_text("x")
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            read_raw(spark, str(tmp_path))


def test_tampering_is_found_in_stored_nodes(spark, raw_table, tmp_path):
    lines = [x for x in LINES if x]
    for name, last in (("a", lines[-1]), ("b", "changed")):
        write_tables(process(raw_table([*lines[:-1], last])), str(tmp_path / name), nodes=True)
    a, b = (spark.read.parquet(str(tmp_path / n / "nodes")) for n in "ab")
    assert "level" in a.columns and a.select("batch_id", "pos", "hash").count() == merkle_nodes(leaves(raw_table(lines))).count()
    assert [(r.batch_id, r.pos) for r in tamper_locate(a, b).collect()] == [("b", len(lines) - 1)]


def test_look_ups_read_only_files_that_may_hold_them(spark, raw_table, tmp_path):
    lines = [f"LOCK-{i}|DROP|TCP|10.0.{i % 256}.{i // 256}|80" for i in range(4_000)]
    write_tables(process(raw_table(lines).repartition(8)), str(tmp_path))
    files = [f for f in (tmp_path / "events").rglob("*.parquet")]
    assert len(files) == 8 and max(f.stat().st_size for f in files) < 600_000  # filters follow the rows of a file
    every = {r.pos: r for r in read_events(spark, str(tmp_path)).collect()}
    some = [every[p].event_id for p in (3, 77, 3_999)]

    def rows_read(df):
        found = df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        return found, plan.collectLeaves().head().metrics().get("numOutputRows").get().value()

    found, read = rows_read(find_events(spark, str(tmp_path), some))
    assert sorted(r.pos for r in found) == [3, 77, 3_999] and read < 2_500
    found, read = rows_read(find_events(spark, str(tmp_path), raw_hashes=[every[5].raw_sha256]))
    assert [r.pos for r in found] == [5] and read < 1_000 and found[0].provenance == every[5].provenance
    assert find_events(spark, str(tmp_path), some, [every[77].raw_sha256]).count() == 1
    found, read = rows_read(find_events(spark, str(tmp_path), ["nobody"]))
    assert found == [] and read == 0
    with pytest.raises(ValueError):
        find_events(spark, str(tmp_path))
