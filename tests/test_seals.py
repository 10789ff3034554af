"""Streams whose batches follow the source."""

import hashlib
import os

import pytest

from evlog.streaming import jobs


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def root_of(lines):
    row = [h(h(x)) for x in lines]
    while len(row) > 1:
        row = [h(row[i] + (row[i + 1] if i + 1 < len(row) else row[i])) for i in range(0, len(row), 2)]
    return row[0] if row else h("")


def write(folder, source, name, lines, at):
    path = folder / source
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text("\n".join(lines) + "\n")
    os.utime(path / name, (at, at))


def lines_of(source, part, n):
    return [f"LOCK-{source}|DROP|TCP|10.0.{part}.{i}" for i in range(n)]


PARTS = [("a", "1.log", 5), ("b", "1.log", 3), ("a", "2.log", 1), ("c", "1.log", 8), ("a", "3.log", 6), ("b", "2.log", 4)]
START = 1_700_000_000


def run(spark, folder, out, files, **options):
    stream = jobs.read_raw_stream(spark, f"{folder}/*", files)
    query = jobs.seal_stream(stream, f"{out}/tables", f"{out}/checkpoint", **options)
    query.awaitTermination()
    return {r.batch_id.rsplit("/", 1)[1]: r for r in jobs.read_seals(spark, f"{out}/tables").collect()}


@pytest.mark.parametrize("files", [1000, 3, 1])
def test_roots_do_not_depend_on_triggers(spark, tmp_path, files):
    whole = {}
    for k, (source, name, n) in enumerate(PARTS):
        lines = lines_of(source, name[0], n)
        write(tmp_path / "in", source, name, [*lines, "   "], START + k)
        whole.setdefault(source, []).extend(lines)
    seals = run(spark, tmp_path / "in", tmp_path, files)
    assert {s: (r.leaf_count, r.root, r.sealed) for s, r in seals.items()} == {s: (len(x), root_of(x), False) for s, x in whole.items()}
    events = spark.read.parquet(f"{tmp_path}/tables/events")
    assert events.count() == 27 and events.select("batch_id", "pos").distinct().count() == 27
    assert spark.read.parquet(f"{tmp_path}/tables/quarantine").count() == len(PARTS)
    assert not os.listdir(f"{tmp_path}/tables/landing") and len(os.listdir(f"{tmp_path}/tables/seals")) <= 2


def test_restart_idle_sources_and_late_lines(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "a", "1.log", lines_of("a", 1, 5), START)
    write(folder, "b", "1.log", lines_of("b", 1, 3), START + 10)
    first = run(spark, folder, tmp_path, 1000)
    assert first["a"].root == root_of(lines_of("a", 1, 5))
    write(folder, "b", "2.log", lines_of("b", 2, 9), START + 5_000)  # the stream starts again from its checkpoint
    second = run(spark, folder, tmp_path, 1)
    assert second["b"].root == root_of(lines_of("b", 1, 3) + lines_of("b", 2, 9)) and not second["b"].sealed
    assert second["a"].sealed and second["a"].root == first["a"].root
    write(folder, "a", "2.log", lines_of("a", 2, 2), START + 5_001)
    write(folder, "c", "1.log", lines_of("c", 1, 1), START + 5_002)
    third = run(spark, folder, tmp_path, 1000)
    assert third["a"].root == first["a"].root and third["a"].leaf_count == 5 and third["c"].root == root_of(lines_of("c", 1, 1))
    assert [r.raw for r in spark.read.parquet(f"{tmp_path}/tables/late").orderBy("raw").collect()] == lines_of("a", 2, 2)


def test_a_repeated_micro_batch_leaves_the_same(spark, tmp_path):
    for k, (source, name, n) in enumerate(PARTS):
        write(tmp_path / "in", source, name, lines_of(source, name[0], n), START + k)
    before = run(spark, tmp_path / "in", tmp_path, 2)
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()  # as if the driver was lost after the tables were written
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    after = run(spark, tmp_path / "in", tmp_path, 2)
    assert {s: (r.leaf_count, r.root) for s, r in after.items()} == {s: (r.leaf_count, r.root) for s, r in before.items()}
    assert spark.read.parquet(f"{tmp_path}/tables/events").count() == 27
