"""Events of several lines, read at any split size."""

import json
import random

import pytest

from evlog.plans.process import canonical_events
from evlog.sources.raw import read_raw


def pretty(rng, n):
    rows = [{"src_ip": f"10.0.{i % 256}.{i // 256}", "action": "drop", "nested": {"list": [{"a": i}, "{ \" }"], "text": "x" * rng.randrange(80)}} for i in range(n)]
    return [json.dumps(r, indent=rng.choice([1, 2, 4])) for r in rows]


@pytest.mark.parametrize("split", ["64", "300", "4k", "128m"])
def test_pretty_json_at_any_split_size(spark, tmp_path, split):
    records = pretty(random.Random(1), 60)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(records[:45]) + "\n")
    (tmp_path / "in" / "b.json").write_text("\r\n".join(records[45:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = read_raw(spark, str(tmp_path / "in"), "record", str(tmp_path / "counts"))
        rows = sorted((r.batch_id, r.pos, r.raw) for r in df.collect())
        done = canonical_events(df).filter("format = 'JSON' and canonical.network.source_ip is not null").count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(b[-6:], p) for b, p, _ in rows] == [("a.json", i) for i in range(45)] + [("b.json", i) for i in range(15)]
    assert [r.replace("\r\n", "\n") for _, _, r in rows] == records and done == 60


def test_elements_traces_and_lines_before_the_first_record(spark, tmp_path):
    path = tmp_path / "log.xml"
    path.write_text("<?xml version='1.0'?>\n<Event>\n  <src>1.1.1.1</src>\n</Event>\n<Event id='2'>\n  <src>2.2.2.2</src>\n</Event>\n\n")
    rows = {r.pos: r.raw for r in read_raw(spark, str(path), "record", str(tmp_path / "c1"), "<Event").collect()}
    assert rows == {0: "<?xml version='1.0'?>", 1: "<Event>\n  <src>1.1.1.1</src>\n</Event>", 2: "<Event id='2'>\n  <src>2.2.2.2</src>\n</Event>"}
    path.write_text("\n2024 first\n  at a\n  at b\n2024 second\n")
    rows = {r.pos: r.raw for r in read_raw(spark, str(path), "record", str(tmp_path / "c2"), "20").collect()}
    assert rows == {0: "", 1: "2024 first\n  at a\n  at b", 2: "2024 second"}


def test_no_start_and_no_text(spark, tmp_path):
    (tmp_path / "empty").write_text("")
    assert read_raw(spark, str(tmp_path / "empty"), "record", str(tmp_path / "c")).collect() == []
    for unit, start in (("record", ""), ("word", "{")):
        with pytest.raises(ValueError):
            read_raw(spark, str(tmp_path / "empty"), unit, str(tmp_path / "d"), start)
