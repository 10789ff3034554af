"""Key registries, input predicates, mergeable layouts and plans without sorts of lines."""

import pytest
from pyspark.sql import functions as F

from evlog.operators import keys as K
from evlog.operators import onboard as U
from evlog.operators import parse as P
from evlog.operators.ingest import seal
from evlog.plans.process import canonical_events, process

REGISTRY = "format string, key string, canonical_field string"
CEF = "CEF:0|V|P|1|9|N|3|src=1.1.1.1 branch=north cs1=7 Policy=x"
LEEF = "LEEF:1.0|V|P|1|E1|usrName=ann\tzone=dmz"
SYSLOG = "<134>May  1 10:31:07 h p: USERID=bob src=1.1.1.1"
XML = "<a><who>eve</who><src>1.1.1.1</src></a>"
JSON = '{"client":"1.1.1.1","src_ip":"2.2.2.2","who":"dan","user":""}'
LINES = [CEF, LEEF, SYSLOG, XML, JSON]


def leaves(raw_table, rows, limit=K.KEY_BYTES, lines=LINES):
    df = raw_table(lines)
    keys = df.sparkSession.createDataFrame(rows, REGISTRY)
    found = K.key_rows(keys, P.seen_keys(P.classify(seal(df))), limit)
    done = P.parse(P.classify(seal(df)), keys=found)
    return {r.pos: {p.canonical_field: p.value for p in r.provenance} | {"extra": r.extra} for r in done.collect()}


@pytest.mark.parametrize("limit", [K.KEY_BYTES, 400])
def test_registered_keys_in_all_formats(raw_table, limit):
    rows = [("CEF", "branch", "host"), ("CEF", "cs1", "signature_id"), ("LEEF", "zone", "host"), ("SYSLOG", "UserId", "user"), ("XML", "who", "user")]
    rows += [("JSON", "client", "network.source_ip"), ("JSON", "who", "user")]
    rows += [("CEF", f"never{i}", "user") for i in range(0 if limit == K.KEY_BYTES else 200)]
    found = leaves(raw_table, rows, limit)
    assert found[0]["host"] == "north" and found[0]["signature_id"] == "7" and "policy_id" not in found[0] and found[0]["extra"] == {"Policy": "x"}
    assert found[1]["host"] == "dmz" and found[1]["user"] == "ann" and not found[1]["extra"]
    assert found[2]["user"] == "bob"
    assert found[3]["user"] == "eve" and not found[3]["extra"]
    assert found[4]["network.source_ip"] == "2.2.2.2" and found[4]["user"] == "dan" and not found[4]["extra"]


def test_a_json_key_moves_to_its_registered_field(raw_table):
    found = leaves(raw_table, [("JSON", "src_ip", "network.destination_ip"), ("JSON", "client", "network.source_ip")])
    assert found[4]["network.destination_ip"] == "2.2.2.2" and found[4]["network.source_ip"] == "1.1.1.1"


@pytest.mark.parametrize("row", [("CEF", "a", "nowhere"), ("YAML", "a", "user"), ("CEF", None, "user"), ("CEF", "", "user"), (None, "a", "user"), ("CEF", "a", None)])
def test_refused_rows(raw_table, row):
    with pytest.raises(ValueError, match="no such"):
        leaves(raw_table, [row])


def test_a_key_with_two_fields_and_a_registry_over_the_limit(spark, raw_table):
    with pytest.raises(ValueError, match="two fields"):
        leaves(raw_table, [("SYSLOG", "A", "user"), ("SYSLOG", "a", "host"), ("SYSLOG", "a", "host")])
    rows = spark.createDataFrame([("CEF", f"k{i}", "user") for i in range(50)], REGISTRY)
    with pytest.raises(ValueError, match="not given"):
        K.key_rows(rows, None, 100)
    with pytest.raises(ValueError, match="raise the limit"):
        K.key_rows(rows, rows, 100)
    assert K.key_rows(rows.filter("false")) == ()


def test_built_in_tables_stay_without_a_registry():
    from evlog import fixed as X

    tables = K.key_tables()
    assert tables[X.CEF] == X.CEF_KEYS and list(tables[X.JSON]) == [k for keys in X.JSON_KEYS.values() for k in keys]


def test_lines_are_not_shuffled_by_keys(raw_table):
    df = raw_table(LINES)
    keys = df.sparkSession.createDataFrame([("CEF", "branch", "host")], REGISTRY)
    assert "Exchange" not in process(df, keys=keys)._jdf.queryExecution().executedPlan().toString()


def test_input_predicates_reach_the_scan(spark, raw_table, tmp_path):
    path = str(tmp_path / "lines")
    raw_table(LINES).write.parquet(path)
    df = spark.read.parquet(path)
    plan = process(df, where=F.col("batch_id") == "b")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(batch_id,b)" in plan
    assert [r.pos for r in canonical_events(df, where="pos = 2").collect()] == [2]


def test_merged_layouts_count_names_of_all_parts(raw_table):
    lines = [f"host{i % 300}|ALLOW|TCP|10.0.0.{i % 200}" for i in range(900)] + [f"free text {i}" for i in range(500)] + ["", "a|b"]
    df = raw_table(lines).withColumn("day", F.col("pos") % 7).withColumn("site", F.col("pos") % 2)
    exact = {r.signature: (r.events, r.sample, r.leading_values) for r in U.discover_templates(df).collect()}
    assert max(n for _, _, n in exact.values()) == 500
    for by in (["day"], ["site"], ["day", "site"], []):
        merged = {r.signature: r for r in U.merge_layouts(U.layout_parts(df, *by)).collect()}
        assert merged.keys() == exact.keys()
        for s, (events, sample, n) in exact.items():
            assert (merged[s].events, merged[s].sample) == (events, sample) and abs(merged[s].leading_estimate - n) <= n // 20
    days = U.merge_layouts(U.layout_parts(df, "day", "site"), "site")
    assert days.groupBy("signature").count().filter("count > 2").count() == 0


def test_lines_are_not_sorted_for_their_samples(raw_table):
    df = raw_table(LINES + ["a|b", "c d"])
    failures = P.parse_failures(P.parse(P.classify(seal(df)))).drop("distinct_lines")
    for found in (failures, U.discover_templates(df).drop("leading_values")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "ObjectHashAggregate" in plan


def test_failures_tell_repeated_lines_from_many(raw_table):
    lines = ["LEEF:3.0 Halyard 1 x=1"] * 40 + [f"CEF:draft|a|{i}" for i in range(40)]
    found = {r.format: r for r in P.parse_failures(P.parse(P.classify(seal(raw_table(lines))))).collect()}
    assert (found["LEEF"].events, found["LEEF"].distinct_lines) == (40, 1)
    assert found["CEF"].events == 40 and 38 <= found["CEF"].distinct_lines <= 42 and found["CEF"].sample == "CEF:draft|a|0"
