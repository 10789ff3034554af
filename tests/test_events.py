import json

import pytest
from pyspark.sql import functions as F

from evlog.operators import parse
from evlog.operators.integrity import canonical_json, valid_digest, verify_hashes
from evlog.operators.onboard import apply_templates, discover_templates, fingerprint, onboard, template_rows
from evlog.operators.provenance import event_summary, lineage_mismatch, provenance_summary
from evlog.operators.validate import ISSUE, check_ip, check_port
from evlog.plans.process import canonical_events, process, validated_events

from lines import BAD_OCTET, CEF, JSON, LEEF, ODD_PORTS, SYSLOG, UNKNOWN, WRAPPED_CEF, XML

LINES = {
    "cef": CEF,
    "leef": LEEF,
    "syslog": SYSLOG,
    "json": JSON,
    "xml": XML,
    "unknown": UNKNOWN,
    "odd_ports": ODD_PORTS,
    "bad_octet": BAD_OCTET,
    "wrapped_cef": WRAPPED_CEF,
    "json_bad_ip": '{"src_ip":"not-an-ip","action":"block"}',
    "json_next_key": '{"src_ip":"x","src":" 1.2.3.4 ","sport":80,"src_port":99999,"a":{"b": 1},"a":{"c":2}}',
    "json_bad_port": '{"src_ip":"1.2.3.4","src_port":99999,"action":"block"}',
    "json_sparse": '{"message":"hello world"}',
    "json_array": '[{"src_ip":"1.2.3.4"}]',
    "syslog_bad_port": "<134>May  1 10:31:07 fw host: src=1.2.3.4, spt=notaport SRCIP=5.6.7.8; user=a,",
    "syslog_5424": "<134>1 2024-05-01T12:00:00Z host app 1 - - x=1",
    "cef_escape": r"CEF:0|V|P|1|9|N|Low|msg=a\=b c src=1.1.1.1 src=bad src=2.2.2.2 k= dvc=h1",
    "cef_short": "CEF:0|V|P|1|9",
    "cef_newline": "CEF:0|V|P|1|9|N|3|act=drop note=one\ntwo cs1=z",
    "leef_space": "LEEF:1.0|V|P|1|E1|src=1.1.1.1 cat=web act=x",
    "leef_caret": "LEEF:2.0|V|P|1|E1|^src=1.1.1.1^dst=2.2.2.2^user name=q r",
    "leef_bar": "LEEF:2.0|V|P|1|E1|^|src=1.1.1.1^dst=2.2.2.2",
    "leef_short": "LEEF:2.0|V|P|1",
    "leef_blank": " " + LEEF,
    "leef_3": "LEEF:3.0|V|P|1|E1|src=1.1.1.1\tsev=HIGH",
    "xml_full": "<Event id='1'><timestamp>t1</timestamp><src>x</src><spt>99</spt><product>pr</product>"
    "<message> m &amp; n </message><hostname>h</hostname><empty> </empty><vendor>ve</vendor><a.b-c>q</a.b-c></Event>",
    "bare_word": "word",
    "gaps": "FW||BLK||TCP|1.2.3.4",
}


@pytest.fixture(scope="module")
def events(raw_table):
    rows = process(raw_table(list(LINES.values()))).collect()
    return {list(LINES)[r.pos]: r for r in rows}


def leaves(row):
    e = row.canonical_event.asDict(True)
    net = {k: v for k, v in e["network"].items() if v is not None}
    top = {k: e[k] for k in ("timestamp", "network_protocol", "action", "policy_id", "severity", "signature_id",
                             "user", "host", "message") if e[k] is not None}
    src = {k: v for k, v in e["source"].items() if v is not None and k != "format"}
    return {**net, **top, **src}, e["fields"]["extra"]


EXPECTED = {
    "cef": ({"source_ip": "198.18.0.14", "source_port": 40022, "destination_ip": "198.18.7.3",
             "destination_port": 3389, "network_protocol": "UDP", "action": "deny", "policy_id": "R-88",
             "severity": "4", "signature_id": "771", "message": "Login refused thrice", "vendor": "Larkfield",
             "product": "Weir"}, {"cs1Label": "RuleName"}),
    "leef": ({"source_ip": "198.18.0.14", "destination_ip": "198.18.7.3", "network_protocol": "GRE",
              "user": "m.reed", "severity": "8", "signature_id": "EV-31", "message": "EV-31", "vendor": "Quayside",
              "product": "Breakwater"}, None),
    "json_bad_ip": ({"action": "block"}, None),
    "json_next_key": ({"source_ip": "1.2.3.4", "source_port": 80}, {"a": '{"c":2}'}),
    "json_bad_port": ({"source_ip": "1.2.3.4", "action": "block"}, None),
    "json_array": ({}, None),
    "syslog_bad_port": ({"timestamp": "May  1 10:31:07", "host": "fw", "product": "host", "severity": "informational",
                         "source_ip": "5.6.7.8", "user": "a,",
                         "message": "src=1.2.3.4, spt=notaport SRCIP=5.6.7.8; user=a,"}, None),
    "syslog_5424": ({}, None),
    "cef_escape": ({"signature_id": "9", "severity": "low", "message": "N", "vendor": "V", "product": "P",
                    "source_ip": "2.2.2.2", "host": "h1"}, {"msg": "a=b c"}),
    "cef_short": ({}, None),
    "cef_newline": ({"signature_id": "9", "severity": "3", "message": "N", "vendor": "V", "product": "P",
                     "action": "drop", "policy_id": "z"}, None),
    "leef_space": ({"source_ip": "1.1.1.1", "signature_id": "E1", "message": "E1", "vendor": "V", "product": "P"},
                   {"act": "x", "cat": "web"}),
    "leef_caret": ({"source_ip": "1.1.1.1", "destination_ip": "2.2.2.2", "signature_id": "E1", "message": "E1",
                    "vendor": "V", "product": "P"}, {"user name": "q r"}),
    "leef_bar": ({"destination_ip": "2.2.2.2", "signature_id": "E1", "message": "E1", "vendor": "V", "product": "P"},
                 {"|src": "1.1.1.1"}),
    "leef_short": ({}, None),
    "leef_blank": ({}, None),
    "leef_3": ({"source_ip": "1.1.1.1", "severity": "high", "signature_id": "E1", "message": "E1", "vendor": "V",
                "product": "P"}, None),
    "xml_full": ({"timestamp": "t1", "source_port": 99, "product": "pr", "message": "m &amp; n", "host": "h",
                  "vendor": "ve"}, {"a.b-c": "q", "src": "x"}),
    "bare_word": ({"vendor": "word", "product": "word"}, None),
    "gaps": ({"vendor": "FW", "product": "FW", "action": "BLK", "network_protocol": "TCP", "source_ip": "1.2.3.4"}, None),
    "odd_ports": ({"vendor": "GATE-5", "product": "GATE-5", "network_protocol": "TCP", "source_ip": "172.16.8.1",
                   "destination_ip": "172.16.8.2", "action": "PASS", "policy_id": "P9"}, None),
}


@pytest.mark.parametrize("name", EXPECTED)
def test_leaves(events, name):
    assert leaves(events[name]) == EXPECTED[name]


def test_failures_are_data(events):
    failed = {n: r.parse[0].detail for n, r in events.items() if r.parse[0].status == "failed"}
    assert failed == {
        "syslog_5424": "Syslog pattern not parseable",
        "cef_short": "CEF header not parseable",
        "leef_short": "LEEF header incomplete",
        "leef_blank": "LEEF header not parseable",
    }
    assert not any(events[n].understood for n in failed)


def test_verdicts(events):
    got = {n: events[n].validation.result for n in ("cef", "unknown", "odd_ports", "bad_octet", "json_sparse", "json_array")}
    assert got == {"cef": "PASS", "unknown": "PASS", "odd_ports": "WARNING", "bad_octet": "FAIL",
                   "json_sparse": "WARNING", "json_array": "FAIL"}
    assert all(r.validation.checks_run == 9 for r in events.values())


def test_unknown_records(events):
    by_field = {p.canonical_field: p for p in events["unknown"].provenance}
    assert by_field["network.source_ip"].source_field == "token[3]"
    assert by_field["network.source_ip"].method == "heuristic"
    assert [s.stage for s in events["unknown"].onboarding.stages] == ["FINGERPRINT", "STRUCTURE DISCOVERY"]
    assert events["cef"].onboarding is None


def test_first_confidence_last_value(raw_table):
    row = canonical_events(raw_table([LINES["cef_escape"]])).first()
    sources = [p.value for p in row.provenance if p.canonical_field == "network.source_ip"]
    assert sources == ["1.1.1.1", "2.2.2.2"] and row.canonical.network.source_ip == "2.2.2.2"
    assert row.canonical.confidence["network.source_ip"] == 1.0
    wrong = lineage_mismatch(canonical_events(raw_table([LINES["cef_escape"], CEF]))).collect()
    assert [(r.pos, r.value, r.canonical_value) for r in wrong] == [(0, "1.1.1.1", "2.2.2.2")]


def test_summary(raw_table):
    row = canonical_events(raw_table([SYSLOG])).select(event_summary(F.col("provenance")).alias("s")).first().s
    assert (row["count"], row.methods, row.mean_confidence) == (10, {"derived": 1, "extracted": 9}, 0.985)


def test_canonical_text_is_stable(raw_table, spark):
    lines = list(LINES.values())
    one = validated_events(raw_table(lines).repartition(1)).select("pos", canonical_json(F.col("canonical")).alias("j"))
    many = validated_events(raw_table(lines).repartition(7)).select("pos", canonical_json(F.col("canonical")).alias("j"))
    a, b = ({r.pos: r.j for r in d.collect()} for d in (one, many))
    assert a == b
    for text in a.values():
        doc = json.loads(text)
        assert list(doc) == sorted(doc) and len(doc) == 16
        assert json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == text


def test_checks_on_hand_made_rows(spark):
    rows = spark.createDataFrame([("1.2.3", 70000), ("1.2.3.256", -1), (None, None), ("1.2.3.4", 0)], "ip string, port int")
    got = rows.select(
        check_ip("f", F.col("ip")).cast(ISSUE).alias("i"), check_port("f", F.col("port")).cast(ISSUE).alias("p")
    ).collect()
    assert [(r.i.check, r.i.severity, r.p.check, r.p.severity) for r in got] == [
        ("ip_format", "FAIL", "port_range", "FAIL"),
        ("ip_octets", "FAIL", "port_range", "FAIL"),
        ("ip_present", "WARNING", "port_present", "WARNING"),
        ("ip_format", "PASS", "port_range", "PASS"),
    ]
    assert got[0].i.message == "malformed IPv4: '1.2.3'"


def test_fingerprint_and_onboard(raw_table):
    row = fingerprint(raw_table(["FW1| ab |x1|cd|1.2.3.4||éa"])).first()
    assert (row.delimiter, row.token_count, row.ipv4_count, row.has_port_range) == ("|", 6, 1, True)
    assert (row.alpha_tokens, row.alphanumeric_tokens) == (["cd", "éa"], ["FW1", "x1"])
    assert onboard(raw_table(["  "])).first().onboarding.understood is False


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_templates(spark, raw_table, limit):
    lines = ["A||10.0.0.1|80|drop", "B||10.0.0.2|81|PASS", UNKNOWN, "plain words"]
    table = raw_table(lines)
    found = {r.signature: r for r in discover_templates(table).collect()}
    assert found["|/5/identifier,empty,ipv4,port,action"].events == 2
    registry = template_rows(discover_templates(table.filter("pos < 2")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        rows = {r.pos: r for r in apply_templates(table, registry).collect()}
        events = {r.pos: r for r in canonical_events(raw_table([*lines, CEF, "A||10.0.0.1|80|drop|"]), registry).collect()}
        plain = {r.pos: r for r in canonical_events(raw_table([*lines, CEF])).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = {p.canonical_field: (p.source_field, p.value) for p in rows[0].provenance}
    assert got == {"source.vendor": ("token[0]", "A"), "source.product": ("token[0]", "A"), "network.source_ip": ("token[2]", "10.0.0.1"),
                   "network.source_port": ("token[3]", "80"), "action": ("token[4]", "DROP")}
    assert rows[0].registered and not rows[2].registered and len(rows[2].provenance) == 9 and rows[3].provenance == []
    assert events[0].canonical.network.source_port == 80 and events[0].canonical.action == "DROP"
    assert plain[0].canonical.network.source_port is None
    assert events[2].canonical.asDict(True) == plain[2].canonical.asDict(True) and events[4].canonical.asDict(True) == plain[4].canonical.asDict(True)


@pytest.mark.parametrize("how, want", [("verbatim", "dRop"), ("canonical", "drop"), ("positional", "DROP")])
def test_registered_spelling(spark, raw_table, how, want):
    table = raw_table(["A|dRop"])
    registry = spark.createDataFrame([("|/2/identifier,action", 1, "action", how, 0.7)], "signature string, position int, canonical_field string, normaliser string, confidence double")
    assert [(p.value, p.confidence) for p in apply_templates(table, registry).first().provenance] == [(want, 0.7)]


LONG = 1_000_000
LONG_LINES = {
    "word": "a" * LONG,
    "hex": "f0" * (LONG // 2) + "|DROP|tcp",
    "cells": "|".join(["ab1"] * 50_000),
    "port": '{"src_port":"' + "9_" * (LONG // 2) + '9","src_ip":"1.2.3.4"}',
    "zeros": '{"src_port":"' + "0" * 4000 + '7"}',
    "json_key": '{"' + "k" * LONG + '":"v"}',
    "json_value": '{"message":"' + "v" * LONG + '"}',
    "cef_value": "CEF:0|V|P|1|9|N|3|msg=" + "x" * LONG + " src=1.1.1.1",
    "cef_key": "CEF:0|V|P|1|9|N|3|" + "k" * LONG + "=1 src=1.1.1.1",
    "leef_value": "LEEF:1.0|V|P|1|E1|usrName=" + "u" * LONG + "\tsrc=1.1.1.1",
    "syslog_value": "<134>May  1 10:31:07 h p: user=" + "u" * LONG + " src=1.1.1.1",
    "syslog_key": "<134>May  1 10:31:07 h p: " + "k" * LONG + "=u src=1.1.1.1",
    "xml_tag": f"<a><{'t' * LONG}>x</{'t' * LONG}><src>1.1.1.1</src></a>",
    "xml_value": "<a><src>1.1.1.1</src><note>" + "n" * LONG + "</note></a>",
    "xml_opens": "<a><src>1.1.1.1</src>" + "<a " * (LONG // 3) + "</a>",
    "xml_tags": "<a><src>1.1.1.1</src>" + "<b>" * (LONG // 3) + "</a>",
    "xml_less": "<a><src>1.1.1.1</src>" + "<" * LONG + "</a>",
    "xml_closes": "<a><src>1.1.1.1</src>" + "</a" * (LONG // 3) + "</a>",
    "xml_greater": "<a><src>1.1.1.1</src>" + ">" * LONG + "</a>",
    "one_tag": "<a " * (LONG // 3) + "</a>",
    "cef_blanks": "CEF:0|V|P|1|9|N|3|msg=x" + " " * LONG + "src=1.1.1.1",
    "cef_words": "CEF:0|V|P|1|9|N|3|msg=" + "w " * (LONG // 2) + "src=1.1.1.1",
}
#: Seconds that each long line may take, beyond the time of a short one.
SECONDS = 5


def test_long_texts_in_all_formats(raw_table):
    """Texts of a million characters, wherever a format has room for one, are ordinary rows."""
    rows = {list(LONG_LINES)[r.pos]: r for r in process(raw_table(list(LONG_LINES.values()))).collect()}
    assert set(rows) == set(LONG_LINES)
    assert len(rows["word"].canonical_event.source.vendor) == LONG and rows["hex"].canonical_event.action == "DROP"
    assert rows["port"].canonical_event.network.source_port is None and rows["port"].canonical_event.network.source_ip == "1.2.3.4"
    assert rows["zeros"].canonical_event.network.source_port == 7
    assert all(rows[n].canonical_event.network.source_ip == "1.1.1.1" for n in LONG_LINES if n.startswith(("cef", "leef", "syslog", "xml")))


def test_time_grows_with_the_line(raw_table):
    """No layout searches a line again from each of its places: that would take minutes for any of these."""
    import time

    odd = [n for n in LONG_LINES if n.startswith(("xml_", "one_", "cef_"))]
    start = time.time()
    rows = process(raw_table([LONG_LINES[n] for n in odd])).select("pos", "format", "integrity.canonical_sha256").collect()
    assert len(rows) == len(odd) and time.time() - start < SECONDS * len(odd)


def test_leaves_between_stray_marks(raw_table):
    """Lines in which several ``<`` come before one ``>`` have the same leaves as a search by pattern finds."""
    import random
    import re

    rng = random.Random(4)
    name = r"[A-Za-z_][A-Za-z0-9_.\-]*"
    pieces = ["<", ">", "</", "<a", "<a>", "</a>", "<ab", "<ab ", "</ab>", " ", "x", "a", "<a x='1'>", "<src>1.1.1.1</src>", "/", "<!"]
    lines = ["<a>" + "".join(rng.choice(pieces) for _ in range(rng.randrange(4, 30))) + "<b></b></a>" for _ in range(600)]
    df = raw_table(lines).select("pos", "raw", parse._xml_parts(F.col("raw")).alias("parts"))
    for r in df.collect():
        want = [(m[1], m[2]) for m in re.finditer(rf"<({name})(?:\s[^>]*)?>([^<]*)</\1>", r.raw)]
        assert [(re.match(rf"<({name})", p)[1], p[p.index(">") + 1 : p.rindex("</")]) for p in r.parts] == want


def test_summary_counts_every_method(spark, raw_table):
    table = raw_table(["A||10.0.0.1|80|drop", "odd one"])
    rows = apply_templates(table, template_rows(discover_templates(table.filter("pos = 0"))))
    got = provenance_summary(rows).first()
    assert (got.events, got.records, got.other, got.methods) == (2, 5, 5, {"template": 5})
    assert got.extracted + got.heuristic + got.derived + got.other == got.records
    none = rows.withColumn("provenance", F.expr("transform(provenance, r -> named_struct('canonical_field', r.canonical_field, 'source_field', r.source_field, 'value', r.value, 'method', cast(null as string), 'confidence', r.confidence))"))
    assert provenance_summary(none).first().methods == {"unknown": 5}
    empty = provenance_summary(table.withColumn("provenance", F.array().cast(rows.schema["provenance"].dataType))).first()
    assert (empty.events, empty.records, empty.mean_confidence, empty.methods) == (2, 0, None, {})


def test_manifest_and_digests(spark, raw_table):
    from evlog.operators.ingest import seal

    sealed = seal(raw_table(["a", "b", "c"]))
    manifest = spark.createDataFrame(
        [("b", 0, "\t CA978112CA1BBDCAFAC231B39A23DC4DA786EFF8147C4E72B9807785AFEE48BB\u00a0\r"), ("b", 1, "0" * 64), ("b", 9, "x")],
        "batch_id string, pos bigint, expected_sha256 string",
    )
    assert {r.pos: r.status for r in verify_hashes(sealed, manifest).collect()} == {
        0: "match", 1: "mismatch", 2: "unexpected", 9: "missing"}
    ok, bad = valid_digest(manifest, "expected_sha256")
    assert [r.pos for r in ok.collect()] == [1] and bad.count() == 2
