import json

import pytest
from pyspark.sql import functions as F

from evlog.functions.strict_json import json_kind, json_object
from evlog.functions.text import strip
from evlog.functions.values import norm_ip, norm_port
from evlog.operators.detect import detect
from evlog.operators.ingest import seal, split_blank
from evlog.operators.parse import classify

from lines import CEF, JSON, LEEF, SYSLOG, UNKNOWN, WRAPPED_CEF, XML

RULES = [
    ("   ", "UNKNOWN", 0.0),
    (JSON, "JSON", 0.98),
    (' [1, {"a": 2}] ', "JSON", 0.98),
    ('{"a": 1} trailing', "UNKNOWN", 0.0),
    (CEF, "CEF", 0.98),
    (LEEF, "LEEF", 0.98),
    ("LEEF:3.0 a|b", "LEEF", 0.98),
    ("LEEF:3.0|v|p|1|7|src=1.2.3.4", "LEEF", 0.85),
    (XML, "XML", 0.95),
    ("<a><b/>", "UNKNOWN", 0.0),
    ("<?xml version='1.0'?><a><b>1</b></a>", "UNKNOWN", 0.0),
    (WRAPPED_CEF, "CEF", 0.85),
    ("XCEF:0|a", "UNKNOWN", 0.0),
    ("x LEEF:1.0|v|p|1|7|", "LEEF", 0.85),
    ("<134>1 2024-05-01T12:00:00.000Z host app proc - - msg", "SYSLOG", 0.92),
    ("2024-05-01T12:00:00+02:00 host app", "SYSLOG", 0.92),
    (SYSLOG, "SYSLOG", 0.90),
    ("2024-05-01 12:00:00,123 host proc[12]: msg", "SYSLOG", 0.90),
    ("CEF:x|a", "CEF", 0.4),
    ("Jan  1 00:00:00 host only", "SYSLOG", 0.55),
    ("Foo  1 00:00:00 host only", "UNKNOWN", 0.0),
    (UNKNOWN, "UNKNOWN", 0.0),
    (" \x1c" + CEF + "\x85", "CEF", 0.98),
]

STRICT = [
    '{"a":1}', '{"a":1} junk', '{"a":1}]', '{"a":1}}', '{"a":1}][{"b":2}', '{"a":1},{"b":2}', '{"a":1},', "[1,2]",
    "[1,2", '{"a":NaN}', '{"a":-Infinity}', "{'a':1}", '{"a":"x\ty"}', '{"a":tru}', '{"a":tru,"b":1}', '{"a":1,"a":2}',
    '{"a":{"b":1,"b":2}}', '{"a":01}', '{"a":1.}', '{"a":1,}', "{a:1}", '{"a":/*c*/1}', '{"a":"\\x"}', "[]", "{}",
    '{"":1}', '{"a":1}"', "[[[1]]]", '{"a":[}', '{"a" 1}', "[1 2]", '{"a":1}\x00', '[1],"x"]', '{"a":{"b":tru}}',
    '{"a":[1,tru,2],"b":3}', '{"a":"b"', '{"a":1}},{"x":""}] [', '[1],"x"] [',
]


def test_rules(raw_table):
    got = detect(seal(raw_table([r[0] for r in RULES]))).orderBy("pos").collect()
    assert [(r.format, r.confidence) for r in got] == [r[1:] for r in RULES]
    again = classify(seal(raw_table([r[0] for r in RULES]))).orderBy("pos").collect()
    assert [(r.format, r.detection.confidence) for r in again] == [r[1:] for r in RULES]


def test_json_is_strict(spark):
    def accepted(text):
        try:
            return isinstance(json.loads(text), (dict, list))
        except ValueError:
            return False

    df = spark.createDataFrame(list(enumerate(STRICT)), "i int, t string")
    seal_col = F.sha2("t", 256)
    rows = df.select(
        "i", json_kind(F.col("t"), seal_col).alias("kind"), json_object(F.col("t"), seal_col).alias("doc")
    ).orderBy("i").collect()
    assert [r.kind is not None for r in rows] == [accepted(t) for t in STRICT]
    assert [r.doc is not None for r in rows] == [accepted(t) and t.startswith("{") for t in STRICT]


def test_strip_covers_unicode_blanks(spark):
    blanks = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())
    row = spark.createDataFrame([(blanks + "a b" + blanks,)], "t string").select(strip(F.col("t")).alias("s")).first()
    assert row.s == "a b"


@pytest.mark.parametrize(
    "text,port,ip",
    [
        ("443", "443", None), (" +443 ", "443", None), ("4_4", "44", None), ("443.0", None, None), ("65536", None, None),
        ("-1", None, None), ("", None, None), (" 1.2.3.4 ", None, "1.2.3.4"), ("999.1.1.1", None, "999.1.1.1"),
        ("1.2.3", None, None), ("00080", "80", None), ("99999999999999999999", None, None),
    ],
)
def test_normalisers(spark, text, port, ip):
    row = spark.createDataFrame([(text,)], "t string").select(
        norm_port(F.col("t")).alias("p"), norm_ip(F.col("t")).alias("i")
    ).first()
    assert (row.p, row.i) == (port, ip)


def test_seal_and_blank(raw_table):
    sealed = seal(raw_table(["abc\n\n", "abc", ""])).orderBy("pos").collect()
    assert sealed[0].raw == "abc" and sealed[0].raw_sha256 == sealed[1].raw_sha256
    assert sealed[1].raw_sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert sealed[2].raw_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    kept, blank = split_blank(raw_table(["x", " \t ", None]))
    assert [r.raw for r in kept.collect()] == ["x"] and blank.count() == 2
