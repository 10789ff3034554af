"""Exact duplicates by a heavy-hitter split."""

import hashlib
import random
import re

from evlog.llm import exact

DOCS = "doc_id long, text string, _digest string, _size int"


def brute_force(rows):
    groups = {}
    for at, (doc_id, text, *_) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, at))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            none = lambda x: None if x[1] else x[2]
            out.append((none(m), none(best), len(members), m is best, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, counters):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(5)
    result = exact.exact_duplicates(df, counters=counters)
    assert result.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((tuple(r) for r in result.collect()), key=str)


def test_equal_to_brute_force_at_any_number_of_counters(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot text", "hot  text", "hot\ttext\n", "h ot text"])) for i in range(0, 400)]
    rows += [(i, " " * rng.randrange(3) + rng.choice("abcdefgh") * rng.randrange(1, 6)) for i in range(400, 900)]
    rows += [(i, f"only {i}") for i in range(900, 1100)] + [(1100, None), (1101, ""), (1102, " \t\r\n\x0b\x0c"), (1103, " "), (1104, "  ")]
    rng.shuffle(rows)
    want = brute_force(rows)
    for counters in (2, 20, 2_000):
        assert found(spark, rows, counters) == want


def test_ties_repeats_nulls_and_long_texts(spark):
    long = "word " * 300_000
    rows = [(7, "a b"), (7, "a b"), (None, "a b"), (None, "ab c"), (3, "abc"), (2, "a b"), (9, long), (8, long + "\n"), (1, "😀 x"), (0, "😀x ")]
    assert found(spark, rows, 4) == brute_force(rows)
    kept = [r for r in found(spark, rows, 4) if r[3]]
    assert len(kept) == len({r[4] for r in kept})


def test_text_ids_and_empty_table(spark):
    df = spark.createDataFrame([("b", "x y"), ("a", "xy "), ("c", "z")], "key string, body string")
    got = {tuple(r)[:4] for r in exact.exact_duplicates(df, "key", "body").collect()}
    assert got == {("b", "a", 2, False), ("a", "a", 2, True), ("c", "c", 1, True)}
    assert exact.exact_duplicates(df.filter("false"), "key", "body").collect() == []


def test_frequent_digests_are_few_and_none_is_missed(spark):
    rows = [(i, "every third") if i % 3 == 0 else (i, f"other {i % 700}") for i in range(6_000)]
    stored = exact.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), "doc_id", "text")
    sizes = {r["_size"] for r in exact.frequent(stored, len(rows), 50).collect()}
    assert sizes == {2_000}
    assert exact.frequent(stored, len(rows), 3_000).count() == 701


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = exact.exact_duplicates(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
