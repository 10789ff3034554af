"""Mined layouts of free text."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evlog import fixed as X
from evlog.operators import mine

WILD, TAIL = "<*>", "<*>..."


def cut(raw, depth):
    tokens = [t for t in re.split(f"[{X.BLANKS}]+", raw or "") if t]
    return tokens[:depth] + [TAIL] if len(tokens) > depth else tokens


def brute_force(lines, share, least, branches, depth):
    """Layouts, and the layout of each line."""
    tokens = [cut(x, depth) for x in lines]
    sizes = Counter(len(t) for t in tokens if t)
    seen = Counter((len(t), i, w) for t in tokens for i, w in enumerate(t))
    keep = {k for k, n in seen.items() if n * share >= sizes[k[0]] and n >= least and not any(c.isdigit() for c in k[2]) and k[2] != WILD}
    masked = [tuple(w if (len(t), i, w) in keep or w == TAIL else WILD for i, w in enumerate(t)) for t in tokens]
    kinds = defaultdict(set)
    for p in masked:
        for i, w in enumerate(p[2:], 2):
            kinds[len(p), p[:2], i].add(w)
    final = [tuple(WILD if w != TAIL and len(kinds[len(p), p[:2], i]) > branches else w for i, w in enumerate(p)) for p in masked]
    return Counter(p for p in final if p), final


def best(tokens, layouts):
    fits = [p for p in layouts if len(p) == len(tokens) and all(w in (WILD, t) for w, t in zip(p, tokens))]
    mask = lambda p: "".join({WILD: "*", TAIL: "+"}.get(w, "=") for w in p)
    return min(fits, key=lambda p: (p.count(WILD), mask(p), " ".join(p)), default=None)


def some_lines(seed, n=600):
    rng = random.Random(seed)
    word = lambda k: f"{rng.choice('abcdefgh')}{'xyz'[rng.randrange(3)] * rng.randrange(1, k)}"
    shapes = [
        lambda: f"session opened for user {word(4)}",
        lambda: f"disk\t{rng.randrange(9)}  is {rng.choice(['full', 'failing', 'missing'])}",
        lambda: f"took {rng.randrange(5000)} ms",
        lambda: " ".join(word(3) for _ in range(rng.randrange(1, 6))),
        lambda: "every word the same " * 12,
        lambda: rng.choice(["", "  ", " ", "one", "<*> literal wildcard", " wide blanks　here"]),
    ]
    return [rng.choice(shapes)() for _ in range(n)]


LIMITS = [(mine.SHARE, mine.LEAST, mine.BRANCHES, mine.DEPTH), (10, 2, 1, 4), (1000, 1, 3, 3)]


@pytest.mark.parametrize("limits", LIMITS)
def test_layouts_equal_brute_force(raw_table, limits):
    lines = some_lines(1) + [None, "x" * 200_000, "word " * 50_000]
    found = mine.mined_templates(raw_table(lines).repartition(5), *limits).collect()
    want, _ = brute_force(lines, *limits)
    assert {(r.template, r.tokens, r.wildcards): r.events for r in found} == {(" ".join(p), len(p), p.count(WILD)): n for p, n in want.items()}


@pytest.mark.parametrize("limits", LIMITS[:2])
@pytest.mark.parametrize("limit", [mine.REGISTRY_BYTES, -1])
def test_lines_get_the_narrowest_layout(raw_table, limits, limit):
    lines = some_lines(2) + [None]
    df = raw_table(lines).repartition(3)
    registry = mine.mined_templates(df, *limits)
    extra = ["session opened for user nobody", "disk 7 is gone", "took 5 ms more"]
    other = raw_table(lines + extra)
    layouts = list(brute_force(lines, *limits)[0])
    got = {r.pos: r for r in mine.apply_mined(other, registry, limit, limits[3]).collect()}
    for pos, line in enumerate(lines + extra):
        tokens = cut(line, limits[3])
        want = best(tokens, layouts) if tokens else None
        assert got[pos].template == (" ".join(want) if want else None)
        assert got[pos].variables == ([t for t, w in zip(tokens, want) if w == WILD] if want else None)
    assert len(got) == len(lines + extra)


def test_small_registries_move_no_lines(raw_table):
    lines = raw_table(some_lines(3))
    registry = lines.sparkSession.createDataFrame([("took <*> ms", 600), ("disk <*> is <*>", 9)], "template string, events long")
    plan = mine.apply_mined(lines, registry)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("BroadcastExchange")]
    assert "Exchange" not in above.replace("BroadcastExchange", "") and "SortMergeJoin" not in plan


def test_a_layout_of_most_lines_costs_a_row_per_task(spark):
    df = spark.range(30_000, numPartitions=8).select(F.lit("b").alias("batch_id"), F.col("id").alias("pos"), F.concat(F.lit("took "), F.col("id").cast("string"), F.lit(" ms")).alias("raw"))
    found = mine.mined_templates(df)
    assert [tuple(r) for r in found.collect()] == [("took <*> ms", 3, 1, 30_000)]
    applied = mine.apply_mined(df, found, limit=-1)
    assert applied.filter("template = 'took <*> ms' and variables[0] = cast(pos as string)").count() == 30_000


def test_no_lines_and_no_registry(spark, raw_table):
    none = raw_table([])
    assert mine.mined_templates(none).collect() == []
    empty = spark.createDataFrame([], "template string, events long")
    for limit in (mine.REGISTRY_BYTES, -1):
        assert [r.template for r in mine.apply_mined(raw_table(["a b", ""]), empty, limit).collect()] == [None, None]
