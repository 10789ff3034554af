"""Filter interaction audit."""

import random
from collections import Counter
from fractions import Fraction
from itertools import permutations
from math import factorial

import pytest

from evlog.llm import interaction

DOCS = "doc_id long, text string, source string, part string, _mask int, n long"


def fails(text, earlier):
    text = text or ""
    words = text.encode().split()
    return "".join(
        name
        for name, failed in zip(
            "ABCDE",
            (
                len(words) < 50,
                100 * len(set(words)) < 65 * len(words),
                100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
                any(c in "#$%&*|" for c in text),
                earlier,
            ),
        )
        if failed
    )


def brute_force(docs, labels):
    """Every order is applied to every document, filter by filter."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    rows = [(doc_id, source or "", fails(text, doc_id is not None and first[text or ""] < doc_id)) for doc_id, text, source in docs]
    out, shares = [], Counter()
    for part in {r[1] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[1] == part]
            gone = []
            for step, name in enumerate(order, 1):
                here = [r for r in left if name in r[2]]
                left = [r for r in left if name not in r[2]]
                redundant = sum(name in r[2] for r in gone)
                gone += here
                shares[part, name] += len(here)
                only = sum(r[1] == part and r[2] == name for r in rows)
                out.append((part, "".join(order), step, len(left), len(here), redundant, only, sum(r[0] in good for r in here), sum(r[0] in toxic for r in here)))
    return sorted((*r, shares[r[0], r[1][r[2] - 1]]) for r in out)


def prose(rng, n, kinds):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def corpus(rng, n):
    texts = [prose(rng, rng.choice([10, 49, 50, 60, 90]), rng.choice([20, 60, 500])) + rng.choice(["", "", " 5 %", " A" * 30, " a|b"]) for _ in range(n // 2)]
    return [(i, rng.choice(texts), rng.choice(["s1", "s2", "", None])) for i in range(n)]


def test_equal_to_walking_every_order(spark):
    rng = random.Random(5)
    docs = corpus(rng, 300) + [(400, None, "s1"), (401, "", "s3"), (402, "", None), (None, "x", "s1"), (None, "x", "s1"), (403, "x", "s1"), (403, "x", "s1")]
    docs += [(500, "aa bb " * 200_000, "long"), (501, "A" * 6 + "a" * 94, "caps"), (502, "A" * 5 + "a" * 95, "caps")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 420, 2)] + [(403, 1, 0), (403, 0, 1), (None, 1, 1)]
    left = spark.createDataFrame([(*d, "clash", 1, 2) for d in docs], DOCS).repartition(4)
    got = interaction.interactions(left, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == brute_force(docs, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.interactions(docs, labels).collect() == []
    one = interaction.interactions(spark.createDataFrame([(1, "a", None, "", 0, 0)], DOCS), labels).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_least_squares_give_the_mean_over_all_orders(n):
    rng = random.Random(n)
    values = [0] + [rng.randrange(1_000) for _ in range((1 << n) - 1)]
    weights = interaction.shapley_weights(n)
    mean = [Fraction(0)] * n
    for order in permutations(range(n)):
        s = 0
        for i in order:
            mean[i] += Fraction(values[s | 1 << i] - values[s], factorial(n))
            s |= 1 << i
    assert [sum(w * v for w, v in zip(row, values)) for row in weights] == mean
    assert sum(mean) == values[-1]


def test_coalitions_count_documents_that_fail_any_member():
    rng = random.Random(2)
    by_mask = [rng.randrange(50) for _ in range(32)]
    want = [sum(n for mask, n in enumerate(by_mask) if mask & s) for s in range(32)]
    assert interaction.coalition_removals(by_mask) == want


def test_hot_text_and_hot_id(spark):
    docs = [(i, "same text again", "a") for i in range(3_000)] + [(9, f"t{i}", "b") for i in range(500)] + [(None, "n", None)] * 500
    got = interaction.interactions(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int"))
    first = {(r["part"], r["filter_order"][0]): r for r in got.filter("step = 1").collect()}
    assert first["a", "E"]["removed"] == 2_999 and first["b", "A"]["good_lost"] == 500 and first["", "E"]["removed"] == 0
