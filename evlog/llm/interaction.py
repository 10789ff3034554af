"""Filter interaction audit: what a row of filters removes in any order, and each filter's Shapley share of the removals.

Every document becomes a mask of the filters it fails, and parts of the corpus are counted by mask. From these counts follow
the removals of all coalitions (subsets) of filters. Differences of coalitions are the steps of any order; the Shapley
values solve the kernel-weighted least squares of the coalitions under the constraint that the shares sum to the whole
(efficiency), in rationals, so they are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import join_hot, stored

FILTERS = "ABCDE"
#: Limits of the filters: words, hundredths of distinct words, hundredths of capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


# ---- coalitions -----------------------------------------------------------------------------------------------------


def solved(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """X of matrix X = right, by elimination in rationals; the matrix must be regular."""
    rows = [list(a) + list(b) for a, b in zip(matrix, right)]
    n = len(rows)
    for k in range(n):
        pivot = next(i for i in range(k, n) if rows[i][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(n):
            if i != k and rows[i][k]:
                factor = rows[i][k]
                rows[i] = [x - factor * y for x, y in zip(rows[i], rows[k])]
    return [row[n:] for row in rows]


def shapley_weights(n: int) -> list[list[Fraction]]:
    """W of phi = W v, for the values v of all 2 ** n coalitions (bit i: player i is in), with v[0] = 0.

    Least squares: phi minimises sum_S w(S) (v(S) - sum of phi over S)^2 over all S but the empty and the whole one, where
    w(S) = (n - 1) / (C(n, |S|) |S| (n - |S|)), subject to sum of phi = v(whole). The normal equations with the multiplier
    of the constraint are one regular system; its right-hand side is linear in v, so it is solved for every v at once.
    """
    if n == 1:
        return [[Fraction(0), Fraction(1)]]
    whole = (1 << n) - 1
    weight = {s: Fraction(n - 1, comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) for s in range(1, whole)}
    matrix = [[sum((w for s, w in weight.items() if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(n)] + [Fraction(1)] for i in range(n)]
    matrix.append([Fraction(1)] * n + [Fraction(0)])
    right = [[weight.get(s, Fraction(0)) if s >> i & 1 else Fraction(0) for s in range(whole + 1)] for i in range(n)]
    right.append([Fraction(int(s == whole)) for s in range(whole + 1)])
    return solved(matrix, right)[:n]


def coalition_removals(by_mask: Sequence[int]) -> list[int]:
    """Of each subset S of the filters, how many documents fail one of S at least; ``by_mask`` counts them by failed filters.

    A document survives S if its mask lies within the complement of S: sums over subsets, one filter at a time.
    """
    within = list(by_mask)
    for i in range(len(within).bit_length() - 1):
        for s in range(len(within)):
            if s >> i & 1:
                within[s] += within[s ^ 1 << i]
    return [within[-1] - within[len(within) - 1 - s] for s in range(len(within))]


def audit(by_mask: Sequence[int], good: Sequence[int], toxic: Sequence[int], filters: str = FILTERS, weights: list[list[Fraction]] | None = None) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order and step."""
    n = len(filters)
    removed, lost_good, lost_toxic = map(coalition_removals, (by_mask, good, toxic))
    total, whole = sum(by_mask), (1 << n) - 1
    shares = [factorial(n) * sum((w * v for w, v in zip(row, removed)), Fraction(0)) for row in weights or shapley_weights(n)]
    if any(s.denominator != 1 for s in shares):
        raise ArithmeticError("a Shapley value times the number of orders is no integer")
    for order in permutations(range(n)):
        before, name = 0, "".join(filters[i] for i in order)
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            here = removed[after] - removed[before]
            yield (
                name, step, total - removed[after], here, removed[1 << i] - here, removed[whole] - removed[whole ^ 1 << i],
                lost_good[after] - lost_good[before], lost_toxic[after] - lost_toxic[before], int(shares[i]),
            )
            before = after


# ---- filters --------------------------------------------------------------------------------------------------------


def failures(text: Column) -> Column:
    """Mask of the filters A to D that a text (null: empty) fails: bit 0 is A."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n_words, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    tests = [
        n_words < LEAST_WORDS,
        100 * distinct < LEAST_DISTINCT * n_words,
        100 * capitals > MOST_CAPITALS * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(tests)), F.lit(0)).cast("int")


def with_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` (_id, part, _mask, _digest) with bit 4 set for texts that a smaller id has as well. Digests are shuffled, never texts."""
    first = rows.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    met = join_hot(rows, first, "_digest", "_n", rows.count())
    return met.withColumn("_mask", F.col("_mask") + F.when(F.col("_first") < F.col("_id"), 16).otherwise(0))


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """_id, part and _mask of every row of ``docs``; whole texts are read once, and only their digests are compared."""
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    return with_repeats(stored(docs.select(F.col(id_col).alias("_id"), part.alias("part"), failures(F.col(text_col)).alias("_mask"), digest.alias("_digest"))))


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Counts of every order and step of the five filters within each part, zeros included (columns: ``STEPS``).

    A null text is an empty one, and a null part the empty string, which it shares with rows whose part is empty. A row
    with a null id has no label, and is neither a smaller nor a larger one for filter E; repeated rows count each for itself, and
    rows of one id are not repeats of each other. Labels of one id are taken together: a document is good or toxic if any of
    them says so. Other columns of ``docs`` and ``labels`` play no part; without documents there are no rows.
    """
    # rows of one id are combined before they are shuffled, so null or repeated ids cannot make a hot key of the join
    counted = masks(docs, id_col, text_col, part_col).groupBy("_id", "part", "_mask").agg(F.count("*").alias("_n"))
    said = labels.groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("_good"), F.max((F.col("toxic") == 1).cast("long")).alias("_toxic"))
    counted = counted.join(said, "_id", "left")
    sums = [F.sum("_n").alias("n"), F.sum(F.col("_n") * F.coalesce("_good", F.lit(0))).alias("good"), F.sum(F.col("_n") * F.coalesce("_toxic", F.lit(0))).alias("toxic")]
    by_mask = counted.groupBy("part", "_mask").agg(*sums)
    parts = by_mask.groupBy("part").agg(F.collect_list(F.struct("_mask", "n", "good", "toxic")).alias("counts"))  # 32 entries at most

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shapley_weights(len(FILTERS))
        names = [f.split()[0] for f in STEPS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                tables = [[0] * (1 << len(FILTERS)) for _ in range(3)]
                for entry in counts:
                    for table, kind in zip(tables, ("n", "good", "toxic")):
                        table[entry["_mask"]] = entry[kind]
                columns = zip(*((part, *row) for row in audit(*tables, weights=weights)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return parts.mapInArrow(steps, STEPS)
