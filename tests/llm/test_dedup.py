"""SimHash near-duplicates and substring deduplication against brute force, with odd inputs."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evlog.llm import simhash, substrings
from evlog.llm.common import join_hot

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], DOCS)


def plain_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def plain_components(rows):
    prints = [plain_print(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return Counter((d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints)))


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 60, 200]))]
        rows.append((i * 3 + 1, " ".join(words)))
        if rng.random() < 0.5:
            for _ in range(rng.choice([1, 2, 4])):
                changed = list(words)
                for _ in range(rng.choice([0, 1, 2])):
                    if changed:
                        changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
                rows.append((1000 + len(rows), rng.choice([" ", "\n", "\t "]).join(changed).upper()))
    return rows


ODD = [(7, None), (3, ""), (None, "a b c d e"), (None, None), (9, "a b c d e"), (9, "a b c d e"), (11, " \t\n"), (12, "A B C d"), (13, "É é " * 50), (14, "x " * 30_000)]


@pytest.mark.parametrize("rows", [corpus(1), corpus(2), ODD + corpus(3, 30), []])
def test_near_duplicates(spark, rows):
    got = simhash.near_duplicates(docs_of(spark, rows)).select("doc_id", "fingerprint", "component_id").collect()
    assert Counter(map(tuple, got)) == plain_components(rows)


def test_fingerprint_matches_its_definition():
    for _, text in ODD + corpus(4, 20):
        assert int.from_bytes(simhash.fingerprint(text), "little") == plain_print(text)


@pytest.mark.parametrize("shard", [8, 50])
def test_trees_and_blocks_lose_no_pair(spark, shard):
    """Random prints with planted neighbours and one dense ball, with shards far smaller than the groups."""
    rng = np.random.default_rng(shard)
    prints = list(rng.integers(0, 1 << 64, 300, dtype=np.uint64))
    for p in prints[:120]:
        for bit in rng.choice(64, rng.integers(1, 6), replace=False):
            p ^= np.uint64(1) << np.uint64(bit)
        prints.append(p)
    centre = prints[0]
    for _ in range(200):
        p = centre
        for bit in rng.choice(64, 3, replace=False):
            p ^= np.uint64(1) << np.uint64(bit)
        prints.append(p)
    prints = np.unique(np.array(prints, np.uint64))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    want = simhash.Parts(len(prints))
    a, b = np.nonzero(near)
    want.join(a, b)
    df = spark.createDataFrame([(int(p), p.tobytes()) for p in prints.view(np.int64)], "_fp long, _bits binary")
    edges = simhash.links(df, len(prints), shard=shard)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    got = [roots.get(int(p), int(p)) for p in prints.view(np.int64)]
    groups = lambda labels: Counter(frozenset(i for i, x in enumerate(labels) if x == k) for k in set(labels))
    assert groups(got) == groups(want.label.tolist())


def test_large_buckets_are_linked_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 64)
    rng = np.random.default_rng(5)
    prints = np.unique(rng.integers(0, 1 << 10, 400, dtype=np.uint64) << np.uint64(40))
    label = simhash.linked(prints[:, None], np.ones(len(prints), bool), 0, 4)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    want = simhash.Parts(len(prints))
    want.join(*np.nonzero(near))
    assert len(set(label)) == len(set(want.label))


def test_wide_prints_tell_similarity(spark):
    """Similar texts are linked and others are not, with room on either side of the threshold."""
    rng = random.Random(9)
    rows, near = [], []
    for i in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(300)]
        rows.append((10 * i, " ".join(words)))
        for k, changes in enumerate((2, 6, 40)):  # each changed word touches five shingles: similarities 0.93, 0.82 and 0.2
            changed = list(words)
            for at in rng.sample(range(0, 300, 5), changes):
                changed[at] = f"x{rng.randrange(10**6)}"
            rows.append((10 * i + k + 1, " ".join(changed)))
        near.append(10 * i)
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs_of(spark, rows), shingle=5, radius=simhash.WIDE_RADIUS, words=4).collect()}
    assert all(found[d + 1] == d for d in near) and sum(found[d + 2] == d for d in near) > 40
    assert all(found[d + 3] == d + 3 for d in near) and all(found[d] == d for d in near)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


def test_keep_one_of_each_group(spark):
    rows = [(5, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (8, "quite another text that has other words"), (None, "a b c d e f"), (None, "lone text without any id")]
    kept = simhash.keep_one(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([rows[1], rows[3], rows[5]])


def test_hot_keys_meet_their_row(spark):
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(k, k) for k in range(2, 50)] + [(None, 1)], "k long, v int")
    right = spark.createDataFrame([(1, 500, "hot")] + [(k, 1, f"x{k}") for k in range(2, 40)], "k long, n long, name string")
    got = Counter(r.name for r in join_hot(left, right, "k", "n", 549, hot_share=10).collect())
    assert got == {"hot": 500, None: 11, **{f"x{k}": 1 for k in range(2, 40)}}


# ---- repeated substrings ----------------------------------------------------------------------------------------------


def plain_cut(rows, window=35):
    words = [WORD.findall(t or "") for _, t in rows]
    starts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def passages(seed):
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(2000)}"
    shared = [[word() for _ in range(n)] for n in (34, 35, 36, 55, 56, 80, 200)]
    rows = []
    for i in range(80):
        words = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(shared)
            cut = rng.randrange(0, max(1, len(p) - 30)) if rng.random() < 0.3 else 0
            words += p[cut:] + [word() for _ in range(rng.randrange(0, 30))]
        rows.append((i, " ".join(words)))
    return rows


REPEATS = [(1, None), (2, ""), (3, "a " * 200), (4, "Ab c " * 3), (None, "n " * 40), (5, "p q r " * 30), (6, "p q r " * 12), (7, "same words " * 20 + "end"), (7, "same words " * 20 + "end")]


@pytest.mark.parametrize("rows", [passages(1), passages(2), REPEATS, REPEATS + passages(3), []])
def test_repeats_are_cut(spark, rows):
    got = substrings.remove_repeats(docs_of(spark, rows))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "n_removed", "kept_sha256", "kept_text"]
    cells = got.collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in cells) == plain_cut(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in cells)


def test_rows_that_share_a_key_keep_their_own_words(spark, monkeypatch):
    monkeypatch.setattr(substrings, "row_hash", lambda *_: F.lit(7).cast("long"))
    rows = REPEATS + passages(5)
    got = substrings.remove_repeats(docs_of(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_cut(rows)


def test_repeats_across_flushes(spark, monkeypatch):
    monkeypatch.setattr(substrings, "KEYS_AT_ONCE", 50)
    rows = passages(4)
    got = substrings.remove_repeats(docs_of(spark, rows).repartition(7), with_text=False).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_cut(rows)


def test_cover_holds_every_difference():
    marks = {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER}
    assert marks == set(range(substrings.PERIOD))


def test_clashing_columns(spark):
    docs = docs_of(spark, [(1, "x y"), (2, "z")]).selectExpr("*", "1 as n_words", "'q' as kept_text", "2 as fingerprint", "3 as key", "4 as at", "5 as _text", "6 as _row", "7 as _starts", "8 as node", "9 as a", "10 as _root")
    cut = substrings.remove_repeats(docs)
    assert {r.n_words for r in cut.collect()} == {1, 2} and {(r._row, r._starts, r._text) for r in cut.collect()} == {(6, 7, 5)}
    assert simhash.near_duplicates(docs).count() == 2
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {(r._row, r._root) for r in kept.collect()} == {(6, 10)}
