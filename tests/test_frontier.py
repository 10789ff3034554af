"""Growing Merkle trees: appended leaves and consistency of old roots, against trees built whole."""

import hashlib
from functools import reduce

import pytest
from pyspark.sql import functions as F

from evlog.operators import frontier as G
from evlog.operators import merkle as M


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(leaves):
    """Levels of the whole tree, bottom first."""
    levels = [[h(x) for x in leaves]]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([h(row[i] + (row[i + 1] if i + 1 < len(row) else row[i])) for i in range(0, len(row), 2)])
    return levels


def batches(spark, sizes, first=None):
    """A batch of each (name, from, to); its leaves are texts of name and position."""
    rows = [(name, i, h(f"{name.split('/')[0]}:{i}")) for name, lo, hi in sizes for i in range(lo, hi)]
    return spark.createDataFrame(rows, "batch_id string, pos bigint, leaf string")


def leaves_of(name, n):
    return [h(f"{name}:{i}") for i in range(n)]


@pytest.mark.parametrize("k", [2, 10])
def test_every_cut_of_small_batches(spark, k):
    """(n, cut) for all n up to 12: frontier from stored nodes, the rest appended; root, peaks and nodes equal the whole tree's."""
    pairs = [(n, cut) for n in range(1, 13) for cut in range(0, n + 1)]
    name = lambda n, cut: f"x/{n}/{cut}"
    before = batches(spark, [(name(n, c), 0, c) for n, c in pairs]).repartition(4)
    after = batches(spark, [(name(n, c), c, n) for n, c in pairs]).repartition(4)
    counts = spark.createDataFrame([(name(n, c), c) for n, c in pairs], "batch_id string, leaf_count bigint")
    old_nodes = M.merkle_nodes(before, k)
    stored = G.merkle_frontier(old_nodes, counts)
    old_roots = {r.batch_id: r.root for r in G.with_root(stored).collect()}
    nodes, grown = G.merkle_append(stored, after, k)
    found = {r.batch_id: r for r in G.with_root(grown).collect()}
    new = {(r.batch_id, r.level, r.pos): r.hash for r in nodes.collect()}
    kept = {(r.batch_id, r.level, r.pos): r.hash for r in old_nodes.collect()}
    assert len(new) == nodes.count()
    for n, c in pairs:
        levels = tree(leaves_of("x", n))
        assert old_roots[name(n, c)] == (tree(leaves_of("x", c))[-1][0] if c else h(""))
        assert (found[name(n, c)].leaf_count, found[name(n, c)].root, len(found[name(n, c)].peaks)) == (n, levels[-1][0], n.bit_count())
        both = {key[1:]: v for key, v in kept.items() if key[0] == name(n, c)} | {key[1:]: v for key, v in new.items() if key[0] == name(n, c)}
        want = {(l, i): x for l, row in enumerate(levels) for i, x in enumerate(row)}
        assert {key: both[key] for key in want} == want
        changed = sum(1 for key in new if key[0] == name(n, c))
        assert changed <= 2 * (n - c) + len(levels)


def test_a_large_batch_in_many_steps(spark):
    name, sizes = "big", [0, 1, 1023, 1025, 3000, 3001, 5000]
    frontier = spark.createDataFrame([], f"batch_id string, leaf_count bigint, peaks {G.PEAKS}")
    for lo, hi in zip(sizes, sizes[1:]):
        _, frontier = G.merkle_append(frontier, batches(spark, [(name, lo, hi)]))
        rows = frontier.collect()
        frontier = spark.createDataFrame(rows, frontier.schema)
    (row,) = G.with_root(frontier).collect()
    assert (row.leaf_count, row.root) == (5000, tree(leaves_of(name, 5000))[-1][0])


@pytest.mark.parametrize("positions", [[3, 4], [2, 2], [2, 4], [2, None], [1, 2], [2, 3, 3, 6, 6, 7]])
def test_positions_must_go_on(spark, positions):
    frontier = G.merkle_frontier(M.merkle_nodes(batches(spark, [("b", 0, 2)])), spark.createDataFrame([("b", 2)], "batch_id string, leaf_count bigint"))
    more = spark.createDataFrame([("b", p, "x") for p in positions], "batch_id string, pos bigint, leaf string")
    with pytest.raises(Exception, match="don't go on|not dense"):
        G.merkle_append(frontier, more)[1].collect()


def test_missing_peaks_and_no_leaves(spark):
    counts = spark.createDataFrame([("b", 3), ("none", 0)], "batch_id string, leaf_count bigint")
    nodes = M.merkle_nodes(batches(spark, [("b", 0, 2)]))
    with pytest.raises(Exception, match="lack a peak"):
        G.merkle_frontier(nodes, counts).collect()
    frontier = G.merkle_frontier(nodes, counts.filter("leaf_count = 0"))
    nodes, grown = G.merkle_append(frontier, batches(spark, []))
    assert nodes.count() == 0 and [(r.leaf_count, r.root) for r in G.with_root(grown).collect()] == [(0, h(""))]


def proofs_of(spark, pairs, change=lambda df: df):
    sizes = sorted({n for _, n in pairs})
    nodes = M.merkle_nodes(batches(spark, [(f"x/{n}", 0, n) for n in sizes]))
    claims = spark.createDataFrame([(f"x/{n}", c, n) for c, n in pairs], "batch_id string, old_count bigint, new_count bigint")
    roots = [(f"x/{n}", c, n, tree(leaves_of("x", c))[-1][0] if c else h(""), tree(leaves_of("x", n))[-1][0]) for c, n in pairs]
    roots = spark.createDataFrame(roots, "batch_id string, old_count bigint, new_count bigint, old_root string, new_root string")
    proofs = G.consistency_proofs(nodes, claims).join(roots, ["batch_id", "old_count", "new_count"])
    return G.verify_consistency(change(proofs))


def test_every_prefix_is_proved(spark):
    pairs = [(c, n) for n in range(1, 18) for c in range(0, n + 1)]
    rows = proofs_of(spark, pairs).collect()
    assert len(rows) == len(pairs) and all(r.valid for r in rows)
    assert all(r.proof is None or len(r.proof) == (r.new_count - 1).bit_length() for r in rows)


FORGERIES = {
    "old root": lambda df: df.withColumn("old_root", F.sha2("old_root", 256)),
    "new root": lambda df: df.withColumn("new_root", F.sha2("new_root", 256)),
    "first": lambda df: df.withColumn("first", F.sha2(F.coalesce("first", F.lit("")), 256)),
    "a step": lambda df: df.withColumn("proof", F.transform("proof", lambda s, i: F.struct(F.when(i == F.size("proof") - 1, F.sha2(s["hash"], 256)).otherwise(s["hash"]).alias("hash"), s["position"].alias("position")))),
    "a side": lambda df: df.withColumn("proof", F.transform("proof", lambda s: F.struct(s["hash"].alias("hash"), F.lit("left").alias("position")))),
    "one step less": lambda df: df.withColumn("proof", F.slice("proof", F.lit(1), F.size("proof") - 1)),
    "no proof": lambda df: df.withColumn("proof", F.lit(None).cast(G.STEPS)),
    "old count": lambda df: df.withColumn("old_count", F.col("old_count") + 1),
    "new count": lambda df: df.withColumn("new_count", F.col("new_count") * 2 + 1),
}


@pytest.mark.parametrize("kind", FORGERIES)
def test_forgeries_are_refused(spark, kind):
    pairs = [(c, n) for n in (2, 3, 6, 11, 16) for c in range(1, n)]
    bad = [(r.old_count, r.new_count) for r in proofs_of(spark, pairs, FORGERIES[kind]).filter("valid").collect()]
    if kind == "a side":  # a path that has only left sides is the whole truth where the new leaf is the last of a full tree
        bad = [b for b in bad if b[0] + 1 != b[1] or b[1].bit_count() > 1]
    assert bad == []


def test_a_reordered_prefix_is_refused(spark):
    swapped = [leaves_of("x", 7)[i] for i in (1, 0, 2, 3, 4, 5, 6)]
    root = tree(swapped)[-1][0]
    rows = proofs_of(spark, [(7, 11), (7, 16)], lambda df: df.withColumn("old_root", F.lit(root))).collect()
    assert len(rows) == 2 and not any(r.valid for r in rows)


def test_peaks_alone_give_the_root(spark):
    rows = []
    for n in range(0, 70):
        levels = tree(leaves_of("x", n)) if n else [[]]
        peaks = {l: levels[l][(n >> l) - 1] for l in range(n.bit_length()) if n >> l & 1}
        rows.append((n, peaks, levels[-1][0] if n else h("")))
    df = spark.createDataFrame(rows, f"n bigint, peaks {G.PEAKS}, root string")
    assert df.filter(G.frontier_root(F.col("n"), F.col("peaks")) != F.col("root")).count() == 0
    assert reduce(max, [len(p) for _, p, _ in rows]) == 6
