import hashlib

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from evlog.operators.merkle import (
    batch_roots, folded_batches, leaf_positions, merkle_nodes, merkle_proofs, merkle_root, position_faults, tamper_diff,
    tamper_locate, verify_batch, verify_proofs,
)

SIZES = [1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 31, 33, 65]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    level = [h(x) for x in leaves]
    levels = [level]
    while len(level) > 1:
        even = level + level[-1:] * (len(level) % 2)
        level = [h(even[i] + even[i + 1]) for i in range(0, len(even), 2)]
        levels.append(level)
    return levels


TREES = {f"b{n}": tree([h(f"{n}-{i}") for i in range(n)]) for n in SIZES}


@pytest.fixture(scope="module")
def leaves(spark):
    rows = [(f"b{n}", i, h(f"{n}-{i}")) for n in SIZES for i in range(n)]
    return spark.createDataFrame(rows, "batch_id string, pos bigint, leaf string").repartition(5).cache()


@pytest.mark.parametrize("k", [3, 4, 10])
def test_against_level_by_level(leaves, k):
    roots = {r.batch_id: r.root for r in merkle_root(leaves, k=k).collect()}
    assert roots == {b: t[-1][0] for b, t in TREES.items()}
    nodes = {(r.batch_id, r.level, r.pos): r.hash for r in merkle_nodes(leaves, k=k).collect()}
    assert nodes == {(b, l, i): x for b, t in TREES.items() for l, row in enumerate(t) for i, x in enumerate(row)}
    for r in verify_proofs(merkle_proofs(leaves, k=k)).collect():
        levels, at, want = TREES[r.batch_id], r.pos, []
        for row in levels[:-1]:
            want.append((row[at - 1], "left") if at % 2 else (row[min(at + 1, len(row) - 1)], "right"))
            at //= 2
        assert r.valid and [tuple(s) for s in r.proof] == want


def test_empty_batch(spark, leaves):
    batches = spark.createDataFrame([("b3",), ("none",)], "batch_id string")
    got = {r.batch_id: (r.root, r.leaf_count) for r in batch_roots(leaves, batches).collect()}
    assert got == {"b3": (TREES["b3"][-1][0], 3), "none": (h(""), 0)}


JOBS = {
    "root": lambda df, k: merkle_root(df, k=k),
    "nodes": lambda df, k: merkle_nodes(df, k=k),
    "proofs": lambda df, k: merkle_proofs(df, k=k),
    "verify": lambda df, k: verify_batch(df, df.select("batch_id", df.leaf.alias("root")).limit(0), k=k),
}
FAULTS = {
    "gap": lambda df: df.filter("not (batch_id = 'b9' and pos = 3)"),
    "last chunk gap": lambda df: df.filter("not (batch_id = 'b65' and pos = 62)"),
    "repeat": lambda df: df.union(df.filter("batch_id = 'b9' and pos = 3")),
    "repeat and gap": lambda df: df.withColumn("pos", F.expr("if(batch_id = 'b9' and pos = 4, 3L, pos)")),
    "equal sums": lambda df: df.withColumn("pos", F.expr("case when batch_id = 'b65' and pos = 20 then 19L when batch_id = 'b65' and pos = 40 then 41L else pos end")),
    "moved between chunks": lambda df: df.withColumn("pos", F.expr("case when batch_id = 'b65' and pos = 7 then 33L when batch_id = 'b65' and pos = 33 then 7L when batch_id = 'b65' and pos = 40 then 14L when batch_id = 'b65' and pos = 12 then 38L else pos end")),
    "all at one place": lambda df: df.withColumn("pos", F.expr("if(batch_id = 'b65', 0L, pos)")),
    "null position": lambda df: df.withColumn("pos", F.expr("if(batch_id = 'b9' and pos = 8, null, pos)")),
    "null batch": lambda df: df.withColumn("batch_id", F.expr("if(batch_id = 'b2', null, batch_id)")),
    "negative": lambda df: df.withColumn("pos", F.expr("if(batch_id = 'b9', pos - 1, pos)")),
}


@pytest.mark.parametrize("fault", FAULTS)
@pytest.mark.parametrize("job", JOBS)
def test_positions_that_are_not_dense_never_give_a_root(leaves, job, fault):
    with pytest.raises(Exception, match="positions not dense"):
        JOBS[job](FAULTS[fault](leaves), 3).collect()


def test_no_leaves_at_all(leaves):
    for job in JOBS.values():
        assert job(leaves.limit(0), 3).count() == 0


def test_position_faults(leaves):
    none = {(r.batch_id, r.rows, r.nulls, r.repeats, r.gaps) for r in position_faults(leaves).collect()}
    assert none == {(f"b{n}", n, 0, 0, 0) for n in SIZES}

    def of(fault, batch="b9"):
        return next(tuple(r)[1:] for r in position_faults(FAULTS[fault](leaves)).collect() if r.batch_id == batch)

    assert of("gap") == (8, 0, 0, 1) and of("repeat") == (10, 0, 1, 0) and of("repeat and gap") == (9, 0, 1, 1)
    assert of("null position") == (9, 1, 0, 0) and of("negative") == (9, 1, 0, 0) and of("null batch", None) == (2, 0, 0, 0)
    assert of("all at one place", "b65") == (65, 0, 64, 0)


def test_claims_and_batches_that_miss_their_other_side(spark, leaves):
    roots = merkle_root(leaves.filter("batch_id in ('b3', 'b5', 'b7')")).select("batch_id", "root")
    claims = roots.union(spark.createDataFrame([("lost", "0" * 64), ("empty", h("")), ("short", "ab"), (None, "0" * 64)], roots.schema))
    claims = claims.withColumn("root", F.expr("if(batch_id = 'b7', substr(root, 1, 40), root)"))
    found = leaves.filter("batch_id in ('b3', 'b5', 'b7', 'b9')").withColumn("leaf", F.expr("if(batch_id = 'b5' and pos = 2, 'short', leaf)"))
    got = {r.batch_id: r for r in verify_batch(found, claims).collect()}
    assert set(got) == {"b3", "b5", "b7", "b9", "lost", "empty", "short", None}
    assert {b for b, r in got.items() if r.verified} == {"b3", "empty"}
    assert {b: r.bad_digests for b, r in got.items() if r.bad_digests} == {"b5": 1, "b7": 1, "short": 1}
    assert got["lost"].leaf_count == 0 and got["lost"].rebuilt_root == h("") and not got["lost"].root_rebuilt_matches
    assert got["b9"].claimed_root is None and got["b9"].rebuilt_root == TREES["b9"][-1][0]
    assert got["b5"].rebuilt_root is None and not got["b5"].all_leaf_proofs_valid


def test_sums_ride_along(leaves):
    got = folded_batches(leaves.withColumn("odd", F.col("pos") % 2), k=3, sums=("odd",)).collect()
    assert {(r.batch_id, r.root, r.leaf_count, r.odd) for r in got} == {(f"b{n}", TREES[f"b{n}"][-1][0], n, n // 2) for n in SIZES}
    assert all(r.all_leaf_proofs_valid for r in got)


def test_tampering(spark, leaves):
    bad = F.expr("(batch_id = 'b65' and pos in (7, 64)) or (batch_id = 'b5' and pos = 4)")
    changed = leaves.withColumn("leaf", F.when(bad, F.lit("x" * 64)).otherwise(F.col("leaf"))).filter(
        "not (batch_id = 'b33' and pos = 32)"
    )
    want = {("b65", 7), ("b65", 64), ("b5", 4), ("b33", 32)}
    roots, diff = tamper_diff(leaves, changed)
    assert {r.batch_id for r in roots.filter("roots_differ").collect()} == {"b65", "b5", "b33"}
    assert {(r.batch_id, r.pos) for r in diff.collect()} == want
    nodes, others = merkle_nodes(leaves, k=4).cache(), merkle_nodes(changed, k=4).cache()
    assert {(r.batch_id, r.pos) for r in tamper_locate(nodes, others, k=4).collect()} == want
    checked = verify_batch(changed, merkle_root(leaves)).collect()
    assert {r.batch_id for r in checked if not r.verified} == {"b65", "b5", "b33"}
    assert all(r.all_leaf_proofs_valid for r in checked)


def test_nodes_scan_their_leaves_once(spark):
    rows = spark.range(200).select(F.lit("b").alias("batch_id"), F.col("id").alias("pos"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    nodes = merkle_nodes(rows, k=3)
    assert len(nodes.collect()) == 402  # 200, 100, 50, 25, 13, 7, 4, 2, 1
    plan = nodes._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Range (") == 1


def test_located_tampering_reads_stored_nodes(spark):
    found = queries()["tamper_locate"](spark, "/root/testdata/sf0.001")
    assert found.inputFiles() and not [f for f in found.inputFiles() if "/level=" not in f]


def test_positions_of_a_hot_batch(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("b"), F.col("id") % 40)).alias("batch_id"),
        (F.col("id") * 7919 % 3001).alias("at"),
    )
    got = leaf_positions(rows, "at").groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("at", "pos"))).alias("x"))
    for r in got.collect():
        assert [p.pos for p in r.x] == list(range(len(r.x)))


def test_positions_of_odd_rows(spark):
    rows = [(None, 3, "a"), (None, 1, "b"), ("", 5, "c"), ("b", 2, "d"), ("b", None, "e")]
    df = spark.createDataFrame(rows, "batch_id string, at int, x string")
    got = {r.x: r.pos for r in leaf_positions(df, "at").collect()}
    assert got == {"b": 0, "a": 1, "c": 0, "e": 0, "d": 1}
    assert leaf_positions(df, "at").columns == ["batch_id", "at", "x", "pos"] and leaf_positions(df.limit(0), "at").count() == 0
    with pytest.raises(Exception, match="same order"):
        leaf_positions(df.union(df.limit(1)), "at").collect()


@pytest.mark.parametrize("buckets", [1, 2, 7, 64])
def test_positions_with_any_number_of_buckets(spark, buckets):
    df = spark.range(500).select(F.lit("b").alias("batch_id"), F.md5(F.col("id").cast("string")).alias("at"))
    got = [r.at for r in leaf_positions(df, "at", buckets=buckets).orderBy("pos").collect()]
    assert got == sorted(got) and len(got) == 500
