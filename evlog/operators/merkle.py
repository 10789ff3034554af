"""Merkle trees over ordered leaves, folded in chunks.

A batch may hold most of the data, so no task ever sees a whole batch.  Leaves
are grouped by (batch, position div 2^k); one row folds its 2^k nodes k levels
up, and the chunk roots are folded again in the next round.  n leaves need
ceil(log2 n / k) shuffles, each 2^k times smaller than the one before.

The last node of an odd level is paired with itself.  Only the last chunk of a
batch can be partial; it stops at one node, and the next round first lifts that
node to the height of its neighbours.  A chunk that is alone in its batch is
the finished tree and is passed on as it is.  Alone means: the only member of
chunk 0, since positions are dense.

Positions are held to that.  One pass over them, which also finds the number of
rounds, refuses batches whose count, ends or sum don't fit, before anything is
gathered; and each chunk checks that its members stand at consecutive positions
and are full but for the last.  So a gap, a repeat, or a null never gives a root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evlog.fixed import DIGEST_LENGTH
from evlog.functions.text import kept, let

K = 10
PROOF = "array<struct<hash:string,position:string>>"
BOUNDS_SAMPLE = 20_000


def empty_root() -> Column:
    """Root of a batch without leaves."""
    return F.sha2(F.lit(""), 256)


def pair_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(left, right), 256)


def paired_level(level: Column) -> Column:
    """The level above: nodes in pairs, the last of an odd number with itself."""
    pairs = F.sequence(F.lit(0), (F.size(level) - 1).bitwiseAND(F.lit(-2)), F.lit(2))
    return F.transform(
        pairs,
        lambda i: pair_hash(F.get(level, i), F.coalesce(F.get(level, i + 1), F.get(level, i))),
    )


# --- leaf order --------------------------------------------------------------


def _place(key: Column, bounds: Column, most: int) -> Column:
    """Number of sorted bounds up to the key, by halving."""

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        above = F.get(bounds, middle) <= key
        return F.when(at["lo"] >= at["hi"], at).otherwise(
            F.struct(F.when(above, middle + 1).otherwise(at["lo"]).alias("lo"), F.when(above, at["hi"]).otherwise(middle).alias("hi"))
        )

    start = F.struct(F.lit(0).alias("lo"), F.greatest(F.size(bounds), F.lit(0)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most.bit_length() + 1)), start, halve)["lo"]


def leaf_positions(df: DataFrame, order: str, batch: str = "batch_id", buckets: int | None = None) -> DataFrame:
    """Add ``pos``: dense 0-based position per batch by ``order``.

    ``order`` must be unique and not null within a batch; a tie fails the job.  A
    null batch is a batch of its own.  Rows are dealt to buckets of consecutive
    (batch, order), so a giant batch spreads over many tasks.  The bounds of the
    buckets are a bounded sample, taken once: they steer the size of tasks only,
    and a row's bucket stays the same however often it is computed.  The rows are
    shuffled once; the offsets of the buckets are a few numbers each.
    """
    if buckets is None:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(F.col(batch).alias("b"), F.col(order).alias("o"))
    # a hash threshold keeps what all tasks together send to about twice the sample
    share = min(1.0, 2 * BOUNDS_SAMPLE / max(1, df.count()))
    thinned = df.select(key.alias("key")).filter(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < int(share * (1 << 40)))
    sample = thinned.orderBy(F.xxhash64("key")).limit(BOUNDS_SAMPLE)
    parts = sample.withColumn("n", F.ntile(buckets).over(Window.orderBy("key"))).groupBy("n").agg(F.min("key").alias("key"))
    bounds = parts.agg(F.array_sort(F.collect_list("key"))).scalar()
    placed = df.withColumn("_bounds", kept(bounds))
    place = let(F.struct(key.alias("key"), F.col("_bounds").alias("bounds")), lambda s: _place(s["key"], s["bounds"], buckets))
    placed = placed.withColumn("_bucket", place).drop("_bounds")
    placed = placed.withColumns({"_none": F.col(batch).isNull(), "_batch": F.coalesce(F.col(batch).cast("string"), F.lit(""))})
    keys = ["_none", "_batch", "_bucket"]
    before = Window.partitionBy("_none", "_batch").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy(order)
    tie = F.lag(F.struct(F.col(order))).over(inside).eqNullSafe(F.struct(F.col(order)))
    rank = F.when(tie, F.raise_error(F.lit("two rows of a batch have the same order")).cast("int")).otherwise(F.row_number().over(inside))
    numbered = placed.withColumn("_rank", rank)
    return numbered.join(offsets, keys).withColumn("pos", F.col("_offset") + F.col("_rank") - 1).select(*df.columns, "pos")


# --- chunked fold ------------------------------------------------------------


def _fold(nodes: Column, k: int) -> Column:
    """Levels of one chunk, bottom first: at most k folds, ending at a single node."""

    def step(levels: Column, _: Column) -> Column:
        top = F.element_at(levels, -1)
        return F.when(F.size(top) < 2, levels).otherwise(F.concat(levels, F.array(let(top, paired_level))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.array(nodes), step)


def _lift(node: Column, times: Column) -> Column:
    """The node followed by its ``times`` pairings with itself."""

    def again(path: Column, _: Column) -> Column:
        top = F.element_at(path, -1)
        return F.concat(path, F.array(pair_hash(top, top)))

    return F.when(times <= 0, F.array(node)).otherwise(
        F.aggregate(F.sequence(F.lit(1), times), F.array(node), again)
    )


def _chunks(nodes: DataFrame, k: int, height: int, sums: tuple[str, ...] = (), verify: bool = False) -> DataFrame:
    """Group nodes (batch_id, idx, hash, missing, leaves, ...) into folded chunks.

    ``height`` is the level of the nodes.  Members must stand at consecutive
    positions, and all but the last must hold 2^height leaves; together with the
    same check one round up that makes the positions of a batch dense.  With
    ``verify`` each member's audit path within the chunk is followed to the chunk's root.
    """
    carried = [c for c in ("leaf",) if c in nodes.columns]
    member = F.struct("idx", "hash", "missing", "leaves", *carried)
    grouped = nodes.groupBy("batch_id", F.shiftright("idx", k).alias("chunk")).agg(
        F.sort_array(F.collect_list(member)).alias("_m"),
        *[F.sum(c).alias(c) for c in sums],
        *([F.bool_and("ok").alias("ok")] if verify else []),
    )
    # counted after the shuffle: readers with and without the count share one shuffle, and so one scan of the leaves
    leaves = F.aggregate("_m", F.lit(0).cast("bigint"), lambda n, m: n + m["leaves"])
    last = F.size("_m") - 1
    in_place = F.transform(
        F.col("_m"),
        lambda m, j: (m["idx"] == F.shiftleft(F.col("chunk"), k) + j) & ((j == last) | (m["leaves"] == F.lit(1 << height))),
    )
    message = F.concat(F.lit("positions not dense in batch "), F.coalesce(F.col("batch_id").cast("string"), F.lit("null")))
    checked = F.when(F.forall(in_place, lambda x: x), F.col("_m")).otherwise(
        F.raise_error(message).cast(grouped.schema["_m"].dataType)
    )
    alone = (F.col("chunk") == 0) & (F.size("_m") == 1)
    members = F.transform(
        checked,
        lambda m: F.struct(
            m["idx"].alias("idx"),
            _lift(m["hash"], F.when(alone, 0).otherwise(m["missing"])).alias("path"),
            *[m[c].alias(c) for c in carried],
        ),
    )
    passed = [*sums, *(["ok"] if verify else [])]
    staged = grouped.select("batch_id", "chunk", leaves.alias("leaves"), *passed, kept(members).alias("members"))
    tops = F.transform(F.col("members"), lambda m: F.element_at(m["path"], -1))
    folded = staged.withColumn("levels", kept(_fold(tops, k)))
    if verify:
        root = F.get(F.element_at("levels", -1), F.lit(0))
        follows = F.transform(
            F.col("members"),
            lambda m, j: _follow(F.get(m["path"], F.lit(0)), F.concat(_own_lifts(m["path"]), _siblings(F.col("levels"), j))) == root,
        )
        folded = folded.withColumn("ok", F.col("ok") & F.forall(follows, lambda x: x))
    return folded


def _roots(chunks: DataFrame, k: int, sums: tuple[str, ...] = (), verify: bool = False) -> DataFrame:
    """Chunk roots as the nodes of the next round."""
    return chunks.select(
        "batch_id",
        F.col("chunk").alias("idx"),
        F.get(F.element_at("levels", -1), F.lit(0)).alias("hash"),
        (F.lit(k) - F.size("levels") + 1).alias("missing"),
        "leaves",
        *sums,
        *(["ok"] if verify else []),
    )


def _largest(df: DataFrame) -> int:
    """Leaves of the largest batch; batches whose numbers show that their positions can't be dense are refused.

    Only numbers are combined, so nothing is gathered before the worst repeats are ruled out.
    """
    n, at = F.count(F.lit(1)), F.col("pos").cast("decimal(38,0)")
    per_batch = df.groupBy("batch_id").agg(
        n.alias("n"), F.count("pos").alias("placed"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.sum(at).alias("total")
    )
    size = F.col("n").cast("decimal(38,0)")
    fits = (F.col("placed") == F.col("n")) & (F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("total") * 2 == size * (size - 1))
    wrong = F.col("batch_id").isNull() | ~F.coalesce(fits, F.lit(False))
    found = per_batch.agg(F.max("n").alias("n"), F.count_if(wrong).alias("wrong"), F.min(F.when(wrong, F.col("batch_id"))).alias("batch")).first()
    if found["wrong"]:
        raise ValueError(f"positions not dense in {found['wrong']} batches, such as {found['batch']}: see position_faults")
    return found["n"] or 0


def _rounds(df: DataFrame, k: int, with_leaf: bool = False, sums: tuple[str, ...] = (), verify: bool = False) -> list[DataFrame]:
    """Folded chunks of every round; the last round has one chunk per batch."""
    left = _largest(df)
    leaf = [F.col("leaf")] if with_leaf else []
    nodes = df.select(
        "batch_id",
        F.col("pos").cast("bigint").alias("idx"),
        F.sha2("leaf", 256).alias("hash"),
        F.lit(0).alias("missing"),
        F.lit(1).cast("bigint").alias("leaves"),
        *leaf,
        *sums,
        *([F.lit(True).alias("ok")] if verify else []),
    )
    rounds = []
    while True:
        rounds.append(_chunks(nodes, k, k * len(rounds), sums, verify))
        left = -(-left // 2**k)
        if left <= 1:
            return rounds
        nodes = _roots(rounds[-1], k, sums, verify)


def position_faults(df: DataFrame) -> DataFrame:
    """Per batch (batch_id, pos): rows, and how many positions are null or negative, repeated, or left out below the largest."""
    each = df.groupBy("batch_id", "pos").agg(F.count(F.lit(1)).alias("n"))
    fine = F.col("pos") >= 0
    return each.groupBy("batch_id").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.coalesce(fine, F.lit(False)), 0).otherwise(F.col("n"))), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(fine, F.col("n") - 1)), F.lit(0)).alias("repeats"),
        F.coalesce(F.max(F.when(fine, F.col("pos"))) + 1 - F.count_if(fine), F.lit(0)).alias("gaps"),
    )


def folded_batches(df: DataFrame, k: int = K, sums: tuple[str, ...] = ()) -> DataFrame:
    """(batch_id, pos, leaf, sums...) -> root, leaf_count, all_leaf_proofs_valid and the sums per batch, all in one fold.

    Every audit path is followed: chunk by chunk, since the upper part of a path is that of its chunk's root.
    """
    top = _rounds(df, k, sums=sums, verify=True)[-1]
    root = F.get(F.element_at("levels", -1), F.lit(0))
    return top.select("batch_id", root.alias("root"), F.col("leaves").alias("leaf_count"), F.col("ok").alias("all_leaf_proofs_valid"), *sums)


def merkle_root(df: DataFrame, k: int = K) -> DataFrame:
    """(batch_id, pos, leaf) -> root and leaf count per batch.

    Positions must be dense from 0 and batches not null; anything else fails the job.
    """
    root = F.get(F.element_at("levels", -1), F.lit(0))
    return _rounds(df, k)[-1].select("batch_id", root.alias("root"), F.col("leaves").alias("leaf_count"))


def batch_roots(df: DataFrame, batches: DataFrame, k: int = K) -> DataFrame:
    """Root of every listed batch, also of those without leaves."""
    found = merkle_root(df, k)
    return batches.select("batch_id").join(found, "batch_id", "left").select(
        "batch_id",
        F.coalesce("root", empty_root()).alias("root"),
        F.coalesce("leaf_count", F.lit(0).cast("bigint")).alias("leaf_count"),
    )


def merkle_nodes(df: DataFrame, k: int = K) -> DataFrame:
    """Every node of every level: batch_id, level (0 = hashed leaves), pos, hash."""
    out = None
    for r, chunks in enumerate(_rounds(df, k)):
        base = r * k
        folded = (
            chunks.select("batch_id", "chunk", F.posexplode("levels").alias("j", "level_nodes"))
            .filter(F.col("j") > 0 if r else F.lit(True))
            .select("batch_id", "chunk", "j", F.posexplode("level_nodes").alias("i", "hash"))
            .select(
                "batch_id",
                (F.col("j") + base).alias("level"),
                F.expr(f"shiftleft(chunk, {k} - j) + i").alias("pos"),
                "hash",
            )
        )
        parts = [folded]
        if r:
            lifted = (
                chunks.select("batch_id", F.explode(F.filter("members", lambda m: F.size(m["path"]) > 1)).alias("m"))
                .select("batch_id", "m.idx", (F.size("m.path") - 1).alias("n"), F.posexplode("m.path").alias("t", "hash"))
                .filter("t > 0")
                .select(
                    "batch_id",
                    (F.lit(base) - F.col("n") + F.col("t")).alias("level"),
                    F.expr("shiftleft(idx, n - t)").alias("pos"),
                    "hash",
                )
            )
            parts.append(lifted)
        for part in parts:
            out = part if out is None else out.unionByName(part)
    return out


def _siblings(levels: Column, j: Column) -> Column:
    """Steps from node j of the lowest level to the top of its chunk."""

    def step(level: Column, height: Column) -> Column:
        at = F.call_function("shiftright", j, height)
        even = at.bitwiseAND(F.lit(1)) == 0
        return F.struct(
            F.when(even, F.coalesce(F.get(level, at + 1), F.get(level, at))).otherwise(F.get(level, at - 1)).alias("hash"),
            F.when(even, "right").otherwise("left").alias("position"),
        )

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step).cast(PROOF)


def _own_lifts(path: Column) -> Column:
    """Steps in which a node is its own right sibling."""
    steps = F.slice(path, F.lit(1), F.size(path) - 1)
    return F.transform(steps, lambda h: F.struct(h.alias("hash"), F.lit("right").alias("position"))).cast(PROOF)


def merkle_proofs(df: DataFrame, k: int = K) -> DataFrame:
    """Audit path per leaf: batch_id, pos, leaf, proof (bottom up), root.

    The upper part of a path is the same for all leaves of a chunk.  It is joined
    once per chunk, so the leaves are shuffled once, not once per level.
    """
    upper = None
    for chunks in reversed(_rounds(df, k, with_leaf=True)):
        if upper is None:
            joined = chunks.withColumn("_upper", F.array().cast(PROOF)).withColumn(
                "_root", F.get(F.element_at("levels", -1), F.lit(0))
            )
        else:
            above = upper.select(
                "batch_id", F.col("idx").alias("chunk"), F.col("proof").alias("_upper"), F.col("root").alias("_root")
            )
            joined = chunks.join(above.hint("shuffle_hash"), ["batch_id", "chunk"])
        leaf = "leaf" in chunks.schema["members"].dataType.elementType.names
        paths = F.transform(
            F.col("members"),
            lambda m, j: F.struct(
                m["idx"].alias("idx"),
                F.concat(_own_lifts(m["path"]), _siblings(F.col("levels"), j), F.col("_upper")).alias("proof"),
                *([m["leaf"].alias("leaf")] if leaf else []),
            ),
        )
        upper = joined.select("batch_id", F.col("_root").alias("root"), F.inline(paths))
    return upper.select("batch_id", F.col("idx").alias("pos"), "leaf", "proof", "root")


# --- verification ------------------------------------------------------------


def _follow(start: Column, steps: Column) -> Column:
    """Hash that the steps of a path lead to."""
    return F.aggregate(
        steps,
        start,
        lambda at, s: F.when(s["position"] == "left", pair_hash(s["hash"], at)).otherwise(pair_hash(at, s["hash"])),
    )


def proof_root(leaf: Column, proof: Column) -> Column:
    """Root that a leaf and its audit path lead to."""
    return _follow(F.sha2(leaf, 256), proof)


def verify_proofs(df: DataFrame) -> DataFrame:
    """Add ``valid`` to rows with leaf, proof and root."""
    return df.withColumn("valid", proof_root(F.col("leaf"), F.col("proof")) == F.col("root"))


def verify_batch(df: DataFrame, roots: DataFrame, k: int = K) -> DataFrame:
    """Rebuild every batch and compare with the claimed roots (batch_id, root).

    Every batch of either side is reported.  A claimed batch without leaves is rebuilt
    as the empty set; one that nobody claims has no match.  Leaves and claims
    that are not 64 characters long are counted first: such a batch is not rebuilt and not verified.
    """

    def odd(c):
        return F.when(F.coalesce(F.length(c) == DIGEST_LENGTH, F.lit(False)), 0).otherwise(1)

    leaves = df.select("batch_id", "pos", F.coalesce("leaf", F.lit("")).alias("leaf"), odd("leaf").cast("bigint").alias("_odd"))
    rebuilt = folded_batches(leaves, k, ("_odd",)).withColumnRenamed("root", "_root")
    claims = roots.select("batch_id", F.col("root").alias("claimed_root"), odd("root").alias("_odd_claim"))
    both = rebuilt.join(claims, "batch_id", "full_outer")
    bad = F.coalesce(F.col("_odd"), F.lit(0)) + F.coalesce(F.col("_odd_claim"), F.lit(0))
    usable = bad == 0
    root = F.when(usable, F.coalesce("_root", empty_root()))
    matches = F.coalesce(root == F.col("claimed_root"), F.lit(False))
    valid = usable & F.coalesce("all_leaf_proofs_valid", F.lit(True))
    return both.select(
        "batch_id",
        "claimed_root",
        root.alias("rebuilt_root"),
        F.coalesce("leaf_count", F.lit(0).cast("bigint")).alias("leaf_count"),
        bad.cast("bigint").alias("bad_digests"),
        matches.alias("root_rebuilt_matches"),
        valid.alias("all_leaf_proofs_valid"),
        (matches & valid).alias("verified"),
    )


def tamper_diff(a: DataFrame, b: DataFrame, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(roots per batch of two leaf sets and whether they differ, leaves that differ).

    Leaves are compared only in batches whose roots differ.
    """

    def roots(df, side):
        return merkle_root(df, k).select("batch_id", F.col("root").alias(f"root_{side}"))

    both = roots(a, "a").join(roots(b, "b"), "batch_id", "full_outer")
    summary = both.withColumn("roots_differ", ~F.col("root_a").eqNullSafe(F.col("root_b")))
    suspect = summary.filter("roots_differ").select("batch_id")

    def leaves(df, side):
        return df.join(suspect, "batch_id", "left_semi").select("batch_id", "pos", F.col("leaf").alias(f"leaf_{side}"))

    change = (
        F.when(F.col("leaf_a").isNull(), "added").when(F.col("leaf_b").isNull(), "removed").otherwise("changed")
    )
    changed = (
        leaves(a, "a")
        .join(leaves(b, "b"), ["batch_id", "pos"], "full_outer")
        .filter(~F.col("leaf_a").eqNullSafe(F.col("leaf_b")))
        .withColumn("change", change)
    )
    return summary, changed


def tamper_locate(nodes_a: DataFrame, nodes_b: DataFrame, k: int = K, height: int | None = None) -> DataFrame:
    """Differing leaves of two stored node tables, found from the top down.

    Every k-th level is compared, and below it only the children of nodes that
    differ.  The frontier is as small as the tampering, so the big lower levels
    are semi-joined with it instead of being compared whole.  Tables stored by
    level (``write_tables``) are read level by level.
    """
    if height is None:
        levels = nodes_a.select("level").unionByName(nodes_b.select("level"))
        height = levels.agg(F.max("level")).first()[0] or 0

    def differing(a, b, *keys):
        both = a.withColumnRenamed("hash", "hash_a").join(b.withColumnRenamed("hash", "hash_b"), list(keys), "full_outer")
        return both.filter(~F.col("hash_a").eqNullSafe(F.col("hash_b")))

    def top(nodes):
        """Root of every batch: the hash on its highest level."""
        first = nodes.filter("pos = 0").select("batch_id", "level", "hash")
        highest = first.groupBy("batch_id").agg(F.max("level").alias("level"))
        return first.join(highest, ["batch_id", "level"]).select("batch_id", "hash")

    # trees of different height do not meet at their tops, so a batch whose roots
    # differ stays in the frontier with its first subtree
    start = differing(top(nodes_a), top(nodes_b), "batch_id").select("batch_id", F.lit(0).cast("bigint").alias("parent"))
    frontier = start
    for level in range(height // k * k, -1, -k):

        def children(nodes, level=level, frontier=frontier):
            here = nodes.filter(F.col("level") == level).withColumn("parent", F.shiftright("pos", k))
            return here.join(frontier, ["batch_id", "parent"], "left_semi").select("batch_id", "pos", "hash")

        found = differing(children(nodes_a), children(nodes_b), "batch_id", "pos")
        frontier = found.select("batch_id", F.col("pos").alias("parent")).unionByName(start).distinct()
    return found
