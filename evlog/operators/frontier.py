"""Merkle trees that grow: append leaves without the old ones, and proofs that an old root is a prefix of a new tree.

The frontier of a tree of n leaves has a peak for each set bit of n: the root of a complete subtree, which no later leaf
changes. At level l it is the node at position (n >> l) - 1. Count and peaks give the root, and new leaves are folded
against them: the first new node of a level has the position n >> l, and where that is odd its left neighbour is the peak.

The first new leaf's audit path in the new tree has just these peaks as left neighbours. So that path is the
proof of consistency: folded alone the peaks give the old root, along the path they give the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlog.functions.text import kept, let
from evlog.operators.merkle import K, empty_root, pair_hash, paired_level

PEAKS = "map<int,string>"
STEPS = "array<struct<hash:string,position:string>>"


def _shift(number: Column, by: Column) -> Column:
    return F.call_function("shiftright", number, by.cast("int"))


def _bit(number: Column, level: Column) -> Column:
    return _shift(number, level).bitwiseAND(F.lit(1)) == 1


def tree_height(count: Column) -> Column:
    """Levels above the hashed leaves."""
    return F.when(count <= 1, 0).otherwise(F.length(F.bin(count - 1)))


def frontier_root(count: Column, peaks: Column) -> Column:
    """Root of the tree whose peaks these are; the last node of an odd level is paired with itself. No leaves: the empty root."""

    def up(last: Column, level: Column) -> Column:
        """The last node of the next level, as far as it is incomplete; null while all nodes are complete."""
        peak = F.try_element_at(peaks, level)
        left = F.coalesce(peak, last)  # nothing to the left: paired with itself
        right = F.coalesce(last, peak)
        return F.when(_bit(count, level) | last.isNotNull(), pair_hash(left, right))

    height = tree_height(count)
    folded = F.aggregate(F.sequence(F.lit(0), height - 1), F.lit(None).cast("string"), up)
    return F.when(count == 0, empty_root()).when(count == 1, F.try_element_at(peaks, F.lit(0))).otherwise(F.coalesce(folded, F.try_element_at(peaks, height)))


def _levels_of(count: Column) -> Column:
    """Levels of the peaks."""
    all_levels = F.sequence(F.lit(0), tree_height(count))
    return F.filter(all_levels, lambda level: _bit(count, level))


def _collected(rows: DataFrame) -> DataFrame:
    """(batch_id, level, hash) -> (batch_id, peaks); a batch has 63 peaks at most."""
    return rows.groupBy("batch_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("level").cast("int"), "hash"))).alias("peaks"))


def merkle_frontier(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """(batch_id, leaf_count, peaks) from stored nodes (batch_id, level, pos, hash) and the counts (batch_id, leaf_count).

    Reads one node for each set bit of a count. A batch without leaves has no peaks; a missing node fails the job.
    """
    at = counts.select("batch_id", "leaf_count", F.explode(_levels_of(F.col("leaf_count"))).alias("level"))
    at = at.select("batch_id", F.col("level").alias("_level"), (_shift(F.col("leaf_count"), F.col("level")) - 1).alias("_pos"))
    met = at.join(nodes, (at["batch_id"] == nodes["batch_id"]) & (F.col("_level") == nodes["level"]) & (F.col("_pos") == nodes["pos"]))
    found = _collected(met.select(at["batch_id"], F.col("_level").alias("level"), "hash"))
    joined = counts.select("batch_id", "leaf_count").join(found, "batch_id", "left")
    peaks = F.coalesce("peaks", F.create_map().cast(PEAKS))
    missing = F.raise_error(F.concat(F.lit("stored nodes lack a peak of batch "), F.col("batch_id").cast("string"))).cast(PEAKS)
    return joined.withColumn("peaks", F.when(F.size(peaks) == F.bit_count("leaf_count"), peaks).otherwise(missing))


def with_root(frontier: DataFrame) -> DataFrame:
    return frontier.withColumn("root", frontier_root(F.col("leaf_count"), F.col("peaks")))


def _grown(frontier: DataFrame, leaves: DataFrame) -> DataFrame:
    """(batch_id, old, total, peaks, fits) of every batch of either table."""
    at = F.col("pos").cast("decimal(38,0)")
    new = leaves.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count("pos").alias("_placed"), F.min("pos").alias("_first"), F.max("pos").alias("_last"), F.sum(at).alias("_sum")
    )
    both = new.join(frontier.select("batch_id", "leaf_count", "peaks"), "batch_id", "full_outer")
    old, n = F.coalesce("leaf_count", F.lit(0).cast("long")), F.coalesce("_n", F.lit(0).cast("long"))
    size = n.cast("decimal(38,0)")
    dense = (F.col("_placed") == n) & (F.col("_first") == old) & (F.col("_last") == old + n - 1) & (F.col("_sum") * 2 == size * (2 * old + n - 1))
    fits = F.col("batch_id").isNotNull() & ((n == 0) | F.coalesce(dense, F.lit(False)))
    return both.select("batch_id", old.alias("old"), (old + n).alias("total"), F.coalesce("peaks", F.create_map().cast(PEAKS)).alias("peaks"), fits.alias("fits"))


def merkle_append(frontier: DataFrame, leaves: DataFrame, k: int = K) -> tuple[DataFrame, DataFrame]:
    """New nodes and the new frontier after ``leaves`` (batch_id, pos, leaf) are put behind the trees of ``frontier``.

    Positions go on from each batch's count, dense; anything else is refused. A batch without a frontier is new, one without leaves
    stays. The nodes (batch_id, level, pos, hash) are all that are new or changed: those of the new leaves and the right edge
    above them, which replace stored nodes of the same place. Old leaves and nodes are not read, only the peaks.
    Chunks of 2^k nodes are folded in a row each, as for a whole tree.
    """
    grown = _grown(frontier, leaves)
    worst = grown.agg(F.max(F.when(F.col("total") > F.col("old"), tree_height(F.col("total")))).alias("height"), F.min(F.when(~F.col("fits"), F.coalesce(F.col("batch_id").cast("string"), F.lit("null")))).alias("wrong")).first()
    if worst["wrong"] is not None:
        raise ValueError(f"positions of batch {worst['wrong']} don't go on from its count")
    info = grown.select("batch_id", F.col("old").alias("_old"), F.col("total").alias("_total"), F.col("peaks").alias("_peaks"))
    level = leaves.select("batch_id", F.col("pos").cast("long").alias("idx"), F.sha2("leaf", 256).alias("hash"))
    nodes = None
    for r in range((worst["height"] or 0) // k + 1):
        chunks = _fold_chunks(level, info, k, k * r)
        # the top of a full round is the first level of the next one
        shown = F.when(F.col("steps") < k, F.col("levels")).otherwise(F.slice("levels", 1, k))
        found = chunks.select("batch_id", "start", F.posexplode(shown).alias("_l", "_hashes"))
        found = found.select("batch_id", (F.lit(k * r) + F.col("_l")).alias("level"), _shift(F.col("start"), F.col("_l")).alias("_from"), F.posexplode("_hashes").alias("_j", "hash"))
        found = found.select("batch_id", "level", (F.col("_from") + F.col("_j")).alias("pos"), "hash")
        nodes = found if nodes is None else nodes.unionByName(found)
        level = chunks.filter(F.col("steps") == k).select("batch_id", F.col("chunk").alias("idx"), F.get(F.element_at("levels", -1), F.lit(0)).alias("hash"))
    edge = nodes.join(info, "batch_id").filter(_bit(F.col("_total"), F.col("level")) & (F.col("pos") == _shift(F.col("_total"), F.col("level")) - 1))
    own = _collected(edge.select("batch_id", "level", "hash")).withColumnRenamed("peaks", "_new")
    same = F.map_filter("_peaks", lambda at, _: _shift(F.col("_total"), at) == _shift(F.col("_old"), at))
    after = info.join(own, "batch_id", "left").select("batch_id", F.col("_total").alias("leaf_count"), F.map_concat(same, F.coalesce("_new", F.create_map().cast(PEAKS))).alias("peaks"))
    return nodes, after


def _fold_chunks(level: DataFrame, info: DataFrame, k: int, height: int) -> DataFrame:
    """(batch_id, chunk, start, steps, levels): nodes (batch_id, idx, hash) of one level, folded up to k levels in chunks.

    ``start`` is the position of a chunk's first node. A chunk that begins amid old nodes takes their peaks as left neighbours.
    """
    grouped = level.groupBy("batch_id", F.shiftright("idx", k).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("_m"))
    met = grouped.join(info, "batch_id")
    begin = F.shiftleft("chunk", k)
    start = F.greatest(begin, F.shiftright("_old", height))
    end = F.least(begin + (1 << k), F.shiftright(F.col("_total") - 1, height) + 1)
    dense = (F.size("_m") == end - start) & F.forall(F.transform("_m", lambda m, j: m["idx"] == start + j), lambda x: x)
    message = F.concat(F.lit("positions not dense in batch "), F.col("batch_id").cast("string"))
    hashes = F.when(dense, F.transform("_m", lambda m: m["hash"])).otherwise(F.raise_error(message).cast("array<string>"))
    steps = F.greatest(F.least(F.lit(k), tree_height(F.col("_total")) - height), F.lit(0))
    staged = met.select("batch_id", "chunk", start.alias("start"), steps.alias("steps"), "_peaks", kept(hashes).alias("_hashes"))

    def up(levels: Column, at: Column) -> Column:
        top = F.element_at(levels, -1)
        peak = F.array(F.try_element_at(F.col("_peaks"), at + height))
        whole = F.when(_bit(F.col("start"), at), F.concat(peak, top)).otherwise(top)
        return F.concat(levels, F.array(let(whole, paired_level)))

    folded = F.when(F.col("steps") > 0, F.aggregate(F.sequence(F.lit(0), F.col("steps") - 1), F.array("_hashes"), up)).otherwise(F.array("_hashes"))
    return staged.select("batch_id", "chunk", "start", "steps", kept(folded).alias("levels"))


# --- consistency -------------------------------------------------------------


def consistency_proofs(nodes: DataFrame, claims: DataFrame) -> DataFrame:
    """(batch_id, old_count, new_count, first, proof) for claims (batch_id, old_count, new_count), from the new tree's nodes.

    ``first`` is the hashed first new leaf and ``proof`` its audit path, bottom first; both are null where nothing was
    added, where there was nothing before, or where old_count is over new_count. Reads a node for each level.
    """
    old, new = F.col("old_count"), F.col("new_count")
    asked = claims.select("batch_id", "old_count", "new_count").distinct().filter((old > 0) & (old < new))
    levels = F.sequence(F.lit(0), tree_height(new) - 1)

    def place(level: Column) -> Column:
        at = _shift(old, level)
        last = _shift(new - 1, level)
        sibling = F.least(at.bitwiseXOR(F.lit(1).cast("long")), last)
        return F.struct(level.alias("level"), sibling.alias("pos"), F.when(_bit(old, level), "left").otherwise("right").alias("position"), F.lit(False).alias("own"))

    own = F.struct(F.lit(0).alias("level"), old.alias("pos"), F.lit("own").alias("position"), F.lit(True).alias("own"))
    wanted = asked.withColumn("_w", F.explode(F.concat(F.array(own), F.transform(levels, place))))
    wanted = wanted.select("batch_id", "old_count", "new_count", F.col("_w.level").alias("_level"), F.col("_w.pos").alias("_pos"), "_w.position", "_w.own")
    met = wanted.join(nodes, (wanted["batch_id"] == nodes["batch_id"]) & (F.col("_level") == nodes["level"]) & (F.col("_pos") == nodes["pos"]))
    step = F.struct(F.col("_level").alias("level"), "hash", "position")
    found = met.groupBy(wanted["batch_id"], "old_count", "new_count").agg(
        F.max(F.when(F.col("own"), F.col("hash"))).alias("first"), F.sort_array(F.collect_list(F.when(~F.col("own"), step))).alias("_steps")
    )
    proof = F.transform("_steps", lambda s: F.struct(s["hash"].alias("hash"), s["position"].alias("position")))
    found = found.select("batch_id", "old_count", "new_count", "first", proof.alias("proof"))
    return claims.select("batch_id", "old_count", "new_count").distinct().join(found, ["batch_id", "old_count", "new_count"], "left")


def verify_consistency(proofs: DataFrame) -> DataFrame:
    """Add ``valid`` to proofs with old_root and new_root: whether the old tree is a prefix of the new one.

    The path's sides follow from the counts, a neighbour beyond the end must repeat its node, the left neighbours must fold to the old
    root, and the path to the new one. Equal counts need equal roots; an empty old tree is a prefix of any.
    """
    old, new, steps = F.col("old_count"), F.col("new_count"), F.col("proof")

    def follow(state: Column, level: Column) -> Column:
        step, node = F.get(steps, level), state["node"]
        at = _shift(old, level)
        left = _bit(old, level)
        alone = ~left & (at == _shift(new - 1, level))
        fits = (step["position"] == F.when(left, "left").otherwise("right")) & (~alone | (step["hash"] == node))
        above = F.when(left, pair_hash(step["hash"], node)).otherwise(pair_hash(node, step["hash"]))
        return F.struct(above.alias("node"), (state["ok"] & F.coalesce(fits, F.lit(False))).alias("ok"))

    height = tree_height(new)
    start = F.struct(F.col("first").alias("node"), F.lit(True).alias("ok"))
    walked = F.aggregate(F.sequence(F.lit(0), height - 1), start, follow)
    kept_levels = F.filter(F.sequence(F.lit(0), height - 1), lambda level: _bit(old, level))
    peaks = F.map_from_arrays(kept_levels, F.transform(kept_levels, lambda level: F.get(steps, level)["hash"]))
    prefix = let(walked, lambda w: w["ok"] & (w["node"] == F.col("new_root"))) & (F.size(steps) == height) & (frontier_root(old, peaks) == F.col("old_root"))
    valid = (
        F.when(old > new, F.lit(False))
        .when(old == new, F.col("old_root") == F.col("new_root"))
        .when(old == 0, F.col("old_root") == empty_root())
        .when(steps.isNull() | F.col("first").isNull() | (F.size(steps) != height), F.lit(False))
        .otherwise(prefix)
    )
    return proofs.withColumn("valid", F.coalesce(valid, F.lit(False)))
