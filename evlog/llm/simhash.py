"""SimHash near-duplicates: fingerprints are sharded by vantage-point trees and linked exactly within Hamming shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, join_hot, row_key, stored, texts_of

SHINGLE, RADIUS = 4, 4
#: Wide fingerprints have four words; they tell how similar two texts are, not only that they are almost equal: at a Jaccard
#: similarity of 0.8 two texts differ in 39 of 256 bits on average (2 J / (1 + J) is the cosine, its angle the share of bits).
WIDE_WORDS, WIDE_RADIUS = 4, 40
#: Bits of a group, each of which has a tree; prints that a shard should hold; most prints that the trees are fitted on.
GROUP, SHARD, SAMPLE = 16, 40_000, 20_000
PAIRS_AT_ONCE = 1 << 20


# ---- fingerprints ---------------------------------------------------------------------------------------------------


def fingerprint(text: str | None, shingle: int = SHINGLE, words: int = 1) -> bytes:
    """Little-endian fingerprint of a whole text, 64 bits a word: a bit is set if it is set in over half of the shingles' hashes."""
    import xxhash

    tokens = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z, and only ASCII white space
    if not tokens:
        return bytes(8 * words)
    grams = [b" ".join(tokens[i : i + shingle]) for i in range(max(1, len(tokens) - shingle + 1))]
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(grams), 1 << 15):
        part = grams[at : at + (1 << 15)]
        if words == 1:
            hashes = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in part), np.dtype("<u8"), len(part)).view(np.uint8)
        else:
            hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(g, seed) for g in part for seed in range(words // 2)]), np.uint8)
        counts += np.unpackbits(hashes.reshape(len(part), 8 * words), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(grams), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """id, _row (key of the row's id and text), _bits (the fingerprint) and _fp: its bits as a long, or of wide ones a hash."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            bits = [fingerprint(t, shingle, words) for t in texts_of(batch, text_col)]
            fp = [int.from_bytes(b, "little") if words == 1 else xxhash.xxh3_64_intdigest(b) for b in bits]
            names = [id_col, "_row", "_bits", "_fp"]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("_row"), pa.array(bits, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64))], names=names)

    rows = docs.select(id_col, text_col, row_key(id_col, text_col).alias("_row"))
    return rows.mapInArrow(compute, f"{id_col} {id_type}, _row struct<a:bigint,b:bigint>, _bits binary, _fp long")


def words_of(column: pa.Array, words: int) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, words)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, word by word."""
    total = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    for w in range(1, a.shape[-1]):
        total += np.bitwise_count(a[..., w] ^ b[..., w])
    return total


# ---- vantage-point trees ----------------------------------------------------------------------------------------------


def group_values(prints: np.ndarray, group: int) -> np.ndarray:
    """The bits of one group of each print.

    Of g groups, two prints that differ in at most 2 g - 1 bits differ in at most one bit of some group: 7 of 64 bits, 31 of
    256. Beyond that a pair may be missed, if every group differs in two bits: for 40 of 256 bits about one pair in 200.
    """
    per_word = 64 // GROUP
    return prints[:, group // per_word] >> np.uint64(GROUP * (group % per_word)) & np.uint64((1 << GROUP) - 1)


def grow(values: np.ndarray, depth: int, rng: np.random.Generator) -> list[tuple[int, int]]:
    """A vantage-point tree over a sample: node i has (vantage, median distance), its children are 2i + 1 and 2i + 2."""
    nodes: list[tuple[int, int]] = []
    parts = [values]
    for _ in range(depth):
        below = []
        for part in parts:
            vantage = int(part[rng.integers(len(part))]) if len(part) else 0
            far = np.bitwise_count(part ^ np.uint64(vantage))
            cut = int(np.median(far)) if len(part) else 0
            nodes.append((vantage, cut))
            below += [part[far <= cut], part[far > cut]]
        parts = below
    return nodes


def visits(nodes: list[tuple[int, int]], depth: int, values: np.ndarray, radius: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, rows, home): the rows that a leaf holds, and those whose ball reaches it past the bounds of all its branches."""
    out = []

    def down(node: int, level: int, rows: np.ndarray, home: np.ndarray) -> None:
        if not len(rows):
            return
        if level == depth:
            out.append((node - ((1 << depth) - 1), rows, home))
            return
        vantage, cut = nodes[node]
        far = np.bitwise_count(values[rows] ^ np.uint64(vantage)).astype(np.int16)
        near = far - radius <= cut  # triangle bound: a partner may lie inside
        down(2 * node + 1, level + 1, rows[near], home[near] & (far[near] <= cut))
        away = far + radius > cut  # or outside
        down(2 * node + 2, level + 1, rows[away], home[away] & (far[away] > cut))

    down(0, 0, np.arange(len(values)), np.ones(len(values), bool))
    return out


# ---- links inside one shard ----------------------------------------------------------------------------------------------


class Parts:
    """Components of numbered points, by joins of equal-length arrays of ends."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


def linked(prints: np.ndarray, home: np.ndarray, group: int, radius: int) -> np.ndarray:
    """Component label of each print of a shard. Compared are those whose group values differ in one bit at most."""
    values = group_values(prints, group)
    order = np.argsort(values, kind="stable")
    prints, values, home = prints[order], values[order], home[order]
    keys, first, size = np.unique(values, return_index=True, return_counts=True)
    parts = Parts(len(prints))
    for flip in [0, *(1 << b for b in range(GROUP))]:
        other = keys ^ np.uint64(flip)
        at = np.searchsorted(keys, other)
        found = at < len(keys)
        found[found] = keys[at[found]] == other[found]
        a = np.flatnonzero(found)
        b = at[a]
        a, b = a[a <= b], b[a <= b]
        work = size[a].astype(np.int64) * size[b]
        big = work > PAIRS_AT_ONCE
        for i, j in zip(a[big], b[big]):
            link_blocks(prints, parts, np.arange(first[i], first[i] + size[i]), np.arange(first[j], first[j] + size[j]), radius)
        a, b, work = a[~big], b[~big], work[~big]
        edge = np.searchsorted(np.cumsum(work), np.arange(0, work.sum() + PAIRS_AT_ONCE, PAIRS_AT_ONCE))
        for lo, hi in zip(edge[:-1], edge[1:]):
            if lo == hi and hi == len(work):
                continue
            hi = min(len(work), hi + 1)  # a batch may repeat its last pair of buckets: joining twice is harmless
            w = work[lo:hi]
            which = np.repeat(np.arange(lo, hi), w)
            k = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            x, y = first[a[which]] + k // size[b[which]], first[b[which]] + k % size[b[which]]
            some = (home[x] | home[y]) & (x < y if flip == 0 else True)
            x, y = x[some], y[some]
            near = apart(prints[x], prints[y]) <= radius
            parts.join(x[near], y[near])
    label = np.empty(len(order), np.int64)
    label[order] = order[parts.label]
    return label


def link_blocks(prints: np.ndarray, parts: Parts, a: np.ndarray, b: np.ndarray, radius: int) -> None:
    """Two large buckets against each other; points already in a block's only component are passed over."""
    block = max(1, min(1024, PAIRS_AT_ONCE // max(1, len(b))))
    a = a[np.argsort(parts.label[a], kind="stable")]
    at = 0
    while at < len(a):
        rows = a[at : at + block]
        at += len(rows)
        labels = np.unique(parts.label[rows])
        rest = b[parts.label[b] != labels[0]] if len(labels) == 1 else b
        for lo in range(0, len(rest), max(1, PAIRS_AT_ONCE // block)):
            cols = rest[lo : lo + max(1, PAIRS_AT_ONCE // block)]
            x, y = np.nonzero(apart(prints[rows][:, None, :], prints[cols][None, :, :]) <= radius)
            parts.join(rows[x], cols[y])


# ---- the whole table --------------------------------------------------------------------------------------------------------


def links(prints: DataFrame, total: int, radius: int = RADIUS, words: int = 1, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Links (a, b) between distinct prints (_fp, _bits): a forest per shard whose components are those of all near pairs.

    A near pair differs in one bit at most of some group of bits (``group_values``). Each group has a vantage-point tree,
    fitted on a bounded sample; a print goes to its own leaf and to those its ball reaches. A leaf with far more
    prints than ``shard`` is cut into blocks, and each pair of blocks is a task of its own.
    """
    depth = min(14, max(0, int(np.ceil(np.log2(max(1, total) / shard)))))
    some = bounded_sample(prints, sample, total, "_fp") if depth else prints.limit(1)
    rows = [bytes(r[0]) for r in some.select("_bits").collect()]
    sampled, groups, rng = np.frombuffer(b"".join(rows), "<u8").reshape(-1, words), 64 * words // GROUP, np.random.default_rng(7)
    trees = [grow(group_values(sampled, g), depth, rng) for g in range(groups)]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words_of(batch.column("_bits"), words)
            for g in range(groups):
                for leaf, at, home in visits(trees[g], depth, group_values(found, g), 1):
                    take = pa.array(at)
                    columns = [pa.array(np.full(len(at), g << 20 | leaf, np.int32)), batch.column("_fp").take(take), batch.column("_bits").take(take), pa.array(home)]
                    yield pa.RecordBatch.from_arrays(columns, names=["leaf", "_fp", "_bits", "home"])

    routed = prints.select("_fp", "_bits").mapInArrow(route, "leaf int, _fp long, _bits binary, home boolean")
    # leaves that hold far more than the others are told by the sample; that steers the size of tasks only
    held: dict[int, float] = {}
    for g in range(groups if depth else 0):
        for leaf, at, _ in visits(trees[g], depth, group_values(sampled, g), 1):
            held[g << 20 | leaf] = len(at) * total / len(sampled)
    large = {leaf: int(-(-n // (2 * shard))) for leaf, n in held.items() if n > 4 * shard}
    if large:
        blocks = F.coalesce(F.create_map(*[F.lit(x) for kv in large.items() for x in kv])[F.col("leaf")], F.lit(1))
        own = F.pmod(F.xxhash64("_fp", F.lit(1)), F.col("_n")).cast("int")
        routed = routed.withColumn("_n", blocks).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        routed = routed.withColumn("pair", F.least("_own", "_other") * F.col("_n") + F.greatest("_own", "_other"))
    else:
        routed = routed.withColumn("pair", F.lit(0))

    def search(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        fp = rows.column("_fp").to_numpy()
        label = linked(words_of(rows.column("_bits"), words), rows.column("home").to_numpy(zero_copy_only=False).astype(bool), key[0].as_py() >> 20, radius)
        other = label != np.arange(len(label))
        return pa.table({"a": fp[other], "b": fp[label[other]]})

    return routed.select("leaf", "pair", "_fp", "_bits", "home").groupBy("leaf", "pair").applyInArrow(search, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.

    Large-star and small-star turns: each links a node's neighbours to its smallest one. Minima are pre-aggregated, and
    the edges of each turn are written to the shared folder, so lineage stays short.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    seen = None
    while True:
        now = stored(now)
        n, total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == 0 or (n, total) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = (n, total)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("_n"))
        large = join_hot(both, least, "u", "_n", 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, words: int = 1) -> DataFrame:
    """id, _row, fingerprint (16 hex digits a word), component_id and _root (its key) of every row of ``docs``.

    Fingerprints within ``radius`` bits are linked; component_id is the smallest id of all rows reachable. Equal
    fingerprints are one node, so groups of copies cost no pairs. A null or wordless text has fingerprint zero, linked
    like any other. Rows with a null id take part and get the smallest other id of their component (null if there is
    none); repeated rows are each returned; other columns are left out; an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle, words))
    prints = stored(rows.groupBy("_fp", "_bits").agg(F.min(id_col).alias("_least"), F.count("*").alias("_n")))
    total, documents = prints.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    roots = components(links(prints, total, radius, words))
    labelled = prints.join(roots, F.col("_fp") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_fp")).drop("node", "root")
    least = labelled.groupBy("_root").agg(F.min("_least").alias("component_id"), F.count("*").alias("_prints"))
    labelled = stored(join_hot(labelled, least, "_root", "_prints", total).select("_fp", "_n", "_root", "component_id"))
    grouped = join_hot(rows, labelled, "_fp", "_n", documents)
    fingerprint_text = F.lower(F.lpad(F.hex("_fp"), 16, "0")) if words == 1 else F.lower(F.hex("_bits"))
    return grouped.select(id_col, "_row", fingerprint_text.alias("fingerprint"), "component_id", "_root")


# ---- one row of each group --------------------------------------------------------------------------------------------------


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, one of each component of ``near_duplicates``: that with the smallest id, and of repeated rows one.

    Null ids come after all others; wordless texts are one component; all columns stay, and an empty table stays empty.
    """
    found = near_duplicates(docs, id_col, text_col, shingle, radius)
    rank = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("_row"))
    best = found.groupBy("_root").agg(F.min(rank).alias("_best")).select(F.col("_best._row").alias("_llm_row")).distinct()
    kept = docs.withColumn("_llm_row", row_key(id_col, text_col)).join(best, "_llm_row", "left_semi")
    repeated = found.groupBy("_row").count().filter("count > 1").select(F.col("_row").alias("_llm_row"), F.lit(True).alias("_llm_again"))
    kept = kept.join(repeated, "_llm_row", "left")
    one = kept.filter(F.col("_llm_again").isNull()).unionByName(kept.filter(F.col("_llm_again")).dropDuplicates(["_llm_row"]))
    return one.select(docs.columns)
