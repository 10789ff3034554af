"""Approximate nearest neighbours by an inverted multi-index: two quantised halves, cells visited by a heap, exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded_sample, join_hot, stored

#: Vectors that codebooks and scanned share are fitted on, most codewords of each half, distinct vectors that a cell should hold.
SAMPLE, CODEWORDS, CELL = 20_000, 256, 4
#: Recall that the scanned share is fitted for, queries it is measured with, and entries that are scanned at least.
RECALL, TRIALS, LEAST = 0.95, 300, 4_000
#: Distinct vectors of a block of cells, which one task ranks: at least, and as a part of all; distances computed at once.
CHUNK, BLOCKS, AT_ONCE = 2_000, 2_048, 2_000_000


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """_id and _v of the rows that take part: id and vector not null, all components finite, not all zero."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("_id"), v.alias("_v")).filter("_id is not null and size(_v) > 0")
    fine = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.coalesce(fine, F.lit(False))).filter(F.exists("_v", lambda x: x != 0))


def codebook(points: np.ndarray, k: int, rng: np.random.Generator, turns: int = 15) -> np.ndarray:
    """k-means centroids, started from random points; a centroid that loses its points takes a random one."""
    points = np.unique(points, axis=0)
    if len(points) <= k:
        return points
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(turns):
        near = nearest(points, centres)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], points[rng.integers(len(points), size=k)])
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None, :], 0)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[distances(points[at : at + 4096], centres).argmin(1) for at in range(0, len(points), 4096)]])


def traverse(left: np.ndarray, right: np.ndarray, size: np.ndarray, enough: int) -> list[int]:
    """Cells (i * len(right) + j) by growing left[i] + right[j], until they hold ``enough`` entries; empty ones are passed."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, seen, cells, held = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(right) + int(b[j])
        if size[cell]:
            cells.append(cell)
            held += int(size[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (left[a[x]] + right[b[y]], x, y))
    return cells


def fitted_share(points: np.ndarray, books: tuple[np.ndarray, np.ndarray], k: int, recall: float, rng: np.random.Generator) -> float:
    """Share of all entries that cells must hold to keep ``recall`` of the k nearest, measured by brute force on the sample."""
    n, half = len(points), books[0].shape[1]
    if n <= k + 1:
        return 1.0
    asked = rng.choice(n, min(TRIALS, n), replace=False)
    far = distances(points[asked], points)
    far[np.arange(len(asked)), asked] = np.inf
    true = np.argpartition(far, k, axis=1)[:, :k]
    cell = nearest(points[:, :half], books[0]) * len(books[1]) + nearest(points[:, half:], books[1])
    size = np.bincount(cell, minlength=len(books[0]) * len(books[1]))
    needed = []
    for i, row in enumerate(asked):
        left, right = distances(points[row : row + 1, :half], books[0])[0], distances(points[row : row + 1, half:], books[1])[0]
        order = np.argsort((left[:, None] + right[None, :]).ravel(), kind="stable")
        before = np.empty(len(order))
        before[order] = np.cumsum(size[order]) - size[order]
        needed.append(before[cell[true[i]]])
    return float(min(1.0, (np.quantile(np.concatenate(needed), recall) + 1) / n))


def laid_out(size: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: neighbouring cells share a block, a large one gets several."""
    first, parts = np.zeros(len(size), np.int64), np.maximum(1, -(-size // chunk))
    block = held = 0
    for cell, n in enumerate(size):
        if held and (held + n > chunk):
            block, held = block + 1, 0
        first[cell] = block
        held += n
        if parts[cell] > 1:
            block, held = block + parts[cell], 0
    return first, parts


def matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(column) else np.zeros((0, width))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", most_codewords: int = CODEWORDS, recall: float = RECALL, share: float | None = None, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of ``queries`` (rows of the same table), itself left out.

    Each half of a vector is quantised by a codebook fitted on a bounded sample; all vectors are indexed by their pair of
    codewords. A query visits cells by growing summed distance until they hold ``share`` of the distinct vectors
    (``least`` at least), and the entries are ranked by their exact Euclidean distance in double precision, ties to
    the smaller id. Without a share, that which keeps ``recall`` on the sample is taken. Equal vectors are one entry with its k + 1 smallest ids, which is all a query can return, so groups of
    copies of any size cost one entry; entries are ranked by blocks of cells, and large cells are dealt out to several.
    Rows with a null id, or a vector that is null, empty, zero, of another length than the most frequent, or has null or non-finite components take no part,
    on either side. A repeated query id is asked once for each different vector; rows repeating an id and vector are
    one candidate. Other columns are left out; without candidates there are no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    width = rows.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    schema = f"query_id {vectors.schema[id_col].dataType.simpleString()}, rank int, vec_id {vectors.schema[id_col].dataType.simpleString()}, score double"
    if not width:
        return spark.createDataFrame([], schema)
    dim = width[0].n
    half = dim // 2
    rows = rows.filter(F.size("_v") == dim)
    key = F.xxhash64("_v")
    # ids of equal vectors: ranked in two steps, so that no task gets all copies of one vector
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(32))).distinct()
    local = salted.withColumn("_r", F.row_number().over(Window.partitionBy("_v", "_salt").orderBy("_id"))).filter(F.col("_r") <= k + 1)
    entries = local.groupBy("_v").agg(F.slice(F.sort_array(F.collect_list("_id")), 1, k + 1).alias("_ids")).withColumn("_key", key)
    count = rows.count()
    sampled = np.array([r["_v"] for r in bounded_sample(rows, SAMPLE, count, "_id", "_v").collect()]).reshape(-1, dim)
    rng = np.random.default_rng(11)
    codewords = int(min(most_codewords, max(4, round((count / CELL) ** 0.5))))
    books = codebook(sampled[:, :half], codewords, rng), codebook(sampled[:, half:], codewords, rng)
    across = len(books[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("_v"), dim)
            cell = nearest(v[:, :half], books[0]) * across + nearest(v[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["_v", "_ids", "_key", "_cell"])

    id_type = vectors.schema[id_col].dataType.simpleString()
    entries = stored(entries.mapInArrow(assign, f"_v array<double>, _ids array<{id_type}>, _key long, _cell int"))
    cells = entries.groupBy("_cell").count().collect()  # at most codewords squared rows
    size = np.zeros(len(books[0]) * across, np.int64)
    for r in cells:
        size[r["_cell"]] = r["count"]
    total = int(size.sum())
    if share is None:
        share = fitted_share(sampled, books, k, recall, rng)
    enough = min(total, max(least, int(np.ceil(share * total))))
    first, parts = laid_out(size, max(CHUNK, total // BLOCKS))

    asked = usable(queries, id_col, vector_col).filter(F.size("_v") == dim).distinct()
    asked = asked.withColumn("_q", F.concat(F.hex(F.xxhash64("_v")), F.lit("."), F.hex(F.xxhash64("_v", F.lit(1)))))
    questions = asked.groupBy("_v", "_q").agg(F.count("*").alias("_n"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                v = matrix(part.column("_v"), dim)
                left, right = distances(v[:, :half], books[0]), distances(v[:, half:], books[1])
                row, block, cells = [], [], []
                for i in range(len(v)):
                    visited = np.array(sorted(traverse(left[i], right[i], size, enough)), np.int32)
                    at = first[visited]
                    edge = np.flatnonzero(np.diff(at, prepend=-1, append=-1))
                    for lo_, hi in zip(edge[:-1], edge[1:]):
                        for s in range(int(parts[visited[lo_]])):  # a cell of several blocks is alone in each
                            row.append(i)
                            block.append(int(at[lo_]) + s)
                            cells.append(visited[lo_:hi])
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("_v").take(take), part.column("_q").take(take), part.column("_n").take(take), pa.array(block, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], names=["_v", "_q", "_n", "_block", "_cells"])

    probes = questions.mapInArrow(probe, "_v array<double>, _q string, _n long, _block int, _cells array<int>")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("_cell").to_numpy()
            key = batch.column("_key").to_numpy().view(np.uint64)
            block = first[cell] + (key % parts[cell].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_v"), batch.column("_ids"), batch.column("_cell"), pa.array(block.astype(np.int32))], names=["_v", "_ids", "_cell", "_block"])

    placed = entries.mapInArrow(place, f"_v array<double>, _ids array<{id_type}>, _cell int, _block int")

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        """The nearest entries of one block for each of its queries, among the cells that the query visits."""
        entry, ids, cell = matrix(right.column("_v").combine_chunks(), dim), right.column("_ids").combine_chunks(), right.column("_cell").to_numpy()
        question, cells = matrix(left.column("_v").combine_chunks(), dim), left.column("_cells").combine_chunks()
        owner, found, score = [], [], []
        here, local = np.unique(cell, return_inverse=True)
        step = max(1, AT_ONCE // max(1, len(entry)))
        for lo in range(0, len(question) if len(entry) else 0, step):
            part = question[lo : lo + step]
            visited = np.zeros((len(part), len(here)), bool)
            for i in range(len(part)):
                visited[i] = np.isin(here, cells[lo + i].values.to_numpy())
            rough = np.where(visited[:, local], distances(part, entry), np.inf)
            width = min(rough.shape[1], 2 * k + 2)  # rounding may swap close ones: take a few more, then measure exactly
            top = np.argpartition(rough, width - 1, axis=1)[:, :width]
            real = np.isfinite(np.take_along_axis(rough, top, 1))
            exact = np.sqrt(((entry[top] - part[:, None, :]) ** 2).sum(axis=2))
            owner.append(np.repeat(np.arange(lo, lo + len(part)), width)[real.ravel()])
            found.append(top[real])
            score.append(exact[real])
        owner, found = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (owner, found))
        score = np.concatenate([np.zeros(0), *score])
        owner = pa.array(owner)
        return pa.table({"_q": left.column("_q").combine_chunks().take(owner), "_n": left.column("_n").combine_chunks().take(owner), "score": score, "_ids": ids.take(pa.array(found))})

    near = probes.groupBy("_block").cogroup(placed.groupBy("_block")).applyInArrow(rank, f"_q string, _n long, score double, _ids array<{id_type}>")
    single = near.select("_q", "_n", "score", F.explode("_ids").alias("vec_id"))
    ordered = Window.partitionBy("_q").orderBy("score", "vec_id")
    best = single.withColumn("_r", F.row_number().over(ordered)).filter(F.col("_r") <= k + 1).groupBy("_q", "_n").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("_best"))
    met = join_hot(asked.select("_id", "_q"), best, "_q", "_n", asked.count()).filter("_best is not null")
    own = F.slice(F.filter("_best", lambda x: x["vec_id"] != F.col("_id")), 1, k)
    ranked = met.select(F.col("_id").alias("query_id"), F.posexplode(own).alias("_pos", "_hit"))
    return ranked.select("query_id", (F.col("_pos") + 1).cast("int").alias("rank"), F.col("_hit.vec_id").alias("vec_id"), F.col("_hit.score").alias("score"))
