"""Cross-tokenizer alignment: two tokenizers' tokens of a text are linked where they end together, by lockstep merging.

Both tokenizers' byte ends are merged for all documents of a batch at once: one NumPy state holds a pointer into A's ends
and one into B's for each document, every step compares the ends at the pointers of all of them, emits links and cuts where
they are equal, advances what lies behind, and drops the documents that are finished. Long documents take part as several
lanes, one for each stretch of bytes, so that a step count is bounded by a stretch and not by the longest document; tokens
that end together end in the same stretch, so no link is lost.

How often two ids are linked is counted over the corpus. Frequent pairs, of which there can be no more than a stated
number, go to all tasks; links of the others meet their counts in a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import per_process, small_batches, stored, texts_of

#: Bytes of a lane, bytes of text that are merged at once, links of a batch that are looked up at once.
STRETCH, TEXT_AT_ONCE, LINKS_AT_ONCE = 1_024, 1 << 20, 1 << 19
#: Characters of a word or of blanks from which on A's slower encoder is taken.
LONG_WORD = 300
LONG_BLANKS = re.compile(r"\s{300}")
#: Rows that go to a task's Python worker at once: their lists of ids are much longer than their texts.
ROWS_AT_ONCE = 512
#: Pairs with more than one link in ``FREQUENT`` are looked up in the tasks; there are fewer than ``FREQUENT`` of them.
FREQUENT = 500_000
#: The printable bytes that byte-level vocabularies spell as themselves; the others follow from U+0100 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
LANES = "_row long, _id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>"


# ---- token bytes ----------------------------------------------------------------------------------------------------


class Tokens:
    """Bytes of every id of a vocabulary, their lengths, and the ids' decimal texts with each separator."""

    def __init__(self, table: list[bytes]):
        if not all(table):
            raise ValueError("a token without bytes has no end of its own")
        self.table, self.lengths = table, np.array([len(t) for t in table], np.int64)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


def byte_level(entry: str) -> bytes:
    """The bytes that an entry of a byte-level vocabulary stands for."""
    table = per_process("byte level", lambda: {chr(b): b for b in PRINTABLE} | {chr(256 + n): b for n, b in enumerate(sorted({*range(256)} - {*PRINTABLE}))})
    return bytes(table[c] for c in entry)


def piece_bytes(piece: str) -> bytes:
    """The bytes of a piece: U+2581 is a space, ``<0xHH>`` one byte."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Pair:
    """Tokenizers A (byte-level vocabulary) and B (pieces) with their tokens' bytes."""

    def __init__(self, vocabulary: str, ranks: str, pieces: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.vocabulary, self.b = vocabulary, sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        entries = {i: byte_level(t) for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.tokens_a, self.tokens_b = Tokens([entries[i] for i in range(len(entries))]), Tokens([piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())])

    def whole(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.vocabulary)
        found.encode_special_tokens = True
        return found

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids by A and by B; none where a tokenizer does not give back a space and the text."""
        none = np.zeros(0, np.int32)
        if not text or "▁" in text:  # B would give that character back as a space
            return none, none
        spaced = " " + text
        want, b = spaced.encode("utf-8", "replace"), self.b.encode(text)
        # both libraries have the same ids; the slower one takes runs whose merging would take time with their square
        if max(map(len, text.split()), default=0) >= LONG_WORD or LONG_BLANKS.search(text):
            a = per_process(f"whole {self.vocabulary}", self.whole).encode(spaced, add_special_tokens=False).ids
        else:
            a = self.fast.encode_ordinary(spaced)
        if self.tokens_b.joined(b) != want or self.tokens_a.joined(a) != want:
            return none, none
        return np.array(a, np.int32), np.array(b, np.int32)


def pair_of(vocabulary: str, ranks: str, pieces: str) -> Pair:
    return per_process(f"pair {vocabulary} {pieces}", lambda: Pair(vocabulary, ranks, pieces))


# ---- lockstep merging -----------------------------------------------------------------------------------------------


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j), rising, where ends_a[i] == ends_b[j]; both rise throughout. Lanes lie between ``bounds``.

    A lane owns the ends above its bound up to the next one, in A and in B, so lanes are independent of one another.
    """
    i, j = (np.searchsorted(ends, bounds, side="right") for ends in (ends_a, ends_b))
    state = np.stack([i[:-1], i[1:], j[:-1], j[1:]])  # per lane: place in A, its end, place in B, its end
    found = []
    while True:
        state = state[:, (state[0] < state[1]) & (state[2] < state[3])]
        if not state.shape[1]:
            break
        a, b = ends_a[state[0]], ends_b[state[2]]
        met = a == b
        found.append(state[::2, met])
        state[0] += a <= b
        state[2] += b <= a
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    links = np.concatenate(found, axis=1)
    return tuple(links[:, np.argsort(links[0])])


class Spelling:
    """Decimal texts of ids with a separator: ``,`` within a group, ``|`` between its sides, ``;`` after it."""

    def __init__(self, size: int):
        self.table = np.array([f"{i}{sep}".encode() for i in range(size) for sep in ",|;"])  # of one width, filled up by zero bytes

    def text(self, a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> bytes:
        """Groups of one document as text; ``cuts`` are the places of each group's last token."""
        group_a, group_b = (np.searchsorted(cuts, np.arange(len(ids))) for cuts, ids in ((cuts_a, a), (cuts_b, b)))
        before_a, before_b = np.concatenate([[0], cuts_a + 1]), np.concatenate([[0], cuts_b + 1])
        codes = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[cuts_a], last_b[cuts_b] = 1, 2
        codes[np.arange(len(a)) + before_b[group_a]] = 3 * a.astype(np.int64) + last_a
        codes[np.arange(len(b)) + before_a[group_b + 1]] = 3 * b.astype(np.int64) + last_b
        return self.table[codes].tobytes().replace(b"\0", b"")[:-1]


def aligned(pairs: list[tuple[np.ndarray, np.ndarray]], lengths_a: np.ndarray, lengths_b: np.ndarray, stretch: int = STRETCH) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each document (A ids, B ids), the places (in A, in B) of tokens that end together, rising.

    The last place of a document is always a link, for both sides have the same bytes. Documents without tokens have none.
    """
    if not pairs:
        return []
    ends_a, ends_b = (np.cumsum(lengths[np.concatenate(side)]) for lengths, side in zip((lengths_a, lengths_b), zip(*pairs)))
    stops_a, stops_b = (np.cumsum([0, *map(len, side)]) for side in zip(*pairs))
    begins = np.concatenate([[0], ends_a])[stops_a]  # bytes before each document, and those of all
    parts = [np.arange(lo, hi, stretch) for lo, hi in zip(begins[:-1], begins[1:]) if hi > lo]
    bounds = np.concatenate([*parts, begins[-1:]])
    i, j = lockstep(ends_a, ends_b, bounds)
    at = np.searchsorted(i, stops_a)
    return [(i[lo:hi] - a, j[lo:hi] - b) for lo, hi, a, b in zip(at[:-1], at[1:], stops_a, stops_b)]


# ---- the whole table ------------------------------------------------------------------------------------------------


def links_of(docs: DataFrame, vocabulary: str, ranks: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row, _id, n_a, n_b, n_groups, n_links, groups_sha256 and the linked ids (lists a, b) of every row. Narrow."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [f.split()[0] for f in LANES.split(", ")]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(vocabulary, ranks, pieces)
        size = max(len(pair.tokens_a.table), len(pair.tokens_b.table))
        spelling = per_process(f"spelling {size}", lambda: Spelling(size))

        def emit(part: pa.RecordBatch, encoded: list) -> pa.RecordBatch:
            n_a, n_b, n_links, sums, linked_a, linked_b = [], [], [], [], [], []
            for (a, b), (i, j) in zip(encoded, aligned(encoded, pair.tokens_a.lengths, pair.tokens_b.lengths)):
                n_a.append(len(a))
                n_b.append(len(b))
                n_links.append(len(i))
                sums.append(hashlib.sha256(spelling.text(a, b, i, j)).hexdigest() if len(a) else "")
                linked_a.append(a[i])
                linked_b.append(b[j])
            long, ids = pa.int64(), pa.list_(pa.int32())
            arrays = [part.column("_row"), part.column("_id"), pa.array(n_a, long), pa.array(n_b, long), pa.array(n_links, long), pa.array(n_links, long)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(sums, pa.string()), pa.array(linked_a, ids), pa.array(linked_b, ids)], names=names)

        for batch in batches:
            start, held, encoded = 0, 0, []
            for row, text in enumerate(texts_of(batch, "_text")):
                encoded.append(pair.encode(text))
                held += len(text or "")
                if held >= TEXT_AT_ONCE:
                    yield emit(batch.slice(start, row + 1 - start), encoded)
                    start, held, encoded = row + 1, 0, []
            if encoded:
                yield emit(batch.slice(start), encoded)

    texts = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return texts.mapInArrow(align, LANES.format(id=id_type))


def pieces_of(column: pa.Array, at_once: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lists hold about ``at_once`` values together; a longer list is a range of its own."""
    start, held = 0, 0
    for row, n in enumerate(pa.compute.list_value_length(column).to_pylist()):
        held += n
        if held >= at_once:
            yield start, row + 1
            start, held = row + 1, 0
    if start < len(column):
        yield start, len(column)


def keys_of(batch: pa.RecordBatch, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (a << 32 | b) of the links of rows lo to hi, and the row of each."""
    a, b = (batch.column(name).slice(lo, hi - lo) for name in "ab")
    key = a.flatten().to_numpy(zero_copy_only=False).astype(np.int64) << 32 | b.flatten().to_numpy(zero_copy_only=False)
    return key, np.repeat(np.arange(hi - lo), pa.compute.list_value_length(a).to_numpy(zero_copy_only=False))


def pair_counts(links: DataFrame) -> DataFrame:
    """_key, _count and _best (whether no pair with the same B id has more) of every linked pair of ids, over all rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces_of(batch.column("a"), LINKS_AT_ONCE):
                keys, n = np.unique(keys_of(batch, lo, hi)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["_key", "_n"])

    counts = stored(links.select("a", "b").mapInArrow(counted, "_key long, _n long").groupBy("_key").agg(F.sum("_n").alias("_count")))
    b = F.col("_key").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b.alias("_b")).agg(F.max("_count").alias("_most"))  # a row for each B id at most
    return stored(counts.join(most, b == F.col("_b")).select("_key", "_count", (F.col("_count") == F.col("_most")).alias("_best")))


def align(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, pieces: str | None = None, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, with_links: bool = False) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked, the linked ids (a, b) of every row of ``docs``.

    Groups lie between the byte offsets where tokens of both tokenizers end; each link is a pair of tokens that end
    together. A pair of ids counts as often as links of all rows hold it; n_best are the links whose pair is its B id's
    most frequent one (ties too), count_sum is the sum of the counts over the links. Null and empty texts, and texts that one of the
    tokenizers does not give back byte for byte, have no tokens: zeros and an empty digest. A null id stays null;
    repeated rows are aligned and counted each for itself; other columns are left out; an empty table gives no rows.
    """
    import public_tokenizers

    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = pieces or public_tokenizers.path("piece_bpe_32k.model")
    spark = docs.sparkSession
    with small_batches(spark, ROWS_AT_ONCE):
        links = stored(links_of(docs, vocabulary, ranks, pieces, id_col, text_col))
        counts = pair_counts(links)
    total = counts.agg(F.sum("_count")).first()[0] or 0
    often = counts.filter(F.col("_count") * frequent > total)  # fewer than ``frequent`` rows
    table = often.toArrow().sort_by("_key")
    columns = [table.column(name).to_numpy() for name in ("_key", "_count", "_best")]
    known = spark.sparkContext.broadcast(columns)
    out_fields = "_row long, n_best long, count_sum long, _rare array<long>"

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, best = known.value
        for batch in batches:
            for lo, hi in pieces_of(batch.column("a"), LINKS_AT_ONCE):
                key, row = keys_of(batch, lo, hi)
                at = np.searchsorted(keys, key)
                hit = at < len(keys)
                hit[hit] = keys[at[hit]] == key[hit]
                stops, hits = (np.searchsorted(rows, np.arange(hi - lo + 1)) for rows in (row[~hit], row[hit]))
                n_best, sums = (np.diff(np.concatenate([[0], np.cumsum(column[at[hit]], dtype=np.int64)])[hits]) for column in (best, numbers))
                rare = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(key[~hit], pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(lo, hi - lo), pa.array(n_best), pa.array(sums), rare], names=["_row", "n_best", "count_sum", "_rare"])

    with small_batches(spark, ROWS_AT_ONCE):
        met = stored(links.select("_row", "a", "b").mapInArrow(looked_up, out_fields))
    seldom = counts.filter(F.col("_count") * frequent <= total)
    one = met.select("_row", F.explode("_rare").alias("_key")).join(seldom, "_key")
    rare = one.groupBy("_row").agg(F.sum(F.col("_best").cast("long")).alias("n_best"), F.sum("_count").alias("count_sum"))
    sums = met.select("_row", "n_best", "count_sum").unionByName(rare).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    shown = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["a", "b"] * with_links
    return links.drop(*([] if with_links else ["a", "b"])).join(sums, "_row").select(F.col("_id").alias(id_col), *shown)
