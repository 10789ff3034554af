"""Substring deduplication: repeated passages are found by anchors at difference-cover positions, then extended to whole windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import row_hash, stored, texts_of

WINDOW = 35
#: A perfect difference set: every difference modulo 21 occurs between two of its members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
KEYS_AT_ONCE = 1 << 21
#: Bits of a window's hash by which a row knows its own starts.
CHECK = 24
LOW = (1 << CHECK) - 1


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()  # bytes: only ASCII white space


def hashes_of(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def rolling(hashes: np.ndarray, length: int, base: int) -> np.ndarray:
    """A hash of every run of ``length`` words: a polynomial modulo 2 ** 64 over the words' hashes, mixed."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.uint64)
    up = np.full(n, base, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    down = np.full(n, inverse(base), np.uint64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(hashes * up)])
    out = (sums[length:] - sums[:-length]) * down[: n - length + 1]
    out ^= out >> np.uint64(32)
    out *= np.uint64(BASES[0])
    return out ^ out >> np.uint64(29)


def once(keys: list[np.ndarray], rows: list[np.ndarray], at: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Map-side combine: (key, row, at, weight); a key met before here is known to repeat.

    Of a repeated key one place travels with weight 2; the other places get a key of their own, as their fate is known.
    """
    key, row, pos = np.concatenate(keys), np.concatenate(rows), np.concatenate(at)
    order = np.argsort(key, kind="stable")
    key, row, pos = key[order], row[order], pos[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    last = np.ones(len(key), bool)
    last[:-1] = new[1:]
    weight = np.where(new & last, 1, 2).astype(np.int32)
    own = ~new
    key = key.copy()
    key[own] = (row[own].view(np.uint64) * np.uint64(BASES[1]) + pos[own].astype(np.uint64)) * np.uint64(BASES[0])
    return key, row, pos, weight


PLACES = "key long, _row long, at int, weight int"


def places(chunks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    keys, rows, at, held = [], [], [], 0

    def flush() -> pa.RecordBatch:
        key, row, pos, weight = once(keys, rows, at)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(row), pa.array(pos), pa.array(weight)], names=["key", "_row", "at", "weight"])

    for k, r, p in chunks:
        keys.append(k)
        rows.append(r)
        at.append(p)
        held += len(k)
        if held >= KEYS_AT_ONCE:
            yield flush()
            keys, rows, at, held = [], [], [], 0
    if held:
        yield flush()


def repeated(found: DataFrame) -> DataFrame:
    """(_row, at) of the places whose key occurs at two places or more, with their lists per row."""
    weight = F.sum("weight").over(Window.partitionBy("key"))
    return found.withColumn("_all", weight).filter("_all >= 2").groupBy("_row").agg(F.collect_list("at").alias("at"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Rows of ``docs`` with n_words, n_removed, kept_sha256 and, if asked, kept_text: without words of repeated windows.

    A window of ``window`` words whose words also start anywhere else, in the same document or another, is repeated;
    every word that one covers goes. Anchors, hashed at cover positions of each document, nominate windows: a match of
    ``window`` words holds an aligned anchor in both places. The nominated windows are then hashed whole.

    Words are the runs between ASCII white space, unchanged; kept words are joined by one space. Null texts have no words.
    Null ids and repeated rows are kept, and a repeated row repeats its whole text. All columns of ``docs`` stay,
    except that the four named above are replaced; an empty table stays empty.
    Windows have 96-bit hashes. Rows meet their windows by a 64-bit key; a start is taken only if the row's own window
    there has the hash that was found to repeat, so rows that happen to share a key take none of each other's.
    """
    span = window - PERIOD + 1
    if span < 1:
        raise ValueError(f"window must be at least {PERIOD} words")
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    docs = docs.drop("n_words", "n_removed", "kept_sha256", "kept_text")
    texts = docs.select(F.col(text_col).alias("_text"), row_hash(id_col, text_col).alias("_row")).filter(F.length("_text") >= 2 * window - 1)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks():
            for batch in batches:
                for text, row in zip(texts_of(batch, "_text"), texts_of(batch, "_row")):
                    keys = rolling(hashes_of(words_of(text)), span, BASES[0])
                    if len(keys) > window - span:
                        at = np.flatnonzero(np.resize(cover, len(keys))).astype(np.int32)
                        yield keys[at], np.full(len(at), row, np.int64), at

        yield from places(chunks())

    nominated = stored(repeated(texts.mapInArrow(anchors, PLACES)))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks():
            for batch in batches:
                for text, row, at in zip(texts_of(batch, "_text"), texts_of(batch, "_row"), batch.column("at")):
                    hashes = hashes_of(words_of(text))
                    n = len(hashes) - window + 1
                    if n < 1:
                        continue
                    at = at.values.to_numpy()
                    at = at[at <= len(hashes) - span]
                    marks = np.zeros(len(hashes) + 1, np.int32)  # a window may start up to window - span words before
                    np.add.at(marks, np.maximum(at - (window - span), 0), 1)
                    np.add.at(marks, at + 1, -1)
                    start = np.flatnonzero(np.cumsum(marks)[:n] > 0).astype(np.int32)
                    first, second = rolling(hashes, window, BASES[0])[start], rolling(hashes, window, BASES[1])[start] >> np.uint64(32)
                    yield np.stack([first, second], axis=1), np.full(len(start), row, np.int64), start

        yield from wide_places(chunks())

    joined = texts.join(nominated, "_row")
    found = joined.select("_text", "_row", "at").mapInArrow(windows, "key long, key2 int, _row long, at int, weight int")
    total = F.sum("weight").over(Window.partitionBy("key", "key2"))
    hashed = F.when(F.col("key") == F.col("_row"), F.col("key2").cast("long")).otherwise(F.col("key"))
    start = F.shiftleft(F.col("at").cast("long"), CHECK).bitwiseOR(hashed.bitwiseAND(F.lit(LOW)))
    starts = stored(found.withColumn("_all", total).filter("_all >= 2").groupBy(F.col("_row").alias("_llm_row")).agg(F.collect_list(start).alias("_llm_starts")))

    rest = [c for c in docs.columns]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    schema = f"{types}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, gone, sums, kept_texts = [], [], [], []
            for text, starts in zip(texts_of(batch, text_col), batch.column("_llm_starts")):
                words = words_of(text)
                removed = 0
                if starts.is_valid:
                    marks = np.zeros(len(words) + 1, np.int32)
                    packed = np.unique(starts.values.to_numpy())
                    at = packed >> CHECK
                    at, packed = at[at <= len(words) - window], packed[at <= len(words) - window]
                    own = rolling(hashes_of(words), window, BASES[0])
                    at = at[own[at].view(np.int64) & LOW == packed & LOW]
                    np.add.at(marks, at, 1)
                    np.add.at(marks, at + window, -1)
                    covered = np.cumsum(marks)[: len(words)] > 0
                    removed = int(covered.sum())
                kept = b" ".join([w for w, c in zip(words, covered) if not c] if removed else words)
                count.append(len(words))
                gone.append(removed)
                sums.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode() if with_text else None)
            out = [batch.column(c) for c in rest] + [pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())]
            names = [*rest, "n_words", "n_removed", "kept_sha256"]
            if with_text:
                out.append(pa.array(kept_texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(out, names=names)

    met = docs.withColumn("_llm_row", row_hash(id_col, text_col)).join(starts, "_llm_row", "left")
    return met.drop("_llm_row").mapInArrow(cut, schema)


def wide_places(chunks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """As ``places``, for keys of 64 and 32 bits; places whose fate is known have the row as their key."""
    keys, rows, at, held = [], [], [], 0

    def flush() -> pa.RecordBatch:
        both = np.concatenate(keys)
        order = np.lexsort((both[:, 1], both[:, 0]))
        both, row, pos = both[order], np.concatenate(rows)[order], np.concatenate(at)[order]
        new = np.ones(len(both), bool)
        new[1:] = (both[1:] != both[:-1]).any(axis=1)
        last = np.ones(len(both), bool)
        last[:-1] = new[1:]
        weight = np.where(new & last, 1, 2).astype(np.int32)
        own = ~new
        both[own, 1] = both[own, 0] & np.uint64((1 << 32) - 1)  # what tells the window; the key itself becomes the row's
        both[own, 0] = row[own].view(np.uint64)
        columns = [both[:, 0].copy().view(np.int64), both[:, 1].astype(np.uint32).view(np.int32), row, pos, weight]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "key2", "_row", "at", "weight"])

    for k, r, p in chunks:
        if len(k):
            keys.append(k)
            rows.append(r)
            at.append(p)
            held += len(k)
        if held >= KEYS_AT_ONCE:
            yield flush()
            keys, rows, at, held = [], [], [], 0
    if held:
        yield flush()
