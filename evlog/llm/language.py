"""Language identification by language-bitmask n-gram filters: one look-up tells every language that has an n-gram."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import per_process, texts_of

#: Documents of each language that training looks at, and the longest of them.
TRAIN_DOCS, TRAIN_CHARS = 600, 20_000
GRAM, SLOT_BITS, HASHES = 4, 20, 3
#: n-grams that each language's filter holds, so that no language is likelier for having seen more text.
GRAMS_EACH = 20_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 20


def folding() -> np.ndarray:
    """Code point by code point: lower-case letters (16 bits of them), and 0 for everything else."""

    def make() -> np.ndarray:
        table = np.zeros(0x110000, np.uint16)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = (ord(low) if len(low) == 1 else c) & 0xFFFF or 1
        return table

    return per_process("letters", make)


def grams_of(text: str) -> np.ndarray:
    """Every run of GRAM letters or gaps with at least two letters, as 64-bit numbers; gaps next to each other are one."""
    codes = folding()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    codes = np.concatenate([np.zeros(1, np.uint16), codes, np.zeros(1, np.uint16)])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes = codes[keep].astype(np.uint64)
    n = len(codes) - GRAM + 1
    if n < 1:
        return codes[codes > 0]
    out, letters = np.zeros(n, np.uint64), np.zeros(n, np.int8)
    for k in range(GRAM):
        part = codes[k : k + n]
        out = out << np.uint64(16) | part
        letters += part > 0
    return out[letters >= 2] if (letters >= 2).any() else codes[codes > 0]


@dataclass
class Filters:
    """Bit l of a slot is language l's, in as many words as there are languages for; false[l] is the share of foreign n-grams
    that its filter seems to have."""

    languages: list[str]
    slots: np.ndarray
    false: np.ndarray

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Of each n-gram the bits of all languages that have it: a row of words."""
        mixed = grams * FACTOR
        mixed ^= mixed >> np.uint64(29)
        mixed *= FACTOR
        found = None
        for k in range(HASHES):
            at = (mixed >> np.uint64(64 - SLOT_BITS * (k + 1)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
            found = self.slots[at] if found is None else found & self.slots[at]
        return found

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """n-grams of each language, less those that its filter is expected to have by chance."""
        total, hits = 0, np.zeros(len(self.languages))
        for at in range(0, len(grams), BLOCK):
            found = self.find(grams[at : at + BLOCK])
            total += len(found)
            size = found.dtype.itemsize * 8
            for word in range(found.shape[1]):
                patterns, n = np.unique(found[:, word], return_counts=True)
                for bit in range(min(size, len(hits) - word * size)):
                    hits[word * size + bit] += n[(patterns >> patterns.dtype.type(bit) & patterns.dtype.type(1)).astype(bool)].sum()
        return np.maximum(hits - total * self.false, 0) / (1 - self.false)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language with the most n-grams, ties to the first by name, and its share; ``und``, 0 without text or letters."""
        grams = grams_of(text or "")
        if not len(grams) or not self.languages:
            return "und", 0.0
        counts = self.counts(grams)
        best, total = int(np.argmax(counts)), counts.sum()
        return self.languages[best], float(counts[best] / total) if total else 0.0


def build(texts: dict[str, list[str]]) -> Filters:
    """Filters of the most frequent n-grams of each language's texts."""
    languages = sorted(texts)
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= min(64, len(languages)))
    size = np.dtype(kind).itemsize * 8
    filters = Filters(languages, np.zeros((1 << SLOT_BITS, max(1, -(-len(languages) // size))), kind), np.zeros(len(languages)))
    for lang, name in enumerate(languages):
        grams = [grams_of(t) for t in texts[name]]
        keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *grams]), return_counts=True)
        keys = keys[np.lexsort((keys, -n))][:GRAMS_EACH]
        mixed = keys * FACTOR
        mixed ^= mixed >> np.uint64(29)
        mixed *= FACTOR
        for k in range(HASHES):
            at = (mixed >> np.uint64(64 - SLOT_BITS * (k + 1)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
            filters.slots[at, lang // size] |= kind(1 << lang % size)
        full = (filters.slots[:, lang // size] >> kind(lang % size) & kind(1)).astype(float).mean()
        filters.false[lang] = min(0.99, full**HASHES)
    return filters


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, held: int = 2, docs_each: int = TRAIN_DOCS) -> Filters:
    """Filters from at most ``docs_each`` documents of each language, chosen by a hash: two passes over the table, whatever the languages.

    Rows with a null id, text or language and those of the held-out part teach nothing; very long texts are left out of training.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("id is not null and lang is not null")
    known = known.filter(part_of("id", parts) != held).filter(F.length("text").between(1, TRAIN_CHARS))
    sizes = known.groupBy("lang").agg(F.count("*").alias("_n"))  # a row for each language
    # a hash threshold leaves about twice as many of each language as are wanted
    key = F.xxhash64("id", "text", F.lit(5))
    share = F.pmod(key, F.lit(1 << 40)) / F.lit(1 << 40)
    thinned = known.join(F.broadcast(sizes), "lang").filter(share < F.lit(2.0 * docs_each) / F.col("_n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(key, "id", "text"))
    texts: dict[str, list[str]] = {}
    for r in thinned.withColumn("_rank", first).filter(F.col("_rank") <= docs_each).select("lang", "text").collect():
        texts.setdefault(r.lang, []).append(r.text)
    return build(texts)


def part_of(id_col: str, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))


def identify(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (share of the n-grams found that are of that language); both replace such columns.

    Whole texts are read. A null or letterless text is ``und`` with score 0; one whose n-grams no filter has gets the
    first language and score 0. Nulls elsewhere, repeated rows and other columns pass through; an empty table stays
    empty. Narrow; the filters, some megabytes whatever the corpus, are broadcast.
    """
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double"
    sent = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.slots, filters.false))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Filters(*sent.value)
        for batch in batches:
            found = [held.predict(t) for t in texts_of(batch, text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(compute, schema)
