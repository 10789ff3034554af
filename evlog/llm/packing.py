"""Packing by power-of-two decomposition: documents are cut into pieces of binary lengths, and equal lengths are bucketed."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import per_process, texts_of

END = 1  # id after each document
LONGEST = 2048
LONG_RUN = re.compile(r"\S{500}|\s{500}|[^\w\s]{300}")


class Encoder:
    """Ids of whole texts. Two libraries with one vocabulary: the faster takes all texts but those that hold a special
    token, or a run whose merging would take time with the square of its length."""

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if LONG_RUN.search(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


def encoder(vocabulary: str, ranks: str) -> Encoder:
    import public_tokenizers

    return per_process(f"encoder {vocabulary}", lambda: Encoder(vocabulary, ranks, public_tokenizers.PATTERN))


def lengths_of(n: int, longest: int = LONGEST) -> list[int]:
    """Full pieces of the longest length, then the binary digits of the rest, longest first; they sum to n."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, the ids.

    Every piece has a binary length and is a sequence of its own, so no sequence crosses documents, none is padded, and
    sequences of one length form a bucket (``write_buckets``). Narrow: no shuffle, whatever the documents' lengths.
    A null text is an empty one: its only id is the end id. A null id stays null; repeated rows are packed each for
    itself; other columns are left out; an empty table gives no pieces. ``longest`` must be a power of two.
    sequence_id is unique within a result, but another run may number otherwise.
    """
    import public_tokenizers

    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = f"{id_col} {id_type}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                owner, starts, lengths, sums, totals, pieces = [], [], [], [], [], []
                for row, text in enumerate(texts_of(part, text_col)):
                    ids = np.append(coder.ids(text or ""), np.uint32(END)).astype("<u4")
                    raw, start = ids.tobytes(), 0
                    for n in lengths_of(len(ids), longest):
                        owner.append(row)
                        starts.append(start)
                        lengths.append(n)
                        sums.append(zlib.crc32(raw[4 * start : 4 * (start + n)]))
                        totals.append(len(ids))
                        if with_ids:
                            pieces.append(ids[start : start + n].astype(np.int32))
                        start += n
                out = [part.column(id_col).take(pa.array(owner, pa.int64())), starts, lengths, sums, totals]
                names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
                arrays = [out[0], *(pa.array(x, pa.int64()) for x in out[1:])]
                if with_ids:
                    names.append("ids")
                    arrays.append(pa.array(pieces, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    pieces = docs.select(id_col, text_col).mapInArrow(cut, fields)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The sequences as Parquet, a folder for each length: a batch read from one folder needs no padding."""
    pieces.write.partitionBy("length").parquet(path)
