"""Quality classifier by compression: dictionaries of good and of bad text; whichever compresses a text better tells its kind."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_sample, texts_of

#: Documents of each class that training looks at, the longest of them, dictionary size and level.
TRAIN_DOCS, TRAIN_CHARS, DICTIONARY, LEVEL = 1_500, 20_000, 1 << 18, 5
#: Text is compressed by line, long lines in chunks of so many bytes; a chunk's difference counts as if it had EVEN more bytes
#: of no difference, so a few words decide little; texts under LOW of their size are mostly repetition.
CHUNK, EVEN, LOW = 512, 64, 0.25


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]


class Sizes:
    """Compressed sizes of a text, chunk by chunk, under either dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.pair = []
        for raw in (good, bad):
            held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False, write_checksum=False))

    def features(self, text: str | None) -> list[float]:
        """Normalised size difference of the whole text and of its worst fifth, and how far its size is under LOW; 0 if blank."""
        raw = (text or "").encode("utf-8", "replace")
        parts = [line[at : at + CHUNK] for line in raw.split(b"\n") if line.strip() for at in range(0, len(line), CHUNK)]
        if not parts:
            return [0.0, 0.0, 0.0]
        sizes = np.array([[len(c.compress(p)) for c in self.pair] for p in parts], float)
        good, bad = sizes.sum(axis=0)
        each = np.sort((sizes[:, 1] - sizes[:, 0]) / (sizes.sum(axis=1) + EVEN))
        return [(bad - good) / (bad + good + EVEN), float(each[: max(1, len(each) // 5)].mean()), max(0.0, LOW - min(good, bad) / len(raw)) if len(raw) > CHUNK // 4 else 0.0]


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, turns: int = 50, ridge: float = 1e-2) -> list[float]:
    """Logistic regression of weighted rows by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return [float(v) for v in w]


def dictionary(texts: list[str], size: int) -> bytes:
    """Equal shares from the middle of each training text."""
    share = max(64, size // max(1, len(texts)))
    parts = []
    for t in texts:
        raw = t.encode("utf-8", "replace")
        middle = max(0, len(raw) // 2 - share // 2)
        parts.append(raw[middle : middle + share])
    return b"\n".join(parts)[:size] or b"\n"


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", parts: int = 3, held: int = 1, docs_per_class: int = TRAIN_DOCS, size: int = DICTIONARY) -> Model:
    """A model from at most ``docs_per_class`` documents of each label (1 good, 0 bad), chosen by a hash of their id and text.

    Ids of the held-out part and null ids or labels teach nothing. Half of the documents make the dictionaries, the others
    calibrate the score, weighted so that both labels are as frequent as among all labels learned from. Null, blank and very
    long texts are left out of training; without both labels the score is one half for every text. The bounded choice of ids
    is made on ``labels``, so that no text is shuffled.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).filter("_id is not null and label in (0, 1)").filter(bucket("_id", parts) != held)
    frequent = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    by_label = []
    for k in (0, 1):
        ids = bounded_sample(known.filter(F.col("label") == k).select("_id").distinct(), 2 * docs_per_class, frequent.get(k, 0), "_id")
        rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).filter(f"length(trim(text)) between 1 and {TRAIN_CHARS}").join(F.broadcast(ids), "_id")
        by_label.append([r.text for r in rows.orderBy(F.xxhash64("text"), "text").limit(docs_per_class).select("text").collect()])
    if not all(by_label):
        return Model(b"\n", b"\n", [0.0] * 4)
    bad, good = by_label
    model = Model(dictionary(good[::2], size), dictionary(bad[::2], size), [0.0] * 4)
    sizes = Sizes(model.good, model.bad)
    rest = [(t, 1) for t in good[1::2] or good] + [(t, 0) for t in bad[1::2] or bad]
    label = np.array([k for _, k in rest], float)
    share = np.where(label == 1, frequent[1] / label.sum(), frequent[0] / (1 - label).sum())
    model.weights = calibrated(np.array([sizes.features(t) for t, _ in rest]), label, share * len(rest) / share.sum())
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: good likelier) and ``predicted`` (1 from 0.5 on); both replace columns of that name.

    Whole texts are compressed, in chunks. A null, empty or blank text has no size difference and gets the score of none.
    Nulls elsewhere, repeated rows and other columns pass through; an empty table stays empty. Narrow.
    """
    docs = docs.drop("score", "predicted")
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double, predicted int"

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad)
        w = model.weights
        for batch in batches:
            x = np.array([sizes.features(t) for t in texts_of(batch, text_col)]).reshape(-1, 3)
            value = 1 / (1 + np.exp(-np.clip(w[0] + x @ np.array(w[1:]), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(compute, schema)


def bucket(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids have none."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))
