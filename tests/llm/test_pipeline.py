"""The corpus pipeline on odd rows and on a given table."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_dedup import plain_cut, plain_print
from test_models import plain_score
from tokenizers import Tokenizer

import corpus_pipeline as P

from evlog.llm import decontaminate, quality, queries
from evlog.llm.common import row_key

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        path = f"{queries.shared_folder(spark)}/{name}"
        out.write.parquet(path)
        seen.append((docs.count(), out.count()))
        docs = spark.read.parquet(path)
        assert docs.columns == P.COLUMNS
    assert all(after <= before for before, after in seen) and seen[0][1] < seen[0][0] and seen[1][1] < seen[1][0] and seen[3][1] < seen[3][0]
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def first_of_groups(rows):
    """Of each group of texts whose prints are within 4 bits, by any chain of them, the one with the smallest id."""
    prints, label = [plain_print(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (d, _), group in zip(rows, label):
        least[group] = min(d, least.get(group, d))
    return [(d, t) for d, t in rows if d in least.values()]


def without_repeats(rows, window=35):
    """Texts less their repeated windows, word by word."""
    seen = Counter()
    words = {d: t.encode().split() for d, t in rows}
    for w in words.values():
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, t in rows:
        w, gone = words[d], set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else t))
    return out


def pieces_of(rows):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = Counter()
    for d, t in rows:
        ids, start = np.array(whole.encode(t, add_special_tokens=False).ids + [1], "<u4"), 0
        while start < len(ids):
            n = min(2048, 1 << (len(ids) - start).bit_length() - 1)
            out[d, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
            start += n
    return out


def test_run_equals_brute_force(spark):
    """The whole pipeline against plain Python over plain lists, stage by stage."""
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    rows = [(r[0], r[1] or "") for r in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()]
    model = quality.train(docs, labels)
    good = [(d, t) for d, t in rows if plain_score(model, t) >= 0.5]
    index = decontaminate.Index(duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall())
    apart = first_of_groups(good)
    clean = [(d, t) for d, t in without_repeats(apart) if not index.matches(t)]
    assert len(rows) > len(good) > len(apart) > len(clean) > 50
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in P.run(spark, SF).collect()) == pieces_of(clean)


def test_repeats_here_and_in_the_operator_are_the_same():
    rows = [(i, " ".join(f"w{k % (7 + i)}" for k in range(90))) for i in range(3)]
    assert Counter(len(t.split()) for _, t in without_repeats(rows)) == Counter(n - gone for _, n, gone, _ in plain_cut(rows).elements())


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 1), (2, "plain words " * 9, "en", None, 5, 1), (2, "plain words " * 9, "en", None, 5, 1), (3, "x " * 40_000, None, "s", 2, None)]])
def test_odd_documents(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    for name, stage in P.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        assert name == "packing" or docs.columns == P.COLUMNS
    left = before.select("doc_id").collect()
    assert len(left) == len(set(left)) and {r.doc_id for r in left} <= {r[0] for r in rows}
    sums = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("tokens")).collect()
    assert {r.doc_id for r in sums} == {r.doc_id for r in left} and all(r.n == r.tokens for r in sums)


def test_row_keys_tell_rows_apart(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "a"), (1, None), (1, "a")], "doc_id long, text string")
    assert df.select(row_key("doc_id", "text").alias("k")).distinct().count() == 5
