"""Language identification, the quality classifier and nearest neighbours."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import zstandard

from evlog.llm import language, neighbours, quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def held_out_share(rows):
    rows = list(rows)
    return sum(rows) / len(rows)


# ---- language ---------------------------------------------------------------------------------------------------------


def test_held_out_languages(docs):
    filters = language.train(docs)
    found = language.identify(docs, filters).filter(language.part_of("doc_id", 4) == 2).collect()
    assert len(found) > 150 and held_out_share(r.lang == r.lang_pred for r in found) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_learning_leaves_out_the_held_part(spark, docs):
    from pyspark.sql import functions as F

    spoiled = docs.withColumn("lang", F.when(language.part_of("doc_id", 4) == 2, "zz").otherwise(F.col("lang")))
    assert "zz" not in language.train(spoiled).languages


def test_odd_texts(spark):
    rows = [(1, "the cat sat on the mat and the dog ran", "en"), (2, "der hund und die katze sind auf der matte", "de"), (3, None, "en"), (4, "1234 !!", "de"), (5, "the dog", None), (None, "die katze", "de"), (1, "the cat sat on the mat and the dog ran", "en"), (6, "x", "en"), (7, "the cat " * 50_000, "en"), (8, "日本語の文章", None)]
    df = spark.createDataFrame([(*r, "old", 0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score int")
    got = language.identify(df, language.train(df))
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    cells = got.collect()
    assert len(cells) == len(rows)
    found = {(r.doc_id, r.text): r.lang_pred for r in cells}
    assert found[3, None] == "und" and found[4, "1234 !!"] == "und" and found[5, "the dog"] == "en" and found[None, "die katze"] == "de"
    assert found[7, "the cat " * 50_000] == "en"
    nothing = language.train(df.limit(0))
    assert {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"}
    assert language.identify(df.limit(0), nothing).count() == 0


def test_one_look_up_tells_all_languages():
    """Against plain sets: no language that has an n-gram is missed, and false ones are about as frequent as expected."""
    rng = random.Random(1)
    texts = {name: ["".join(rng.choice(letters) for _ in range(4000))] for name, letters in (("aa", "abcd "), ("bb", "bcde "), ("cc", "xyzw "))}
    filters = language.build(texts)
    own = {name: set(language.grams_of(t[0]).tolist()) for name, t in texts.items()}
    grams = np.array(sorted(set().union(*own.values())), np.uint64)
    bits = filters.find(grams)[:, 0]
    for lang, name in enumerate(filters.languages):
        has = np.array([g in own[name] for g in grams.tolist()])
        seen = (bits >> lang & 1).astype(bool)
        assert seen[has].all() and seen[~has].mean() < 0.01
    foreign = rng.choices(range(1 << 62), k=20_000)
    assert filters.counts(np.array(foreign, np.uint64)).max() < 100


def test_prediction_against_plain_sets():
    """Counts are those of plain sets of n-grams, but for false hits, which are expected and taken off; the most frequent language wins."""
    rng = random.Random(2)
    letters = {name: rng.sample("abcdefghijklmnopqrstuvwxyz", 9) for name in ("l1", "l2", "l3", "l4", "l5")}
    prose = lambda name, n: "".join(rng.choice([*letters[name], " "]) for _ in range(n))
    filters = language.build({name: [prose(name, 30_000)] for name in letters})
    sets = {name: set() for name in letters}
    for k, name in enumerate(filters.languages):
        grams = language.grams_of(prose(name, 30_000))
        sets[name] = set(grams[(filters.find(grams)[:, 0] >> k & 1).astype(bool)].tolist())
    for _ in range(40):
        name = rng.choice(list(letters))
        text = prose(name, 300)
        grams = language.grams_of(text)
        counts = filters.counts(grams)
        for k, other in enumerate(filters.languages):
            plain = int((filters.find(grams)[:, 0] >> k & 1).sum())
            assert counts[k] == pytest.approx(max(0, plain - len(grams) * filters.false[k]) / (1 - filters.false[k]))
        found, share = filters.predict(text)
        assert found == name == filters.languages[int(np.argmax(counts))] and share == pytest.approx(counts.max() / counts.sum())


def test_more_languages_than_bits_of_a_word(spark):
    """Each of 130 languages has letters of its own; the last ones are learned and told as the first."""
    rng = random.Random(3)
    letters = {f"l{i:03d}": [chr(0x4E00 + 4 * i + k) for k in range(4)] for i in range(130)}
    prose = lambda name, n: "".join(rng.choice(letters[name]) for _ in range(n))
    rows = [(i, prose(name, 200), name) for i, name in enumerate(list(letters) * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    filters = language.train(df, docs_each=6)
    assert len(filters.languages) == 130 and filters.slots.shape[1] == 3
    fresh = spark.createDataFrame([(name, prose(name, 200) + prose(rng.choice(list(letters)), 20)) for name in letters], "want string, text string")
    assert language.identify(fresh, filters).filter("want = lang_pred and score > 0.5").count() == 130


def test_training_takes_so_many_documents_of_each_language(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(language, "build", lambda texts: seen.update({k: sorted(v) for k, v in texts.items()}))
    rows = [(i, f"text {i}", "en") for i in range(3_000)] + [(i, f"text {i}", "de") for i in range(9_000, 9_007)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    language.train(df, docs_each=50)
    first = dict(seen)
    language.train(df.repartition(5), docs_each=50)
    assert len(first["en"]) == 50 and 3 <= len(first["de"]) <= 7 and seen == first


# ---- quality ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_quality(docs, labels):
    model = quality.train(docs, labels)
    found = quality.score(docs, model).join(labels, "doc_id").filter(quality.bucket("doc_id", 3) == 1).collect()
    good, bad = [r.score for r in found if r.quality == 1], [r.score for r in found if r.quality == 0]
    area = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert area > 0.9 and held_out_share(s >= 0.5 for s in good) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


def test_held_labels_teach_nothing(docs, labels):
    from pyspark.sql import functions as F

    spoiled = labels.withColumn("quality", F.when(quality.bucket("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs, labels) == quality.train(docs, spoiled)


def plain_score(model, text):
    """The score by its definition: each chunk is compressed by a new compressor with either dictionary."""
    raw = (text or "").encode()
    pieces = [line[at : at + quality.CHUNK] for line in raw.split(b"\n") if line.strip() for at in range(0, len(line), quality.CHUNK)]
    size = lambda piece, words: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False, write_checksum=False).compress(piece))
    good, bad = ([size(p, words) for p in pieces] for words in (model.good, model.bad))
    features = [0.0, 0.0, 0.0]
    if pieces:
        each = sorted((b - g) / (b + g + quality.EVEN) for g, b in zip(good, bad))
        worst = each[: max(1, len(each) // 5)]
        features = [(sum(bad) - sum(good)) / (sum(bad) + sum(good) + quality.EVEN), sum(worst) / len(worst), max(0.0, quality.LOW - min(sum(good), sum(bad)) / len(raw)) if len(raw) > quality.CHUNK // 4 else 0.0]
    return 1 / (1 + math.exp(-model.weights[0] - sum(w * f for w, f in zip(model.weights[1:], features))))


def test_scores_equal_their_definition(docs, labels):
    model = quality.train(docs, labels)
    rows = quality.score(docs.limit(60), model).collect()
    assert len(rows) == 60 and all(r.score == pytest.approx(plain_score(model, r.text), abs=1e-9) and r.predicted == (r.score >= 0.5) for r in rows)


def test_odd_quality_rows(spark, docs, labels):
    rows = [(1, None), (2, ""), (3, " \n "), (None, "some words"), (4, "x"), (4, "x"), (5, "ab " * 300_000)]
    df = spark.createDataFrame([(*r, "old", "old") for r in rows], "doc_id long, text string, score string, other string")
    model = quality.train(docs, labels)
    got = quality.score(df, model)
    assert got.columns == ["doc_id", "text", "other", "score", "predicted"]
    cells = got.collect()
    assert len(cells) == len(rows) and len({r.score for r in cells if not (r.text or "").strip()}) == 1
    untrained = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(df, untrained).collect()} == {0.5}
    assert quality.score(df.limit(0), model).count() == 0


# ---- neighbours ----------------------------------------------------------------------------------------------------------


def exact(rows, queries, k=10):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in usable:
        if q in queries:
            near = sorted({(float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in usable if i != q and len(w) == len(v)})
            out[q] = [(i, d) for d, i in near][:k]
    return out


def as_lists(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_against_brute_force(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = as_lists(neighbours.search(vectors, vectors.filter("vec_id % 100 = 0"), least=50).collect())
    want = exact(rows, {i for i, _ in rows if i % 100 == 0})
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.9
    everything = as_lists(neighbours.search(vectors, vectors.filter("vec_id % 100 = 0"), share=1.0).collect())
    assert {q: [i for i, _ in x] for q, x in everything.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(abs(a - b) < 1e-12 for q in want for (_, a), (_, b) in zip(everything[q], want[q]))


def test_ties_copies_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 7)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 5)]) for i in range(300)] + [(1000 + i, [1.0, 1.0, 0.0, 2.0, 1.0]) for i in range(60)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 5), (2003, [1.0, None, 1.0, 1.0, 1.0]), (2004, [float("nan")] * 5), (2005, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 5), (2006, [1.0, 2.0]), (1003, [1.0, 1.0, 0.0, 2.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    want = exact([r for r in rows if r[1] is None or len(r[1]) != 2], {i for i, _ in rows if i is not None})
    got = as_lists(neighbours.search(df, df, share=1.0).collect())
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.search(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0
    two = spark.createDataFrame([(100, [1.0, 0.5, 0.0]), (7, [1.0, 0.0, 1.0])], schema)
    assert [(r.query_id, r.rank, r.vec_id) for r in neighbours.search(two, two.filter("vec_id = 100")).collect()] == [(100, 1, 7)]
    one = two.filter("vec_id = 100")
    assert neighbours.search(one, one).count() == 0


def test_heap_order():
    rng = np.random.default_rng(2)
    left, right, size = rng.random(6), rng.random(5), rng.integers(0, 3, 30)
    cells = neighbours.traverse(left, right, size, int(size.sum()))
    sums = [left[c // 5] + right[c % 5] for c in cells]
    assert sums == sorted(sums) and Counter(cells) == Counter(np.flatnonzero(size).tolist())
