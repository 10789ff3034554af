"""Benchmark decontamination and packing."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evlog.llm import decontaminate, packing

DOCS = "doc_id long, text string, extra int"


def edit_distance(a, b):
    """Least edits of a against any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def benchmark():
    rng = random.Random(3)
    return [(i, prose(rng, n)) for i, n in enumerate((12, 25, 40, 60, 200, 2))] + [(90, None), (91, ""), (92, "  "), (93, "tiny one")]


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        k = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[k] = "#"
        elif kind == 1:
            del chars[k]
        else:
            chars.insert(k, "#")
    return "".join(chars)


def test_regions_within_the_edit_budget(spark, benchmark):
    rng = random.Random(4)
    rows, leaks = [], {}
    for d in range(120):
        text = prose(rng, rng.randrange(0, 120))
        if d % 3 == 0:
            item, passage = benchmark[rng.randrange(0, 4)]
            budget = int(decontaminate.EDITS * len(passage))
            text = f"{text} {edited(rng, passage, rng.randrange(0, budget + 1))} {prose(rng, 20)}"
            if d % 2:
                text = text.upper().replace(" ", "\n")
            leaks[d] = item
        rows.append((d, text, 0))
    rows += [(500, None, 0), (501, "", 0), (None, f"lead {benchmark[1][1]}", 0), (502, "has a tiny one in it", 0), (503, f"{benchmark[4][1][300:900]}", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    found = decontaminate.contaminated(docs, items).collect()
    by_doc = Counter((r.doc_id, r.item_id) for r in found)
    assert all(by_doc[d, i] == 1 for d, i in leaks.items())
    assert by_doc[None, 1] == 1 and by_doc[502, 93] == 1 and by_doc[503, 4] >= 1
    texts, passages = {r[0]: r[1] for r in rows}, dict(benchmark)
    for r in found:  # each region holds the passage with the edits it tells, and no more than the budget
        region = texts[r.doc_id][r.start : r.end].lower().replace("\n", " ")
        if r.item_id != 4:
            assert edit_distance(passages[r.item_id].strip(), region) <= r.edits <= decontaminate.EDITS * len(passages[r.item_id])
    clean = {r[0] for r in rows} - {r.doc_id for r in found}
    assert clean >= set(range(120)) - set(leaks) | {500, 501}
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean


def test_against_brute_force(spark):
    """Every document and passage: a region is reported exactly if some part of the text is within the budget."""
    rng = random.Random(8)
    items = [(i, prose(rng, 8)) for i in range(4)]
    rows = []
    for d in range(40):
        passage = items[d % 4][1]
        rows.append((d, f"{prose(rng, 6)} {edited(rng, passage, d % 6)} {prose(rng, 4)}", 0))
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    index = decontaminate.Index(items)
    for d, text, _ in rows:
        for p, (i, passage) in enumerate(items):
            assert ((d, i) in found) == (edit_distance(passage, text) <= index.budget[p])


def plain_bands(index, codes):
    """Every passage and window, by every band: the places whose q-gram is in the text on one of its diagonals."""
    out = set()
    where = {}
    for pos, g in enumerate(decontaminate.grams_of(codes, index.q).tolist()):
        where.setdefault(g, []).append(pos)
    for p, (_, _, c) in enumerate(index.passages):
        grams = decontaminate.grams_of(c, index.q).tolist()
        spans = [(-1, 0, len(grams), int(index.budget[p]) + 1, index.bound[p])]
        for w in range(int(index.windows[p])):
            begin = min(w * decontaminate.WINDOW_STEP, int(index.last[p]))
            spans.append((w, begin, begin + decontaminate.WINDOW - index.q + 1, index.window_budget + 1, index.window_bound))
        for w, lo, hi, width, bound in spans:
            places = {}
            for a in range(lo, hi):
                for pos in where.get(grams[a], []):
                    for band in ((pos - a) // width, (pos - a) // width - 1):
                        places.setdefault(band, set()).add(a)
            out |= {(p, w, b * width, (b + 2) * width - 1, len(x)) for b, x in places.items() if len(x) >= bound}
    return out


CODE = "\n".join(f"            if value_{i} is not None:\n                total += value_{i}" for i in range(8))
KINDS = {
    "prose": lambda rng: prose(rng, 400),
    "copies": lambda rng: prose(rng, 30) + CODE[:300] + prose(rng, 300) + CODE,
    "indented": lambda rng: "\n".join("            " + prose(rng, 3) for _ in range(90)),
    "ha ha": lambda rng: "ha " * 900,
    "blanks": lambda rng: " " * 2_500 + "x" + " " * 700,
    "periods": lambda rng: "ha hi ha " * 300,
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("rows", [1 << 20, 50])
def test_bands_of_repetitive_texts(kind, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "ROWS_AT_ONCE", rows)
    rng = random.Random(21)
    index = decontaminate.Index([(1, CODE), (2, prose(rng, 50)), (3, "ha " * 60), (4, "ha hi " * 40 + "ho ha " * 30), (5, "tiny"), (6, "y" + " " * 60 + "z"), (7, CODE[:200])])
    codes = decontaminate.codes_of(KINDS[kind](rng)[:1_500])
    found = index.candidates(codes)
    got = [*index.bands(codes, found, True), *index.bands(codes, found, False)]
    want = plain_bands(index, codes)
    assert len(got) == len(set(got)) and set(got) <= want
    for p, w, low, high, _ in sorted(want - set(got))[::7]:  # what the short q-grams rule out has no region
        begin, size, budget = index.span(p, w)
        assert decontaminate.aligned(index.passages[p][2][begin : begin + size], codes, low + begin, high + begin, budget) is None


@pytest.mark.parametrize("kind", ["indented", "ha ha"])
def test_a_long_repetitive_text(kind):
    import time
    import tracemalloc

    rng = random.Random(22)
    items = [(i, CODE.replace("value", prose(rng, 1))) for i in range(20)] if kind != "ha ha" else [(1, "ha " * 60), (2, "ha " * 130)]
    text = {"indented": "\n".join("            " + prose(rng, 3) for _ in range(40_000)), "ha ha": "ha " * 350_000}[kind][:300_000]
    index = decontaminate.Index(items)
    start = time.time()
    found = index.matches(text)
    assert time.time() - start < 20 and bool(found) == (kind == "ha ha")
    tracemalloc.start()
    index.matches(text[:200_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300_000_000


def test_covered_intervals():
    rng = random.Random(23)
    for _ in range(200):
        union, marks = decontaminate.Covered(), set()
        for _ in range(12):
            start = rng.randrange(40)
            end = start + rng.randrange(1, 9)
            cells = set(range(start, end))
            if rng.random() < 0.5:
                assert union.add(start, end) == (not cells & marks)
                marks |= cells if not cells & marks else set()
            else:
                union.cover(start, end)
                marks |= cells
            assert {i for i in range(50) if union.holds(i)} == marks
            assert union.around(start, end - 1) == (cells <= marks)


def test_benchmark_in_blocks_and_empty_tables(spark, benchmark):
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    docs = spark.createDataFrame([(1, benchmark[2][1], 0), (2, "other", 0)], DOCS)
    whole = Counter(map(tuple, decontaminate.contaminated(docs, items).collect()))
    assert whole == Counter(map(tuple, decontaminate.contaminated(docs, items, block_bytes=300).collect())) and len(whole) == 1
    assert [r.doc_id for r in decontaminate.keep_clean(docs, items, block_bytes=300).collect()] == [2]
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.keep_clean(docs, items.limit(0)).count() == 2


def test_partial_quotes_of_any_offset():
    """Every verbatim slice of WINDOW + WINDOW_STEP - 1 characters is found, of short items and long ones."""
    rng = random.Random(12)
    for n in (180, 300, 394, 600, 601, 1200, 1333):
        text = prose(rng, n)[:n].strip().ljust(n, "z")
        index = decontaminate.Index([(1, text)])
        size = decontaminate.WINDOW + decontaminate.WINDOW_STEP - 1
        for start in [*range(0, n - size, 17), n - size]:
            lead = prose(rng, 20) + "#"  # no item has it
            (item, item_start, begin, end, edits, _), *more = index.matches(f"{lead}{text[start : start + size]}#{prose(rng, 20)}")
            assert (item, edits) == (1, 0) and start <= item_start <= start + size - decontaminate.WINDOW and not more
            assert begin == len(lead) + item_start - start and end - begin == decontaminate.WINDOW
    whole = index.matches(text)
    assert whole and all(m[4] == 0 for m in whole)


def test_edited_quotes_against_brute_force(spark):
    """A document with part of an item is reported exactly if some window, or the item, is within its budget."""
    rng = random.Random(13)
    items = [(i, prose(rng, n)) for i, n in enumerate((24, 45, 70))]
    rows = []
    for d in range(45):
        text = items[d % 3][1]
        at = rng.randrange(0, max(1, len(text) - 135))
        rows.append((d, f"{prose(rng, 6)} {edited(rng, text[at : at + 135], d // 3)} {prose(rng, 4)}", 0))
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, table).collect()}
    size, step = decontaminate.WINDOW, decontaminate.WINDOW_STEP
    want = set()
    for d, text, _ in rows:
        i, item = items[d % 3]
        starts = [*range(0, max(0, len(item) - size), step), max(0, len(item) - size)]
        if any(edit_distance(item[s : s + size], text) <= int(decontaminate.EDITS * size) for s in starts):
            want.add((d, i))
    assert found == want and 5 < len(want) < 45
    assert {r.doc_id for r in decontaminate.keep_clean(docs, table).collect()} == {r[0] for r in rows} - {d for d, _ in want}


# ---- packing --------------------------------------------------------------------------------------------------------------

ODD = [(1, None), (2, ""), (3, "a  b \n c"), (None, "null id"), (4, "word " * 5000), (4, "word " * 5000), (5, "<|endoftext|> inside"), (6, "x" * 3000 + " y"), (7, "ünïcode — 日本語 🙂   end"), (8, " " * 700 + "!" * 400), (9, "tab\tand\r\nline")]


def test_pieces_are_binary_and_whole(spark):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(i, t, 0) for i, t in ODD], DOCS)
    rows = packing.pack(docs).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.offset == 0 and 1 <= r.length <= 2048 and r.length & (r.length - 1) == 0 for r in rows)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in rows)
    want, got = Counter(), Counter()
    for d, t in ODD:
        want[d, tuple(whole.encode(t or "", add_special_tokens=False).ids) + (1,)] += 1
    ids = {}
    for r in rows:
        ids.setdefault((r.doc_id, r.doc_tokens), Counter())[r.start, tuple(r.ids)] += 1
    for (d, total), pieces in ids.items():
        copies = max(pieces.values())
        assert set(pieces.values()) == {copies}
        text = sum((p for _, p in sorted(pieces)), ())
        assert len(text) == total
        got[d, text] += copies
    assert got == want


def test_lengths():
    for n in range(1, 5000, 7):
        cut = packing.lengths_of(n)
        assert sum(cut) == n and cut == sorted(cut, reverse=True) and all(x & (x - 1) == 0 and x <= 2048 for x in cut)
        assert all(cut.count(x) == 1 for x in set(cut) - {2048})
    assert packing.lengths_of(0) == []


def test_buckets_are_folders(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words here", 0), (2, "more of them " * 300, 0)], DOCS)
    packing.write_buckets(packing.pack(docs), str(tmp_path / "b"))
    assert all(p.name == "_SUCCESS" or p.name.startswith((".", "length=")) for p in (tmp_path / "b").iterdir())
    assert packing.pack(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, longest=1000)
