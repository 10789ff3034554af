"""Cross-tokenizer alignment."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from evlog.llm import alignment

DOCS = "doc_id long, text string, a string, _row int"


def bytes_of_a(whole):
    """Bytes of each id by the libraries' own way back from ids to text, where that is whole text; else by the entry."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in printable}
    for b in range(256):
        if b not in printable:
            table[chr(256 + len(table) - len(printable))] = b
    return {i: bytes(table[c] for c in t) for t, i in whole.get_vocab().items() if i != 50256}


def brute_force(docs):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    entries = bytes_of_a(whole)
    piece = lambda i: bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()
    rows, counts = [], Counter()
    for doc_id, text in docs:
        want = b" " + (text or "").encode()
        a, b = (whole.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)) if text else ([], [])
        if b"".join(entries[i] for i in a) != want or b"".join(map(piece, b)) != want:
            a, b = [], []
        ends = {}
        for side, ids, size in ((0, a, lambda i: len(entries[i])), (1, b, lambda i: len(piece(i)))):
            at = 0
            for k, i in enumerate(ids):
                at += size(i)
                ends.setdefault(at, [None, None])[side] = k
        cuts = [c for _, c in sorted(ends.items()) if None not in c]
        groups, last = [], (-1, -1)
        for i, j in cuts:
            groups.append(",".join(map(str, a[last[0] + 1 : i + 1])) + "|" + ",".join(map(str, b[last[1] + 1 : j + 1])))
            last = (i, j)
        links = [(a[i], b[j]) for i, j in cuts]
        counts.update(links)
        rows.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted(((d, n_a, n_b, g, len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), h) for d, n_a, n_b, g, ls, h in rows), key=str)


def found(spark, docs, **options):
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], DOCS).repartition(3)
    return sorted((tuple(r) for r in alignment.align(df, **options).collect()), key=str)


ODD = [
    None, "", " ", "a", "\n", "  two  blanks ", "tab\tand\r\nline", "café naïve 中文 \U0001f600\U0001f468‍\U0001f469", "<|endoftext|> is text", "<s> </s> <unk> <0x41>",
    "▁ a piece mark", " 　 wide", "x" * 3_000, "́combining é", "ﬁ ligature ① Å", "nul \x00 byte", "퟿�", "1234567890" * 30, " leading", "trailing ",
]


def test_equal_to_brute_force(spark):
    rng = random.Random(8)
    words = "the of and naming Streets unusual tokenizer café žluť 漢字 don't 3.14 https://x.org/a_b?c=d #tag".split()
    docs = list(enumerate(ODD)) + [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 80)))) for i in range(120)]
    docs += [(300, " ".join(rng.choice(words) for _ in range(4_000))), (None, "the the of"), (5, "the the of"), (5, "the the of")]
    want = brute_force(docs)
    assert sum(r[1] for r in want) > 10_000 and any(r[1] == 0 and r[0] in (10, 15) for r in want)
    for frequent in (1, 30, alignment.FREQUENT):
        assert found(spark, docs, frequent=frequent) == want


def test_empty_table_and_links(spark):
    df = spark.createDataFrame([(1, "two words")], "doc_id long, text string")
    assert alignment.align(df.filter("false")).collect() == []
    row = alignment.align(df, with_links=True).first()
    assert len(row["a"]) == len(row["b"]) == row["n_links"] == row["n_groups"]


def test_lockstep_over_lanes_of_any_length():
    rng = np.random.default_rng(3)
    lengths = np.arange(1, 8)
    for _ in range(30):
        pairs, want = [], []
        for _ in range(rng.integers(0, 9)):
            total = int(rng.integers(0, 200))
            sides = []
            for _ in range(2):
                cuts = np.unique(np.concatenate([rng.integers(0, total + 1, total // 2), np.arange(0, total, 7), [0, total]]))
                sides.append(np.diff(cuts) - 1)
            ends = [np.cumsum(s + 1).tolist() for s in sides]
            want.append([(ends[0].index(e), ends[1].index(e)) for e in ends[0] if e in ends[1]])
            pairs.append(tuple(sides))
        for stretch in (1, 3, 50, 10_000):
            got = alignment.aligned(pairs, lengths, lengths, stretch)
            assert [list(zip(i.tolist(), j.tolist())) for i, j in got] == want


def test_long_texts_take_time_in_proportion():
    pair = alignment.pair_of(*(public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))
    for text in ("some words of a long text, " * 40_000, "x" * 300_000, " " * 300_000):
        start = time.time()
        a, b = pair.encode(text)
        ((i, j),) = alignment.aligned([(a, b)], pair.tokens_a.lengths, pair.tokens_b.lengths)
        assert time.time() - start < 20 and len(i) and i[-1] == len(a) - 1 and j[-1] == len(b) - 1
