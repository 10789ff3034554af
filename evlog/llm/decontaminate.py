"""Benchmark decontamination by the q-gram lemma: shared q-grams are counted in overlapping diagonal bands, then aligned."""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import latest, per_process, texts_of

GRAM, FINE = 10, 5
#: Edits allowed per character of a benchmark passage; characters of a passage, and from one passage of a long item to the next.
EDITS, PASSAGE, STEP = 0.08, 400, 200
#: Characters of a window of a passage, and from one window to the next: a quote of WINDOW + WINDOW_STEP - 1 holds a window.
WINDOW, WINDOW_STEP = 120, 30
#: Bytes of benchmark text that one pass over the documents holds; a larger benchmark takes more passes.
BLOCK_BYTES = 2 << 20
SLOT_BITS = 20
#: Characters of a block of text, rows of a step of counting, and more than any text's characters.
BLOCK, ROWS_AT_ONCE, FAR = 1024, 1 << 20, 1 << 32
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def folding() -> np.ndarray:
    """Code point by code point: lower case where that is one character, and a blank for white space."""

    def make() -> np.ndarray:
        table = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x1E944):
            low = chr(c).lower()
            table[c] = 32 if chr(c).isspace() else ord(low) if len(low) == 1 else c
        return table

    return per_process("folding", make)


def codes_of(text: str | None) -> np.ndarray:
    """Folded code points, as many as the text has."""
    return folding()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")]


def grams_of(codes: np.ndarray, q: int = GRAM) -> np.ndarray:
    """A hash of every run of q code points: runs of 1, 2, 4, ... are hashed, and q is put together from those."""
    n = len(codes) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    run, length, factor = codes.astype(np.uint64) + np.uint64(1), 1, int(FACTOR)
    out, taken = None, 0
    while length <= q:
        if q & length:
            part = run[taken : taken + n]
            out = part.copy() if out is None else out * np.uint64(factor) + part
            taken += length
        if 2 * length <= q:
            run = run[:-length] * np.uint64(factor) + run[length:]
            factor = factor * factor % (1 << 64)
        length *= 2
    out ^= out >> np.uint64(31)
    return out * FACTOR


def fine_bound(size: int, budget: int) -> int:
    """Short q-grams that a text of ``size`` characters keeps under so many edits."""
    return size - FINE + 1 - FINE * budget


def passages(items: list[tuple], passage: int = PASSAGE, step: int = STEP) -> list[tuple]:
    """(item, start, codes): whole items, or overlapping passages of long ones that leave out no character."""
    out = []
    for item, text in items:
        codes = codes_of(text)
        inside = np.flatnonzero(codes != 32)
        if not len(inside):
            continue
        first, end = inside[0], inside[-1] + 1
        while end - first > passage + step:
            out.append((item, int(first), codes[first : first + passage]))
            first += step
        out.append((item, int(first), codes[first:end]))
    return out


class Index:
    """Sorted q-grams of passages with their places, and a table of slots that tells most foreign q-grams at once."""

    def __init__(self, items: list[tuple], q: int = GRAM, edits: float = EDITS):
        self.q = q
        self.passages = passages(items)
        self.budget = np.array([int(edits * len(c)) for _, _, c in self.passages], np.int64)
        size = np.array([len(c) for _, _, c in self.passages], np.int64)
        # the lemma's bound; passages too short for it at this budget get the largest budget that leaves one q-gram
        self.budget = np.maximum(np.minimum(self.budget, (size - q) // q), 0)
        self.bound = np.maximum(size - q + 1 - self.budget * q, 1)
        # windows of each passage longer than one, the last at its end; the grams of a passage serve its windows too
        self.last = size - WINDOW
        self.windows = np.where(self.last > 0, -(-self.last // WINDOW_STEP) + 1, 0)
        self.window_budget = max(0, min(int(edits * WINDOW), (WINDOW - q) // q))
        self.window_bound = max(1, WINDOW - q + 1 - self.window_budget * q)
        self.least = np.where(self.windows > 0, np.minimum(self.bound, self.window_bound), self.bound)
        grams = [grams_of(c, q) for _, _, c in self.passages]
        keys = np.concatenate([np.zeros(0, np.uint64), *grams])
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in grams]])
        order = np.argsort(keys, kind="stable")
        self.keys, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.owner, self.place = owner[order], place[order]
        self.slots = np.zeros(1 << SLOT_BITS, bool)
        self.slots[(self.keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = True
        self.short = [(p, c) for p, (_, _, c) in enumerate(self.passages) if len(c) < q]
        # by passage: its q-grams' numbers, in order of place and of number; by q-gram: the passages that have it, and at how many places
        self.grams = [np.searchsorted(self.keys, g) for g in grams]
        self.fine = [grams_of(c, FINE) for _, _, c in self.passages]
        self.by_gram = [(order, g[order]) for g, order in ((g, np.argsort(g, kind="stable")) for g in self.grams)]
        pairs, weight = np.unique(np.repeat(np.arange(len(self.keys)), self.count) * max(1, len(grams)) + self.owner, return_counts=True)
        self.holder, self.weight = pairs % max(1, len(grams)), weight
        self.holder_first = np.searchsorted(pairs, np.arange(len(self.keys)) * max(1, len(grams)))
        self.holders = np.diff(np.append(self.holder_first, len(pairs)))
        # any alignment of a passage lies within two blocks, that in which it begins and the next
        self.block = max([BLOCK, *(size + 2 * self.budget + 2).tolist()])

    def known(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a text whose q-gram some passage has, and the q-gram's number."""
        grams = grams_of(codes, self.q)
        at = np.flatnonzero(self.slots[(grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        same = self.keys[k] == grams[at]
        return at[same], k[same]

    def nominated(self, at: np.ndarray, k: np.ndarray) -> Iterator[tuple[int, int]]:
        """(block, passage): passages of which enough places have their q-gram somewhere in the block or the one behind it.

        A q-gram counts once for a pair of blocks, however often a text repeats it, so repetitive texts cost no more than others.
        """
        blocks = np.concatenate([at // self.block, at // self.block - 1])
        pairs = np.unique(blocks * len(self.keys) + np.concatenate([k, k]))
        pairs = pairs[pairs >= 0]  # nothing begins before the first block
        block, key = pairs // len(self.keys), pairs % len(self.keys)
        n = self.holders[key]
        before = np.cumsum(n) - n
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
        lo = 0
        while lo < len(first):  # whole blocks, about a million rows at once
            hi = max(lo + 1, int(np.searchsorted(before[first], before[first[lo]] + ROWS_AT_ONCE)))
            rows = slice(first[lo], first[hi] if hi < len(first) else len(block))
            m = n[rows]
            entry = np.repeat(self.holder_first[key[rows]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            cell = np.repeat(block[rows] - block[first[lo]], m) * len(self.passages) + self.holder[entry]
            found, cell = np.unique(cell, return_inverse=True)
            total = np.bincount(cell, weights=self.weight[entry], minlength=len(found))
            enough = found[total >= self.least[found % len(self.passages)]]
            yield from zip((enough // len(self.passages) + block[first[lo]]).tolist(), (enough % len(self.passages)).tolist())
            lo = hi

    def shared(self, p: int, at: np.ndarray, k: np.ndarray, first: int, last: int, width: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(band, shared q-grams): how many of the places first to last of a passage have their q-gram in the text within the band.

        ``at`` and ``k`` are the text's places in order of their q-grams. Bands begin at ``low`` to ``high``, in steps of ``width``,
        and hold two steps of diagonals, so any drift within the budget lies whole in one of them.
        """
        order, ranked = self.by_gram[p]
        left, right = np.searchsorted(ranked, k, side="left"), np.searchsorted(ranked, k, side="right")
        n = right - left
        if n.sum() <= len(ranked) * (-(-(high - low) // width) + 1):  # few meetings: one row each
            entry = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
            place, pos = order[entry], np.repeat(at, n)
            some = (place >= first) & (place <= last)
            place, band = place[some], (pos[some] - place[some]) // width
            band, place = np.concatenate([band, band - 1]), np.concatenate([place, place])
            some = (band * width >= low) & (band * width < high)
            rows = np.unique(band[some] * (1 << 20) + place[some])
            return np.unique(rows >> 20, return_counts=True)
        # many meetings: a place asks, for each band, whether its q-gram is there
        bands = np.arange(-(-low // width), -(-high // width))
        place = np.arange(first, last + 1)
        text = k * FAR + at
        begin = self.grams[p][place][:, None] * FAR + np.maximum(place[:, None] + bands * width, 0)
        end = self.grams[p][place][:, None] * FAR + np.maximum(place[:, None] + (bands + 2) * width, 0)
        count = (np.searchsorted(text, end) > np.searchsorted(text, begin)).sum(axis=0)
        return bands[count > 0], count[count > 0]

    def candidates(self, codes: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(block, passage, windows): where a passage (window -1) or its windows may lie, by both sizes of q-grams.

        Long q-grams nominate; the short ones, of which an edit destroys fewer, tell runs of blanks and the like from real matches.
        """
        at, k = self.known(codes)
        fine, block, out, seen = grams_of(codes, FINE), -1, [], None
        for s, p in sorted(self.nominated(at, k)):
            if s != block:
                block, seen = s, np.unique(fine[s * self.block : (s + 2) * self.block])
            if not len(seen):
                continue
            there = seen[np.minimum(np.searchsorted(seen, self.fine[p]), len(seen) - 1)] == self.fine[p]
            has = np.concatenate([[0], np.cumsum(there)])
            begin = np.minimum(np.arange(self.windows[p]) * WINDOW_STEP, self.last[p])
            spans = has[np.minimum(begin + WINDOW - FINE + 1, len(has) - 1)] - has[begin]
            windows = np.flatnonzero(spans >= fine_bound(WINDOW, self.window_budget))
            if has[-1] >= fine_bound(len(self.passages[p][2]), int(self.budget[p])):
                windows = np.concatenate([[-1], windows])
            if len(windows):
                out.append((s, p, windows))
        return out

    def span(self, p: int, w: int) -> tuple[int, int, int]:
        """(first character, characters, budget) of a window of a passage, or of the whole one."""
        if w < 0:
            return 0, len(self.passages[p][2]), int(self.budget[p])
        return min(w * WINDOW_STEP, int(self.last[p])), WINDOW, self.window_budget

    def bands(self, codes: np.ndarray, found: list[tuple[int, int, np.ndarray]], whole: bool, skip=lambda p, start, end: False) -> Iterator[tuple[int, int, int, int, int]]:
        """(passage, window, first diagonal, last diagonal, shared q-grams) of the candidates' bands that reach the bound.

        Those of whole passages (window -1) or those of windows, each block by block. ``skip`` tells blocks that need no look.
        """
        at, k = self.known(codes)
        for s, p, windows in found:
            some = [int(w) for w in windows if (w < 0) == whole]
            if not some or skip(p, s * self.block, (s + 2) * self.block):
                continue
            here = slice(*np.searchsorted(at, [s * self.block, (s + 2) * self.block]))
            order = np.argsort(k[here], kind="stable")
            text = at[here][order], k[here][order]
            for w in some:
                begin, size, budget = self.span(p, w)
                bound = self.bound[p] if w < 0 else self.window_bound
                low = -2 * self.block if s == 0 else s * self.block  # an alignment may begin before the text
                for band, shared in zip(*self.shared(p, *text, begin, begin + size - self.q, budget + 1, low - begin, (s + 1) * self.block - begin)):
                    if shared >= bound:
                        yield p, w, int(band) * (budget + 1), int(band + 2) * (budget + 1) - 1, int(shared)

    def matches(self, text: str | None) -> list[tuple]:
        """(item, item_start, start, end, edits, shared): regions of a text within the edit budget of a passage or window, the best of each place.

        A window's region is told where it meets no region of the same item that is a whole passage's or a better window's.
        """
        codes = codes_of(text)
        fine = grams_of(codes, FINE)
        found: dict[tuple, tuple] = {}
        parts: list[tuple] = []
        inside, exact = defaultdict(Covered), defaultdict(Covered)

        def region(p: int, w: int, low: int, high: int) -> tuple[int, int, int] | None:
            """The best region of a band, if it can be of use."""
            item, item_start, passage = self.passages[p]
            begin, size, budget = self.span(p, w)
            low, high, place = low + begin, high + begin, (item, item_start if w < 0 else -1)
            # every region of this band would meet one without edits that begins before it, and give way to it
            if exact[place].around(low - budget, high + budget):
                return None
            near = fine[max(0, low - budget) : max(0, high + size + budget)]
            if np.isin(self.fine[p][begin : begin + size - FINE + 1], near).sum() < fine_bound(size, budget):
                return None
            hit = aligned(passage[begin : begin + size], codes, low, high, budget)
            if hit and hit[2] == 0:
                exact[place].add(*hit[:2])
            return hit

        candidates = self.candidates(codes)
        for p, w, low, high, shared in self.bands(codes, candidates, True):
            hit = region(p, w, low, high)
            if hit:
                item, item_start, passage = self.passages[p]
                inside[item].cover(*hit[:2])
                key = (p, hit[0] // max(1, len(passage) // 2))
                if key not in found or hit[2] < found[key][4]:
                    found[key] = (item, item_start, *hit, shared)

        def known_inside(p: int, start: int, end: int) -> bool:
            return inside[self.passages[p][0]].around(start, min(end, len(codes)) - 1)

        for p, w, low, high, shared in self.bands(codes, candidates, False, known_inside):
            item, item_start, _ = self.passages[p]
            begin = self.span(p, w)[0]
            hit = None if inside[item].holds((low + high) // 2 + begin + WINDOW // 2) else region(p, w, low, high)
            if hit:
                parts.append((item, item_start + begin, *hit, shared))
        for p, passage in self.short:
            item, item_start, _ = self.passages[p]
            for start in occurrences(passage, codes):
                found[p, -start - 1] = (item, item_start, start, start + len(passage), 0, 0)
        kept: list[tuple] = []
        taken, of_item = defaultdict(Covered), defaultdict(Covered)
        for m in sorted(found.values(), key=lambda m: (m[0], m[1], m[4], m[2])):  # neighbouring bands may find one place twice
            if taken[m[:2]].add(m[2], m[3]):
                kept.append(m)
                of_item[m[0]].cover(m[2], m[3])
        for m in sorted(parts, key=lambda m: (m[0], m[4], m[2], m[1])):
            if of_item[m[0]].add(m[2], m[3]):
                kept.append(m)
        return kept


class Covered:
    """A union of intervals of one text, kept as those that don't touch, in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, at: int) -> bool:
        k = bisect_right(self.starts, at) - 1
        return k >= 0 and at < self.ends[k]

    def around(self, first: int, last: int) -> bool:
        """Whether one interval holds both places."""
        k = bisect_right(self.starts, first) - 1
        return k >= 0 and last < self.ends[k]

    def cover(self, start: int, end: int) -> None:
        lo, hi = bisect_left(self.ends, start), bisect_right(self.starts, end)
        if lo < hi:
            start, end = min(start, self.starts[lo]), max(end, self.ends[hi - 1])
        self.starts[lo:hi], self.ends[lo:hi] = [start], [end]

    def add(self, start: int, end: int) -> bool:
        """Add an interval unless it meets one of the union."""
        k = bisect_right(self.ends, start)
        if k < len(self.starts) and self.starts[k] < end:
            return False
        self.cover(start, end)
        return True


def occurrences(passage: np.ndarray, codes: np.ndarray) -> list[int]:
    n = len(codes) - len(passage) + 1
    if n < 1 or not len(passage):
        return []
    hit = codes[:n] == passage[0]
    for k in range(1, len(passage)):
        hit &= codes[k : k + n] == passage[k]
    return np.flatnonzero(hit).tolist()


def aligned(passage: np.ndarray, codes: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Best (start, end, edits) of the passage within the band of diagonals, or None above the budget.

    Row by row edit distance of the passage against the region, computed only near the band. Each cell carries where its
    alignment starts; ties go to the earlier start.
    """
    m, last = len(passage), len(codes)
    for d in range(max(0, low), min(high, last - m) + 1):
        if np.array_equal(codes[d : d + m], passage):
            return d, d + m, 0
    low, high = low - budget, high + budget
    width = high - low + 1
    far = m + width + 1
    column = np.arange(width) + low  # text position before which row 0 of the band stands
    cost = np.where((column >= 0) & (column <= last), 0, far)
    start = column.copy()
    for i in range(1, m + 1):
        at = np.arange(width) + low + i  # text prefix length of each cell in this row
        inside = (at >= 0) & (at <= last)
        letter = codes[np.clip(at - 1, 0, last - 1)] if last else np.zeros(width, np.uint32)
        across = cost + np.where((at >= 1) & (letter == passage[i - 1]), 0, 1)
        across = np.where(at >= 1, across, far)
        down = np.append(cost[1:] + 1, far)  # passage letter left out
        down_start = np.append(start[1:], 0)
        take = down < across
        best, begin = np.where(take, down, across), np.where(take, down_start, start)
        # text letters put in: cost grows by one per cell to the right
        slope = best - np.arange(width)
        run = np.minimum.accumulate(slope)
        source = np.maximum.accumulate(np.where(slope == run, np.arange(width), 0))
        cost = np.where(inside, run + np.arange(width), far)
        start = begin[source]
        if i % 8 == 0 and cost.min() > budget:  # costs never fall from row to row
            return None
    k = int(np.argmin(cost))
    if cost[k] > budget:
        return None
    return int(max(0, start[k])), int(k + low + m), int(cost[k])


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple]]:
    """The benchmark in blocks of about ``limit`` bytes, by a hash of the item: what a pass holds is bounded."""
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).filter("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // limit))
    for b in range(n):
        block = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b) if n > 1 else items
        yield [(r.item, r.text) for r in block.orderBy("item", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per region of a document that repeats a benchmark passage: id, item_id, item_start, start, end, edits, shared.

    Passages are whole items, or overlapping passages of items over 600 characters, and all windows of 120 characters of
    these, every 30: any quote of 149 characters of an item holds a window, wherever it begins, so it is found. Shorter
    ones are found if they hold a window or are a whole item. Characters are compared after folding
    case and white space, one for one, so start and end count the code points of the document. A region is
    kept if its edit distance to the passage or window is at most ``edits`` per character; shared is its number of common q-grams.
    A passage too short for that budget under the lemma gets the largest budget it allows; one shorter than a q-gram must
    occur exactly. Null and empty texts on either side match nothing; null ids are carried; repeated
    rows are each reported; equal items once; other columns are left out. Narrow: the benchmark goes to the tasks in blocks of bounded size.
    """
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    fields = f"{id_col} {id_type}, {item_col} {item_type}, item_start int, start int, end int, edits int, shared int"
    out = None
    for items in blocks_of(benchmark, item_col, item_text_col, block_bytes):
        sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            index = latest("benchmark", name, lambda: Index(sent.value, edits=edits))
            for batch in batches:
                row, found = [], []
                for i, text in enumerate(texts_of(batch, text_col)):
                    for m in index.matches(text):
                        row.append(i)
                        found.append(m)
                columns = list(zip(*found)) or [()] * 6
                names = [id_col, item_col, "item_start", "start", "end", "edits", "shared"]
                item_arrow = pa.array(columns[0], {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_type])
                yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(row, pa.int64())), item_arrow, *(pa.array(c, pa.int32()) for c in columns[1:])], names=names)

        part = docs.select(id_col, text_col).mapInArrow(search, fields)
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, as they are, that hold no region of ``contaminated``; all columns stay."""
    for items in blocks_of(benchmark, item_col, item_text_col, block_bytes):
        sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def clean(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            index = latest("benchmark", name, lambda: Index(sent.value, edits=edits))
            for batch in batches:
                yield batch.filter(pa.array([not index.matches(t) for t in texts_of(batch, text_col)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
