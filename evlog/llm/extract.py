"""Main text of web pages: words score positive, tags negative, and a linear scan finds the best contiguous region."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, texts_of

#: Pages that the weights are learned from, and how many words they must have inside and outside of their article.
LABELLED_PAGES, LEAST_COUNT = 600, 5
#: Containers around a text, from the innermost, whose marks are learned.
NEAREST = 64

# Names of HTML elements by their kind, and words that sites name their page furniture by.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTENT = frozenset("article main".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button select label fieldset datalist figcaption svg canvas audio video object map applet".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices "
    "alert newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist reply replies respond "
    "disqus discussion sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar popup modal overlay search searchbox "
    "widget widgets pagination pager tags tagcloud skip hidden copyright legal disclaimer outbrain taboola".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
ATTRIBUTES = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content is no markup; parts of class names that say what a container hasn't, or has beside itself; and
#: parts that say no more than that something is held.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BESIDE = frozenset("no not without has with".split())
HOLDERS = frozenset("area bar block body bottom box button buttons col column container content group holder inner item items left link links list main outer panel post posts right row section text top wrap wrapper".split())
TAG_START = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?])|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)|/)")
COMMENT_END = re.compile(r"--!?>")
UNQUOTED = re.compile(r"""[^>"']*""")


@dataclass
class Weights:
    """Score of a word by the containers around it, and (negative) score of a tag by its name."""

    marks: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def mark(self, mark: str) -> float:
        """Of a container: negative for page furniture, positive for content, 0 where nothing is known."""
        if mark in self.marks:
            return self.marks[mark]
        kind, _, name = mark.partition(":")
        if kind == "tag":
            return 2.0 if name in CONTENT else -2.0 if name in FURNITURE else 0.0
        return -2.0 if (name in FURNITURE_ROLES if kind == "role" else name in FURNITURE_NAMES) else 0.0

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.5)


def names_of(word: str) -> set[str]:
    """A class or id and what it says about its container: the last part of a compound, and the first if the last only holds.

    ``no-sidebar``, ``has-sidebar`` and ``with-header`` are about something else than the container itself.
    """
    parts = [p for p in re.split(r"[-_]+", word) if p]
    if len(parts) < 2 or parts[0] in BESIDE:
        return {word}
    return {word, parts[-1]} | ({parts[0]} if parts[-1] in HOLDERS or parts[-1].isdigit() else set())


def marks_of(name: str, attrs: str) -> list[str]:
    """A container's own marks: its name where that has a meaning, its classes and id, their parts, and its role.

    The whole page is never judged by its names: sites put layout classes on ``html`` and ``body``.
    """
    out = [f"tag:{name}"] if name in CONTENT or name in FURNITURE else []
    if name in ("html", "body"):
        return out
    if attrs and "=" in attrs or "hidden" in attrs:
        for m in ATTRIBUTES.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                for word in value.split():
                    out += [f"name:{p}" for p in names_of(word)]
            elif key == "role":
                out.append(f"role:{value.strip()}")
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                out.append("name:hidden")
    return out


class Node:
    """An open container with marks of its own, the one around it, and how many articles stand in it."""

    __slots__ = ("above", "name", "marks", "articles", "verdict")

    def __init__(self, above: Node | None, name: str, marks: list[str]):
        self.above, self.name, self.marks, self.articles, self.verdict = above, name, marks, 0, None


def tags_of(page: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, name, attributes, closing) of every tag; comments and raw elements have no name. In time with the length.

    A quoted attribute may hold ``>``. Where quotes leave a tag without an end, quotes mean nothing from there on.
    """
    at, quotes, lower = 0, True, page.lower() if len(page) else page
    while True:
        m = TAG_START.search(page, at)
        if not m:
            return
        if m["comment"]:
            end = COMMENT_END.search(page, m.end())
            at = end.end() if end else len(page)
            yield m.start(), at, "", "", False
            continue
        end = -1
        if m["name"] and quotes:
            k = m.end()
            while True:
                k = UNQUOTED.match(page, k).end()
                if k >= len(page):
                    quotes = False  # for the rest of the page, so this is met once
                    break
                if page[k] == ">":
                    end = k
                    break
                k = page.find(page[k], k + 1) + 1
                if not k:
                    quotes = False
                    break
        if end < 0:
            end = page.find(">", m.end())
            if end < 0:
                return  # no tag ends after this place: the rest is text
        name = (m["name"] or "").lower()
        attrs = page[m.end("name") : end] if name else ""
        if name in RAW and not m["end"]:
            close = lower.find(f"</{name}", end) if len(lower) == len(page) else re.compile(f"</{name}", re.IGNORECASE).search(page, end)
            close = close if isinstance(close, int) else close.start() if close else -1
            end = page.find(">", close) if close >= 0 else -1
            at = end + 1 if end >= 0 else len(page)
            yield m.start(), at, "", "", False
            continue
        at = end + 1
        yield m.start(), at, name, attrs, bool(m["end"])


Event = tuple[str, str, "Node | None"]


def events_of(page: str) -> Iterator[Event]:
    """(kind, value, innermost container with marks): kind is ``text``, or ``open`` or ``close`` with an element's name."""
    stack: list[tuple[str, Node | None, int]] = []  # element, its node or the one around it, place of the innermost block
    opened: Counter[str] = Counter()
    at = 0

    def cut(k: int) -> None:
        while len(stack) > k:
            name, node, _ = stack.pop()
            opened[name] -= 1
            above = stack[-1][1] if stack else None
            if above is not None and node is not above:
                above.articles += node.articles + (node.name == "article")

    for start, end, name, attrs, closing in tags_of(page):
        if start > at:
            yield "text", page[at:start], stack[-1][1] if stack else None
        at = end
        if not name:
            continue
        if closing:
            if opened[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                cut(k)
            yield "close", name, None
            continue
        if name in BLOCKS and stack and stack[-1][2] >= 0:  # a new block ends an open paragraph, a list item the one before it
            k = stack[-1][2]
            if stack[k][0] == ("li" if name == "li" else "p"):
                cut(k)
        yield "open", name, None
        if name not in VOID and not attrs.endswith("/"):
            above = stack[-1][1] if stack else None
            own = marks_of(name, attrs)
            node = Node(above, name, own) if own else above
            stack.append((name, node, len(stack) if name in BLOCKS else stack[-1][2] if stack else -1))
            opened[name] += 1
    if at < len(page):
        yield "text", page[at:], stack[-1][1] if stack else None
    cut(0)


def learn(pages: list[str]) -> Weights:
    """Weights from pages whose main text is labelled by one ``article`` element: log odds of standing inside or outside of it."""
    inside, outside, tags_in, tags_out = Counter(), Counter(), Counter(), Counter()
    for page in pages:
        depth, words, nodes = 0, {}, {}
        for kind, value, node in events_of(page):
            if kind == "text":
                n = len(value.split())
                (inside if depth else outside)[""] += n
                if node is not None:
                    nodes[id(node)] = node
                    words[id(node), depth > 0] = words.get((id(node), depth > 0), 0) + n
            elif value == "article":
                depth += 1 if kind == "open" else -1
            elif kind == "open":
                (tags_in if depth else tags_out)[value] += 1
        for (key, within), n in words.items():  # a mark counts once a text, however many containers around it have it
            marks, node, far = set(), nodes[key], 0
            while node is not None and far < NEAREST:
                marks.update(node.marks)
                node, far = node.above, far + 1
            (inside if within else outside).update(dict.fromkeys(marks, n))
    weights = Weights()
    if not inside[""] or not outside[""]:
        return weights
    base = log((inside[""] + 1) / (outside[""] + 1))
    for mark in inside | outside:
        if mark and inside[mark] + outside[mark] >= LEAST_COUNT:
            weights.marks[mark] = max(-4.0, min(4.0, log((inside[mark] + 1) / (outside[mark] + 1)) - base))
    for name in tags_in | tags_out:
        # a tag costs at most one word: lists and tables inside a text don't part it
        odds = log((tags_in[name] + 1) / (sum(tags_in.values()) + 1)) - log((tags_out[name] + 1) / (sum(tags_out.values()) + 1))
        weights.tags[name] = -max(0.02, min(1.0, 0.5 - odds / 4))
    return weights


TAGGED, NAMED, CLEAR = "tagged", "named", "clear"


def verdict(node: Node | None, weights: Weights) -> tuple[str, float]:
    """Whether a container is page furniture, by its element or only by its names, and the score of a word in it.

    Marks of furniture hold for all that stands below, but a lone article, or the main element, outweighs names above it
    (not elements such as ``aside``); a header inside of content belongs to the content.
    """
    path = []
    while node is not None and node.verdict is None:
        path.append(node)
        node = node.above
    state, score, article = node.verdict if node is not None else (CLEAR, 1.0, False)
    for node in reversed(path):
        against = [m for m in node.marks if weights.mark(m) <= -1]
        high = max((weights.mark(m) for m in node.marks), default=0.0)
        if f"tag:{node.name}" in against and not (node.name == "header" and article and len(against) == 1):
            state = TAGGED
        elif any(m != f"tag:{node.name}" for m in against):
            lone = node.articles == 1 and node.name != "article"
            state = state if state == TAGGED or lone and state == CLEAR else NAMED
            if lone and state == CLEAR:
                high = 0.0
        elif node.name == "main" and state == NAMED:
            state = CLEAR
        article = article or state == CLEAR and node.name in CONTENT
        score = max(score, high)
        node.verdict = (state, score, article)
    return state, score


def main_text(page: str | None, weights: Weights) -> str:
    """The blocks of the best region, one a line; empty if no region scores above zero."""
    events, scores = list(events_of(page or "")), []
    for kind, value, node in events:
        if kind == "text":
            state, score = verdict(node, weights)
            scores.append((score if state == CLEAR else -2.0) * len(value.split()))
        else:
            scores.append(weights.tag(value) if kind == "open" or value in BLOCKS else 0.0)
    best, best_range, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):  # maximum-scoring contiguous run, in one pass
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, best_range = total, (start, i + 1)
    blocks, block = [], []
    for i in range(*best_range):
        kind, value, _ = events[i]
        if kind == "text":
            if scores[i] >= 0:
                block.append(html.unescape(value))
        elif value == "br":
            block.append(" ")
        elif value in BLOCKS:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def train(pages: DataFrame, html_col: str = "html", limit: int = LABELLED_PAGES) -> Weights:
    """Weights from at most ``limit`` pages, chosen by a hash, with exactly one article element; none: the fixed ones."""
    low = F.lower(F.col(html_col))
    once = (F.regexp_count(low, F.lit("<article[ >]")) == 1) & low.contains("</article>")
    usable = pages.filter(once & (F.length(html_col) < 200_000))
    some = bounded_sample(usable, limit, pages.count() // 2, html_col)  # enough if half of all pages are usable; else fewer teach
    return learn([r[0] for r in some.select(html_col).collect()])


def extract(pages: DataFrame, weights: Weights, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` without the html, with the main text and n_chars (its code points).

    A null, empty or textless page has an empty text. Null ids and urls and repeated rows pass through, as do other
    columns, but for those named as the results; an empty table stays empty. Narrow: pages are read one by one, whole.
    """
    kept = [c for c in pages.columns if c not in (html_col, text_col, "n_chars")]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept) + f"{', ' if kept else ''}`{text_col}` string, n_chars long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) for page in texts_of(batch, html_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, text_col, "n_chars"])

    return pages.select(*kept, F.col(html_col)).mapInArrow(read, schema)
