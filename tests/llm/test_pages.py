"""URL filters, WARC archives and main-text extraction."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import pytest

from evlog.llm import extract, urlfilter, warc
from evlog.llm.common import shared_folder

# ---- URL filters --------------------------------------------------------------------------------------------------------

ENTRIES = "list string, pattern string, action string, effective long"
CAPTURES = "page_id long, url string, fetch_time long, verdict string"


def plain_patterns(url):
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)", url or "")
    host = m[1].lower().rstrip(".") if m else ""
    if not host:
        return []
    labels, steps = host.split("."), [s for s in m[2].split("/") if s]
    return [".".join(labels[i:]) for i in range(len(labels))] + [f"{host}/{'/'.join(steps[: i + 1])}" for i in range(len(steps))]


def plain_verdict(url, time, entries):
    rank = {"remove": 0, "block": 1, "allow": 2}
    best = []
    for pattern in plain_patterns(url):
        for name in {e[0] for e in entries if e[0]}:
            past = [(e[3], rank[e[2]]) for e in entries if e[0] == name and e[1] == pattern and e[2] in rank and e[3] is not None and time is not None and e[3] <= time]
            if past and max(past)[1]:
                start, kind = max(past)
                best.append((-len(pattern), -kind, name, pattern, start))
    if not best:
        return ("none", None, None, None)
    _, kind, name, pattern, start = min(best)
    return ("allow" if kind == -2 else "block", name, pattern, start)


def test_captures_meet_the_entries_of_their_time(spark):
    rng = random.Random(2)
    hosts = ["hot.example.org", "a.b.example.org", "x.test", "UP.Example.ORG.", "10.0.0.1"]
    urls = [f"http://{'u:p@' * (rng.random() < 0.1)}{rng.choice(hosts)}{':80' * (rng.random() < 0.2)}/{rng.choice(['', 'a', 'a/b', 'a//b/c', 'd?q=/a', 'a#/b'])}" for _ in range(300)]
    rows = [(i, u, rng.randrange(0, 400) * 86_400, "old") for i, u in enumerate(urls)]
    rows += [(900 + i, "http://hot.example.org/a", 5_000_000, "old") for i in range(200)]  # one hot capture
    rows += [(1, None, 5, ""), (None, "http://x.test/", 9_000_000, None), (2, "http://x.test/", None, ""), (3, "no url", 7, ""), (4, "mailto:a@b", 7, ""), (5, "http:///path", 7, ""), (5, "http:///path", 7, "")]
    patterns = ["example.org", "hot.example.org", "hot.example.org/a", "hot.example.org/a/b", "a.b.example.org", "test", "x.test", "org", "b.example.org", "10.0.0.1"]
    entries = [(rng.choice("AB"), rng.choice(patterns), rng.choice(["block", "allow", "remove"]), rng.randrange(0, 40) * 864_000) for _ in range(150)]
    entries += [("A", "x.test", "block", 0), ("A", "x.test", "allow", 0), (None, "x.test", "block", 0), ("A", None, "block", 0), ("A", "x.test", "odd", 0), ("A", "org", "block", None), ("B", "x.test", None, 1)]
    intervals = urlfilter.validity_intervals(spark.createDataFrame(entries + entries[:9], ENTRIES))
    got = urlfilter.judge(spark.createDataFrame(rows, CAPTURES).selectExpr("*", "1 as _key", "2 as action", "3 as _hot"), intervals)
    assert {(r._key, r.action, r._hot) for r in got.collect()} == {(1, 2, 3)}
    got = got.drop("_key", "action", "_hot")
    assert got.columns == ["page_id", "url", "fetch_time", "verdict", "list", "pattern", "valid_from"]
    assert Counter(map(tuple, got.collect())) == Counter((i, u, t, *plain_verdict(u, t, entries)) for i, u, t, _ in rows)


def test_no_captures_and_no_entries(spark):
    captures = spark.createDataFrame([(1, "http://a.b/", 5, "")], CAPTURES)
    none = urlfilter.validity_intervals(spark.createDataFrame([], ENTRIES))
    assert [r.verdict for r in urlfilter.judge(captures, none).collect()] == ["none"]
    assert urlfilter.judge(captures.limit(0), none).count() == 0


def test_the_main_path_runs_no_python(spark):
    captures = spark.createDataFrame([(1, "http://a.b/", 5, "")], CAPTURES)
    none = urlfilter.validity_intervals(spark.createDataFrame([], ENTRIES))
    assert not re.search("Python|Arrow|Pandas", urlfilter.judge(captures, none)._jdf.queryExecution().executedPlan().toString())


# ---- WARC -------------------------------------------------------------------------------------------------------------------

PAGES = [(5, "http://a/", "same"), (2, "http://b/%0A", "same"), (9, None, "ünï\r\n\r\ncode WARC/1.1 🙂"), (None, "http://n/", "same"), (3, "http://c/", None), (4, "x\r\ny", ""), (6, "http://d/", "z" * 300_000), (6, "http://d/", "z" * 300_000), (None, None, "alone")]


def round_trip(spark, rows, parts=3):
    folder = shared_folder(spark)
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int").repartition(parts)
    warc.write_streams(pages, f"{folder}/streams")
    index = warc.normalise(spark, f"{folder}/streams", f"{folder}/archives")
    return folder.removeprefix("file:"), index


def test_archives_round_trip(spark):
    folder, index = round_trip(spark, PAGES)
    records = warc.read_members(index).collect()
    text = lambda i: None if i is None else str(i)
    held = {(r.page_id, r.payload_digest): bytes(r.payload) for r in records if r.record_type == "response"}
    payload = lambda r: held[r.refers_to if r.record_type == "revisit" else r.page_id, r.payload_digest]
    assert Counter((r.page_id, r.url, payload(r).decode()) for r in records) == Counter((text(i), u, h or "") for i, u, h in PAGES)
    assert all(r.payload_bytes == len(payload(r)) and r.payload_digest == base64.b32encode(hashlib.sha1(payload(r)).digest()).decode() for r in records)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in records)
    assert Counter(r.warc_type for r in index.collect()) == Counter(r.record_type for r in records) == {"response": 6, "revisit": 3}
    streams, archives = sorted(Path(folder, "streams").glob("*.gz")), sorted(Path(folder, "archives").glob("*.warc.gz"))
    assert Counter(gzip.decompress(p.read_bytes()) for p in streams) == Counter(gzip.decompress(p.read_bytes()) for p in archives)
    for p in archives:  # each index line names one gzip member that holds one record, and together they are the file
        rows = index.filter(index.path.endswith(p.name)).orderBy("offset").collect()
        raw, at = p.read_bytes(), 0
        for r in rows:
            assert r.offset == at
            assert gzip.decompress(raw[at : at + r.length]).startswith(b"WARC/1.1\r\n")
            at += r.length
        assert at == len(raw)
        assert len(Path(f"{p}.cdxj").read_text().splitlines()) == len(rows)
    assert not [p for p in Path(folder, "archives").iterdir() if p.name.startswith("_draft")]


def test_revisits(spark):
    _, index = round_trip(spark, PAGES)
    records = warc.read_members(index, with_payload=False)
    records = records.withColumn("page_id", records.page_id.cast("long"))
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.mark_revisits(records).collect())
    stored = Counter((int(r.page_id) if r.page_id else None, r.payload_bytes, r.record_type, int(r.refers_to) if r.refers_to else None) for r in warc.read_members(index, with_payload=False).collect())
    assert stored == got  # what the archives say is what the digests say
    n = len(PAGES[2][2].encode())
    want = [(5, 4, "revisit", 2), (2, 4, "response", None), (None, 4, "revisit", 2), (9, n, "response", None), (3, 0, "response", None), (4, 0, "revisit", 3), (6, 300_000, "response", None), (6, 300_000, "response", None), (None, 5, "response", None)]
    assert got == Counter(want)
    small = {(r.page_id, r.record_type) for r in warc.mark_revisits(records, at_least=5).collect()}
    assert (5, "response") in small and (4, "response") in small


def test_revisits_name_the_record_they_repeat(spark):
    folder, index = round_trip(spark, PAGES)
    heads = {}
    for p in Path(folder, "archives").glob("*.warc.gz"):
        for record in gzip.decompress(p.read_bytes()).split(b"WARC/1.1\r\n")[1:]:
            head = dict(line.split(": ", 1) for line in record.split(b"\r\n\r\n")[0].decode().split("\r\n"))
            heads.setdefault(head["WARC-Record-ID"], head) if "WARC-Record-ID" in head else None
    again = [h for h in heads.values() if h["WARC-Type"] == "revisit"]
    assert len(again) == 3 and all(heads[h["WARC-Refers-To"]]["WARC-Type"] == "response" and heads[h["WARC-Refers-To"]]["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] for h in again)


def test_no_pages(spark):
    _, index = round_trip(spark, [], 1)
    assert warc.mark_revisits(warc.read_members(index, with_payload=False)).count() == 0


def test_streams_of_members_and_broken_ones():
    import io

    records = [warc.record_of(i, f"http://h/{i}", "body " * i).encode() + b"\r\n\r\n" for i in range(50)]
    whole = gzip.compress(b"".join(records))
    members = b"".join(gzip.compress(r) for r in records)
    for raw in (whole, members, b""):
        found = list(warc.records_in(warc.inflated(io.BytesIO(raw))))
        assert found == (records if raw else [])
    with pytest.raises(ValueError):
        list(warc.records_in(warc.inflated(io.BytesIO(gzip.compress(b"".join(records)[:-9])))))
    with pytest.raises((ValueError, KeyError)):
        list(warc.records_in(warc.inflated(io.BytesIO(gzip.compress(b"HTTP/1.1 200\r\n\r\n\r\n")))))
    with pytest.raises(zlib.error):
        list(warc.records_in(warc.inflated(io.BytesIO(b"not gzip at all"))))


# ---- main text --------------------------------------------------------------------------------------------------------------

BODY = "<p>First words of the text &amp; more &eacute;.</p><p>Second <b>bold</b>ly <a href='/x'>linked</a> part<br>over lines.</p>"
TEXT = "First words of the text & more é.\nSecond boldly linked part over lines."
PAGE = "<html><head><title>T t</title><style>p{}</style></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>{}<footer>About us and others &copy;</footer></body></html>"


@pytest.fixture(scope="module")
def weights():
    return extract.learn([PAGE.replace("{}", f"<div class='ad'>Buy it now</div><article><h1>Title here</h1>{BODY * 3}</article>")] * 20)


@pytest.mark.parametrize(
    "inner, want",
    [
        (f"<article><h1>A title</h1>{BODY}</article>", f"A title\n{TEXT}"),
        (f"<div id=main-text>{BODY}</div>", TEXT),
        (f"<div class='ad'>Buy more things today for less</div><article>{BODY}</article><div class='comments'><p>I think so too, says a reader here.</p></div>", TEXT),
        (f"<article>{BODY}<div class='advert'>Buy <b>now</b></div>{BODY}</article>", f"{TEXT}\n{TEXT}"),
        (f"<article>{BODY}<form><label>Your mail</label><input name=m><button>Send it</button></form></article>", TEXT),
        (f"<aside><p>Other stories of the day that you may like to read</p></aside><main>{BODY}</main>", TEXT),
        (f"<div class='cookie-notice'>We use cookies to make all of this better for you</div><article>{BODY}</article>", TEXT),
        (f"<article>{BODY}<script>var a = '<p>no</p>';</script><!-- <p>no</p> --><noscript>Turn it on</noscript></article>", TEXT),
        (f"<article>{BODY}<ul><li>one item</li><li>another item</li></ul>{BODY}</article>", f"{TEXT}\none item\nanother item\n{TEXT}"),
        ("<article><p>  Spaces \n\t inside&nbsp;here </p><p>It.</p></article>", "Spaces inside here\nIt."),
        (f"<article><header><h1>A title</h1></header>{BODY}</article>", f"A title\n{TEXT}"),
        ("<article><p>Unclosed one<p>and <b>two<br><p>three</article>", "Unclosed one\nand two\nthree"),
    ],
)
def test_main_text(weights, inner, want):
    assert extract.main_text(PAGE.replace("{}", inner), weights) == want


@pytest.mark.parametrize("name", ["single", "no-sidebar", "single has-sidebar", "with-header", "search-results", "social-news", "legal", "sidebar"])
def test_layout_classes_of_the_whole_page(weights, name):
    page = PAGE.replace("{}", f"<article><h1>A title</h1>{BODY}</article>").replace("<body>", f'<body class="{name}" id="{name}">')
    assert extract.main_text(page, weights) == f"A title\n{TEXT}"


@pytest.mark.parametrize("name", ["no-sidebar", "has-sidebar", "with-header", "search-results", "social-news", "legal", "side-story"])
def test_a_lone_article_outweighs_names_around_it(weights, name):
    inner = f'<div class="{name}"><div id="{name}"><article>{BODY}</article></div></div><div class="related"><article><p>Other news here.</p></article><article><p>More of them.</p></article></div>'
    assert extract.main_text(PAGE.replace("{}", inner), weights) == TEXT


@pytest.mark.parametrize("name", ["sidebar", "sidebar-left", "site-header", "cookie-notice-box", "comment-list", "share-buttons"])
def test_names_of_furniture(weights, name):
    inner = f'<article>{BODY}</article><div class="{name}"><p>Words that no reader of this came for, at all.</p></div>'
    assert extract.main_text(PAGE.replace("{}", inner), weights) == TEXT


def test_comments_by_article_elements(weights):
    inner = f'<article>{BODY}</article><ol class="comment-list"><li><article class="comment-body"><p>So do I, says one of the readers.</p></article></li></ol>'
    assert extract.main_text(PAGE.replace("{}", inner), weights) == TEXT
    assert extract.main_text(PAGE.replace("{}", f"<aside><article><p>Short teaser.</p></article></aside><div><p>{'long text ' * 9}</p></div>"), weights) == ("long text " * 9).strip()


@pytest.mark.parametrize(
    "page",
    [
        "<div class='x y-z'>" * 55_000, "<div class='x'>w" * 55_000 + "</i>" * 20_000, '<a "' * 260_000, "<a '\">" * 160_000, "<!" * 500_000, "</" * 500_000, "<p <" * 250_000,
        "<b>" * 100_000 + "<div></div>" * 60_000, "<li><div>" + "<b>" * 100_000 + "<li></li>" * 60_000, "<script " * 120_000, "<!--" * 250_000, "<article>" * 110_000, "<a x=\"<a x='" * 90_000, "<p>" * 340_000,
    ],
)
def test_hostile_pages_of_a_megabyte(weights, page):
    import time
    import tracemalloc

    start = time.time()
    extract.main_text(page, weights)
    assert time.time() - start < 8
    tracemalloc.start()
    extract.main_text(page[: len(page) // 10], weights)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000


def test_odd_pages(spark, weights):
    pages = [(1, "u", None), (2, None, ""), (None, "u", "just words"), (3, "u", "<p>a < b & c <notatag"), (3, "u", "<p>a < b & c <notatag"), (4, "u", "<div " * 2000), (5, "u", "<p>" + "long words " * 100_000), (6, "u", "<nav>only menu</nav>"), (7, "u", "<!-- never closed <p>x</p>"), (8, "u", "</p></div>stray</b>")]
    df = spark.createDataFrame([(*p, "keep") for p in pages], "page_id long, url string, html string, text string")
    got = extract.extract(df.withColumn("more", df.text), weights)
    assert got.columns == ["page_id", "url", "more", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) and r.more == "keep" for r in rows)
    texts = {(r.page_id, r.url): r.text for r in rows}
    assert texts[1, "u"] == texts[2, None] == texts[6, "u"] == texts[7, "u"] == ""
    assert texts[None, "u"] == "just words" and texts[8, "u"] == "stray" and len(texts[5, "u"]) == 1_099_999
    assert got.limit(0).count() == 0


def test_scan_is_the_best_region():
    """The scan's region against every region, by a plain sum."""
    rng = random.Random(6)
    weights = extract.Weights(tags={"p": -0.3, "div": -1.0, "li": -0.9, "a": -0.8})
    for _ in range(60):
        page = "".join(rng.choice(["<p>", "</p>", "<div>", "</div>", "<li>", "<a>", "</a>", "word ", "two words "]) for _ in range(14))
        events = list(extract.events_of(page))
        scores = [float(len(v.split())) if k == "text" else weights.tag(v) if k == "open" or v in extract.BLOCKS else 0.0 for k, v, _ in events]
        best = max([0.0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])
        words = len(extract.main_text(page, weights).split())
        held = max((sum(len(v.split()) for k, v, _ in events[i:j] if k == "text") for i in range(len(scores)) for j in range(i + 1, len(scores) + 1) if abs(sum(scores[i:j]) - best) < 1e-9 and best > 0), default=0)
        assert words <= held and (words > 0) == (best > 0)


def test_articles_of_the_tables(spark):
    """The given pages have one article each: nothing else is in the text, and nothing of it is missing."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = extract.extract(pages, extract.train(pages)).join(pages.select("page_id", "html"), "page_id").collect()
    import html

    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", " " if "<br>" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(b for b in want if b)
