"""Field extraction.

All formats go through the same narrow stages, each one projection:

``parts``   the pieces of the line that the format's layout fixes
``mapped``  key/value pairs with the canonical field their key stands for and
            the normalised value
``prov``    one record per value that was taken over, in order
``extra``   pairs that no canonical field takes

Canonical values are the last record of a field, confidences the first one
(see ``normalize``), so the record array is the only thing a format must give.
A line that does not fit its format keeps its row and says so in ``parse``.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlog import fixed as X
from evlog.functions.strict_json import json_kind, json_object
from evlog.functions.text import kept, last_wins_map, let, strip, table, value_for
from evlog.functions.values import kind_of, norm_kind, norm_str, pri_severity
from evlog.operators.detect import describe_rule, rule_number
from evlog.operators.keys import KeyRows, key_tables
from evlog.operators.onboard import position_records, tokens

RECORD = "struct<canonical_field:string,source_field:string,value:string,method:string,confidence:double>"
RECORDS = f"array<{RECORD}>"
_MAPPED = "array<struct<field:string,key:string,text:string,value:string>>"


def record(field, source, value: Column, method="extracted", confidence=1.0) -> Column:
    def col(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(
        col(field).alias("canonical_field"),
        col(source).alias("source_field"),
        value.alias("value"),
        F.lit(method).alias("method"),
        col(confidence).cast("double").alias("confidence"),
    )


def _part(i: int) -> Column:
    return F.get(F.col("parts"), F.lit(i))


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _by_format(branches: dict[str, Column], formats, kind: str) -> Column:
    """CASE over the format with the branches of the formats at hand.

    All branches have the type ``kind`` already; casting arrays of structs would
    rebuild every element.
    """
    out = F
    for fmt in formats:
        if fmt in branches:
            out = out.when(F.col("format") == fmt, branches[fmt])
    return _none(kind) if out is F else out.otherwise(_none(kind))


# --- pieces of a line --------------------------------------------------------


def _cef_parts(raw: Column) -> Column:
    cut = F.split(F.regexp_extract(raw, X.CEF_PAYLOAD, 1), r"\|", 8)
    return let(cut, lambda p: F.when(F.size(p) >= 7, p))


def _leef_parts(raw: Column) -> Column:
    cut = F.split(raw, r"\|", 6)
    third = F.startswith(raw, F.lit("LEEF:3."))
    return F.when(raw.rlike(X.LEEF_HEADER), let(cut, lambda p: F.when((F.size(p) == 6) | third, p)))


def _syslog_parts(text: Column) -> Column:
    groups = F.array(*[F.regexp_extract(text, X.SYSLOG_LINE, g) for g in range(1, 6)])
    return F.when(text.rlike(X.SYSLOG_LINE), groups)


def _xml_parts(raw: Column) -> Column:
    """Leaf elements. Where several ``<`` come before one ``>``, tags and the texts after them are told apart by cutting the line.

    A search would begin at each ``<`` and run to the same ``>``, in time with the square of the line.
    """
    cut = let(F.split(raw, "<"), lambda c: _leaves(F.slice(c, F.lit(2), F.size(c))))
    return F.when(raw.rlike(X.OPEN_TWICE), cut).otherwise(F.regexp_extract_all(raw, F.lit(X.XML_LEAF), F.lit(0)))


def _leaves(pieces: Column) -> Column:
    """Leaf elements of a line from its pieces, each of which followed a ``<``: a tag is what stands between one ``>`` and the next
    that ends a tag, so it may hold several pieces."""

    def ends(p: Column) -> Column:
        return F.contains(p, F.lit(">"))

    def tag_part(p: Column) -> Column:
        return F.concat(F.lit("<"), F.when(ends(p), F.concat(F.substring_index(p, ">", 1), F.lit(">"))).otherwise(p))

    def opens(tag: Column, name: Column) -> Column:
        named = F.slice(F.split(tag, "<"), F.lit(2), F.length(tag) + 1)
        with_rest = F.exists(named, lambda p: F.startswith(p, name) & F.substring(p, F.length(name) + 1, F.lit(1)).rlike(X.S))
        return F.endswith(tag, F.concat(F.lit("<"), name)) | with_rest

    def leaf(both: Column, i: Column) -> Column:
        tags, texts = both["tags"], both["texts"]
        name = F.regexp_extract(F.get(tags, i + 1), X.XML_END_TAG, 1)
        whole_leaf = lambda n: F.concat(F.lit("<"), n, F.lit(">"), F.get(texts, i), F.lit("</"), n, F.lit(">"))
        return let(name, lambda n: F.when((n != "") & opens(F.get(tags, i), n), whole_leaf(n)))

    tags = F.split(F.array_join(F.transform(pieces, tag_part), ""), ">")
    texts = F.transform(F.filter(pieces, ends), lambda p: F.substring(p, F.instr(p, ">") + 1, F.length(p)))
    found = let(F.struct(tags.alias("tags"), texts.alias("texts")), lambda b: F.transform(F.sequence(F.lit(0), F.size(b["texts"])), lambda i: leaf(b, i)))
    return F.filter(found, lambda p: p.isNotNull())


# --- key/value pairs ---------------------------------------------------------


def _pair(key: Column, text: Column) -> Column:
    return F.struct(key.alias("key"), text.alias("text"))


def _cut_pair(p: Column, trim_key=True, trim_text=True) -> Column:
    """key=value at the first equals sign; parts that may hold blanks are trimmed."""
    key = F.substring_index(p, "=", 1)
    text = F.substring(p, F.instr(p, "=") + 1, F.length(p))
    return _pair(strip(key) if trim_key else key, strip(text) if trim_text else text)


def _cef_pairs() -> Column:
    found = F.regexp_extract_all(F.coalesce(_part(7), F.lit("")), F.lit(X.CEF_PAIR), F.lit(0))
    return F.transform(found, lambda p: _cut_pair(F.replace(p, F.lit("\\="), F.lit("=")), trim_key=False))


def _leef_pairs(raw: Column) -> Column:
    ext = F.coalesce(_part(5), F.lit(""))
    first = F.substring(ext, 1, 1)
    third = F.startswith(raw, F.lit("LEEF:3."))
    declared = ~third & (first != "") & (first != "=") & ~first.rlike(X.ALNUM)
    fields = (
        F.when(
            declared & (first != "\t"),
            F.split(F.substring(ext, F.lit(2), F.length(ext)), F.concat(F.lit("\\Q"), first, F.lit("\\E"))),
        )
        .when(third | F.contains(ext, F.lit("\t")), F.split(ext, "\t"))
        .otherwise(F.split(ext, " "))
    )
    pairs = F.transform(F.filter(fields, lambda p: F.contains(p, F.lit("="))), lambda p: _cut_pair(p))
    return F.filter(pairs, lambda p: p["key"] != "")


def _syslog_pairs() -> Column:
    found = F.regexp_extract_all(_part(4), F.lit(X.SYSLOG_PAIR), F.lit(0))
    return F.transform(found, lambda p: _cut_pair(p, trim_key=False, trim_text=False))


def _xml_pairs() -> Column:
    def cut(p: Column) -> Column:
        body = F.substring(p, F.instr(p, ">") + 1, F.length(p))
        return _pair(F.regexp_extract(p, X.XML_ROOT, 1), strip(F.substring_index(body, "</", 1)))

    return F.transform(F.col("parts"), cut)


def _map_pairs(pairs: Column, keys: dict[str, str], fold_key=False, trailing: str = "") -> Column:
    """Look up the field of every non-empty pair and normalise its value, which is trimmed already."""
    known = table({k: (("field", f), ("kind", kind_of(f))) for k, f in keys.items()})

    def with_field(p: Column) -> Column:
        key = F.lower(p["key"]) if fold_key else p["key"]
        return F.struct(F.try_element_at(known, key).alias("to"), p["key"].alias("key"), p["text"].alias("text"))

    def with_value(p: Column) -> Column:
        text = p["text"]
        if trailing:
            text = F.when(p["to"]["kind"].isin("ip", "port"), F.rtrim(text, F.lit(trailing))).otherwise(text)
        return F.struct(
            p["to"]["field"].alias("field"), p["key"].alias("key"), p["text"].alias("text"), norm_kind(p["to"]["kind"], text).alias("value")
        )

    found = F.filter(pairs, lambda p: p["text"] != "")
    return F.transform(F.transform(found, with_field), with_value)


# --- records -----------------------------------------------------------------


def _pair_records(fmt: str) -> Column:
    tail = ">" if fmt == X.XML else ""
    score = 0.9 if fmt == X.XML else 1.0
    return F.transform(
        F.col("mapped"),
        lambda p: record(
            p["field"], F.concat(F.lit(X.SOURCE_PREFIX[fmt]), p["key"], F.lit(tail)), p["value"], confidence=score
        ),
    )


def _cef_records() -> Column:
    head = F.array(
        record("signature_id", X.CEF_SIGNATURE_SOURCE, norm_str(_part(4))),
        record("severity", X.CEF_SEVERITY_SOURCE, F.lower(norm_str(_part(6)))),
    )
    return F.concat(head, _pair_records(X.CEF))


def _leef_records() -> Column:
    tail = F.array(record("signature_id", X.LEEF_EVENT_SOURCE, norm_str(_part(4))))
    return F.concat(_pair_records(X.LEEF), tail)


def _syslog_records() -> Column:
    pri = F.nullif(_part(0), F.lit(""))
    source = F.concat(F.lit(X.SYSLOG_PRI_SOURCE[0]), pri, F.lit(X.SYSLOG_PRI_SOURCE[1]))
    tail = F.array(
        record("host", X.SYSLOG_HOST_SOURCE, _part(2)),
        record("timestamp", X.SYSLOG_TIME_SOURCE, _part(1), confidence=0.9),
        record("severity", source, pri_severity(pri), method="derived", confidence=0.95),
    )
    return F.concat(_pair_records(X.SYSLOG), tail)


def _json_records(doc: Column, keys: dict[str, str]) -> Column:
    """Per canonical field the first candidate key whose value can be used.

    Only the keys that the object has are tried: they come out of the list of all
    candidates, which is ordered by field and preference.
    """
    known = table({k: (("field", f), ("kind", kind_of(f))) for k, f in keys.items()})

    def tried(m: Column) -> Column:
        def one(k: Column) -> Column:
            return let(
                F.struct(F.element_at(known, k).alias("to"), strip(value_for(m["k"], m["v"], k)).alias("text")),
                lambda s: record(s["to"]["field"], k, norm_kind(s["to"]["kind"], F.nullif(s["text"], F.lit("")))),
            )

        present = F.array_intersect(table(list(keys)), m["k"])
        return F.filter(F.transform(present, one), lambda r: r["value"].isNotNull())

    def first_per_field(records: Column) -> Column:
        fields = records["canonical_field"]
        return F.filter(records, lambda r, i: F.array_position(fields, r["canonical_field"]) == i + 1)

    members = F.struct(F.reverse(F.map_keys(doc)).alias("k"), F.reverse(F.map_values(doc)).alias("v"))
    return let(let(members, tried), first_per_field)


def _json_extra(doc: Column, keys: dict[str, str]) -> Column:
    known = table(list(keys))
    rest = F.map_filter(doc, lambda k, v: ~F.array_contains(known, k))
    return last_wins_map(F.map_keys(rest), F.map_values(rest))


def _pair_extra(keep) -> Column:
    rest = F.filter(F.col("mapped"), keep)
    return last_wins_map(rest["key"], rest["text"])


def _head(vendor: Column, product: Column, message: Column) -> Column:
    return F.struct(vendor.alias("vendor"), product.alias("product"), message.alias("message"))


# --- the operator ------------------------------------------------------------


def classify(df: DataFrame) -> DataFrame:
    """Add ``detection`` and ``format`` to sealed rows, keeping the parsed JSON object.

    The object is parsed once, here, and serves both the test and the extraction.
    """
    cols = _detection()
    staged = df
    for name in ("_text", "_doc", "_rule", "detection", "format"):
        staged = staged.withColumn(name, cols[name])
    return staged.drop("_rule")


@cache
def _detection() -> dict[str, Column]:
    text, seal = F.col("_text"), F.col("raw_sha256")
    kind = F.when(F.col("_doc").isNotNull(), "object").when(
        F.startswith(text, F.lit("[")), json_kind(text, seal)
    )
    return {
        "_text": kept(strip(F.col("raw"))),
        "_doc": kept(json_object(text, seal)),
        "_rule": kept(rule_number(text, kind)),
        "detection": describe_rule(F.col("_rule")),
        "format": F.col("detection")["format"],
    }


def parse(df: DataFrame, formats: list[str] | None = None, keys: KeyRows = ()) -> DataFrame:
    """Extract fields of classified rows.

    Adds ``parse`` (parser, status, detail), ``provenance``, ``extra`` and ``head``
    (vendor, product, message that carry no provenance record).  With ``formats``
    only those formats are planned; rows of others pass through unparsed.  ``keys`` are
    the rows of a key registry (``keys.key_rows``) that come before the built-in ones.
    """
    cols = _columns(tuple(formats or [*X.KNOWN_FORMATS, X.UNKNOWN]), keys)
    staged = df.withColumn("parts", cols["parts"]).withColumn("mapped", cols["mapped"])
    return staged.select(
        *[c for c in df.columns if not c.startswith("_")],
        *[cols[n].alias(n) for n in ("parse", "provenance", "extra", "head")],
    )


def _all_parts(raw: Column, text: Column) -> dict[str, Column]:
    return {
        X.CEF: _cef_parts(raw),
        X.LEEF: _leef_parts(raw),
        X.SYSLOG: _syslog_parts(text),
        X.XML: _xml_parts(raw),
        X.UNKNOWN: tokens(raw),
    }


def _all_pairs(raw: Column) -> dict[str, Column]:
    return {X.CEF: _cef_pairs(), X.LEEF: _leef_pairs(raw), X.SYSLOG: _syslog_pairs(), X.XML: _xml_pairs()}


def seen_keys(df: DataFrame) -> DataFrame:
    """Distinct (format, key) of classified rows, as a key registry compares them; combined before they are shuffled."""
    raw = F.col("raw")
    staged = df.withColumn("parts", kept(_by_format(_all_parts(raw, F.col("_text")), X.KNOWN_FORMATS, "array<string>")))
    keys = {f: F.transform(pairs, lambda p: p["key"]) for f, pairs in _all_pairs(raw).items()}
    keys |= {X.SYSLOG: F.transform(keys[X.SYSLOG], F.lower), X.JSON: F.map_keys("_doc")}
    found = staged.select("format", kept(_by_format(keys, X.KNOWN_FORMATS, "array<string>")).alias("_keys"))
    return found.select("format", F.explode("_keys").alias("key")).distinct()


@cache
def _columns(at: tuple[str, ...], registered: KeyRows) -> dict[str, Column]:
    """The stage columns for some formats; they name columns only and are built once."""
    raw, text, doc = F.col("raw"), F.col("_text"), F.col("_doc")
    keys, pairs, parts = key_tables(registered), _all_pairs(raw), _all_parts(raw, text)
    mapped = {
        X.CEF: _map_pairs(pairs[X.CEF], keys[X.CEF]),
        X.LEEF: _map_pairs(pairs[X.LEEF], keys[X.LEEF]),
        X.SYSLOG: _map_pairs(pairs[X.SYSLOG], keys[X.SYSLOG], fold_key=True, trailing=",;"),
        X.XML: _map_pairs(pairs[X.XML], keys[X.XML]),
    }
    records = {
        X.CEF: _cef_records(),
        X.LEEF: _leef_records(),
        X.SYSLOG: _syslog_records(),
        X.XML: _pair_records(X.XML),
        X.JSON: _json_records(doc, keys[X.JSON]),
        X.UNKNOWN: position_records(F.col("parts")),
    }
    unmapped = _pair_extra(lambda p: p["field"].isNull())
    extra = {
        X.CEF: unmapped,
        # a category has no canonical slot: record and value are both kept
        X.LEEF: _pair_extra(lambda p: p["field"].isNull() | (p["field"] == "category")),
        X.XML: _pair_extra(lambda p: p["value"].isNull()),
        X.JSON: _json_extra(doc, keys[X.JSON]),
    }
    head = {
        X.CEF: _head(norm_str(_part(1)), norm_str(_part(2)), norm_str(_part(5))),
        X.LEEF: _head(norm_str(_part(1)), norm_str(_part(2)), norm_str(_part(4))),
        X.SYSLOG: _head(_none("string"), _part(3), F.nullif(_part(4), F.lit(""))),
        X.XML: _head(_none("string"), F.regexp_extract(text, X.XML_ROOT, 1), _none("string")),
    }
    found = F.filter(_by_format(records, at, RECORDS), lambda r: r["value"].isNotNull())
    return {
        "parts": kept(_by_format(parts, at, "array<string>")),
        "mapped": kept(_by_format(mapped, at, _MAPPED)),
        "parse": kept(parse_step()),
        "provenance": kept(F.coalesce(found, F.array().cast(RECORDS))),
        "extra": kept(_by_format(extra, at, "map<string,string>")),
        "head": kept(_by_format(head, at, "struct<vendor:string,product:string,message:string>")),
    }


def parse_step() -> Column:
    """Struct(parser, status, detail); a failure is data, never an exception."""
    fmt = F.col("format")
    bad = fmt.isin(X.CEF, X.LEEF, X.SYSLOG) & F.col("parts").isNull()
    short = (fmt == X.LEEF) & F.col("raw").rlike(X.LEEF_HEADER)
    error = F.try_element_at(table(X.PARSE_ERRORS), fmt)
    detail = F.when(bad, F.when(short, X.LEEF_INCOMPLETE).otherwise(error)).when(
        fmt == X.UNKNOWN, X.ONBOARD_STEP
    )
    return F.struct(
        F.when(fmt == X.UNKNOWN, X.ONBOARD_PARSER).otherwise(fmt).alias("parser"),
        F.when(bad, "failed").otherwise("ok").alias("status"),
        detail.alias("detail"),
    )


def _one(fmt: str):
    def run(df: DataFrame) -> DataFrame:
        return parse(df.filter(F.col("format") == fmt), [fmt])

    run.__name__ = f"parse_{fmt.lower()}"
    run.__doc__ = f"Extract the {fmt} rows of a classified table."
    return run


parse_json, parse_cef, parse_leef = _one(X.JSON), _one(X.CEF), _one(X.LEEF)
parse_syslog, parse_xml = _one(X.SYSLOG), _one(X.XML)


def parse_failures(df: DataFrame) -> DataFrame:
    """Failed rows per format, confidence and detail with the smallest raw text as sample.

    ``distinct_lines`` is an estimate: few of many events mean that one line comes again and again. Its sketch also lets
    Spark aggregate by hashing; the minimum of a text alone would sort all failed lines.
    """
    found = (
        df.filter(F.col("parse.status") == "failed")
        .groupBy("format", F.col("detection.confidence").alias("confidence"), F.col("parse.detail").alias("detail"))
        .agg(F.count(F.lit(1)).alias("events"), F.min("raw").alias("_sample"), F.hll_sketch_agg("raw").alias("_lines"))
    )
    both = found.withColumn("_both", kept(F.struct("_sample", "_lines")))
    return both.select(
        "format", "confidence", "detail", "events", F.col("_both._sample").alias("sample"), F.hll_sketch_estimate("_both._lines").alias("distinct_lines")
    )
