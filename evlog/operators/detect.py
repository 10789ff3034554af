"""Format detection: ordered tests on the stripped text, one rule number per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evlog import fixed as X
from evlog.functions.strict_json import json_kind
from evlog.functions.text import kept, strip, table


def is_xml_like(text: Column) -> Column:
    """Root tag at the start, its closing tag somewhere, and at least two tags."""
    root = F.regexp_extract(text, X.XML_ROOT, 1)
    return (
        F.startswith(text, F.lit("<"))
        & (root != "")
        & F.contains(text, F.concat(F.lit("</"), root, F.lit(">")))
        & text.rlike(X.TWO_TAGS)
    )


def rule_number(text: Column, kind: Column) -> Column:
    """Index into ``fixed.RULES``.  Cheap prefix and substring tests guard the patterns."""

    def opens(prefix, pattern):
        return F.startswith(text, F.lit(prefix)) & text.rlike(pattern)

    def holds(part, pattern):
        return F.contains(text, F.lit(part)) & text.rlike(pattern)

    tests = [
        text == "",
        kind == "object",
        kind == "array",
        opens("CEF:", X.CEF_START),
        opens("LEEF:", X.LEEF_BAR_START),
        opens("LEEF:", X.LEEF_3_START),
        is_xml_like(text),
        holds("CEF:", X.CEF_INSIDE),
        holds("LEEF:", X.LEEF_INSIDE),
        text.rlike(X.RFC_5424),
        text.rlike(X.RFC_3164),
        opens("CEF:", X.CEF_BAD_VERSION),
        text.rlike(X.MONTH_START),
    ]
    rule = F
    for number, test in enumerate(tests):
        rule = rule.when(test, number)
    return rule.otherwise(len(tests))


def describe_rule(rule: Column) -> Column:
    """Struct(format, confidence, reason, method) of a rule number."""
    names = ("format", "confidence", "reason", "method")
    rules = [tuple(zip(names, (*r, X.DETECT_METHOD))) for r in X.RULES]
    return F.get(table(rules), rule)


def detect(df: DataFrame) -> DataFrame:
    """Add ``format, confidence, reason, method`` to sealed rows (``raw, raw_sha256``)."""
    staged = df.withColumn("_text", kept(strip(F.col("raw"))))
    staged = staged.withColumn(
        "_rule", kept(rule_number(F.col("_text"), json_kind(F.col("_text"), F.col("raw_sha256"))))
    )
    hit = describe_rule(F.col("_rule"))
    return staged.select(
        *df.columns, *[hit[c].alias(c) for c in ("format", "confidence", "reason", "method")]
    )


def format_mix(df: DataFrame) -> DataFrame:
    """Events and share of the batch per format, confidence and reason of detected rows."""
    counts = df.groupBy("batch_id", "format", "confidence", "reason").agg(
        F.count(F.lit(1)).alias("events")
    )
    total = F.sum("events").over(Window.partitionBy("batch_id"))
    return counts.withColumn("share", F.col("events") / total)
