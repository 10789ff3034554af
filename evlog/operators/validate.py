"""Validation checks on the canonical event and the verdict they add up to.

Every check gives a struct(field, check, severity, message) or null, so the
issue list of an event is one projection.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlog import fixed as X
from evlog.functions.text import kept, quoted, whole

ISSUE = "struct<field:string,check:string,severity:string,message:string>"
PASS, WARNING, FAIL = "PASS", "WARNING", "FAIL"
USABLE, HELD = "usable", "held"
TEXT = X.ISSUE_TEXTS


def _issue(field: str, check: str, severity: str, *message) -> Column:
    parts = [m if isinstance(m, Column) else F.lit(m) for m in message]
    return F.struct(
        F.lit(field).alias("field"),
        F.lit(check).alias("check"),
        F.lit(severity).alias("severity"),
        F.concat(*parts).alias("message"),
    )


def check_ip(field: str, ip: Column) -> Column:
    return (
        F.when(ip.isNull(), _issue(field, "ip_present", WARNING, TEXT["value_absent"]))
        .when(~whole(ip, X.IPV4), _issue(field, "ip_format", FAIL, TEXT["ip_malformed"], quoted(ip)))
        .when(
            ip.rlike(X.OCTET_OVER_255),
            _issue(field, "ip_octets", FAIL, TEXT["ip_octets"], quoted(ip)),
        )
        .otherwise(_issue(field, "ip_format", PASS, TEXT["ip_valid"], ip))
    )


def check_port(field: str, port: Column) -> Column:
    text = port.cast("string")
    return (
        F.when(port.isNull(), _issue(field, "port_present", WARNING, TEXT["value_absent"]))
        .when(~port.between(0, X.MAX_PORT), _issue(field, "port_range", FAIL, TEXT["port_invalid"], text))
        .otherwise(_issue(field, "port_range", PASS, TEXT["port_valid"], text))
    )


def check_protocol(proto: Column) -> Column:
    field = "network_protocol"
    return (
        F.when(proto.isNull(), _issue(field, "protocol_present", WARNING, TEXT["word_absent"]))
        .when(
            ~F.upper(proto).isin(X.PROTOCOLS),
            _issue(field, "protocol_value", WARNING, TEXT["protocol_unusual"], quoted(proto), TEXT["verbatim"]),
        )
        .otherwise(_issue(field, "protocol_value", PASS, TEXT["protocol_known"], proto))
    )


def check_action(action: Column) -> Column:
    return (
        F.when(action.isNull(), _issue("action", "action_present", WARNING, TEXT["word_absent"]))
        .when(
            ~F.lower(action).isin(X.ACTIONS),
            _issue("action", "action_value", WARNING, TEXT["action_unusual"], quoted(action), TEXT["verbatim"]),
        )
        .otherwise(_issue("action", "action_value", PASS, TEXT["action_known"], action))
    )


def check_provenance(records: Column) -> Column:
    none = _issue("provenance", "structure", FAIL, TEXT["no_records"])
    some = _issue(
        "provenance", "structure", PASS, F.size(records).cast("string"), TEXT["records"]
    )
    return F.when(F.coalesce(F.size(records), F.lit(0)) <= 0, none).otherwise(some)


def check_coverage(event: Column) -> Column:
    net = event["network"]
    derived = F.coalesce(
        net["source_ip"], net["source_port"].cast("string"), net["destination_ip"],
        net["destination_port"].cast("string"), event["action"], event["policy_id"], event["severity"],
    )
    return F.when(
        derived.isNull(), _issue("coverage", "semantic_coverage", WARNING, TEXT["no_fields"])
    )


def check_header(event: Column) -> Column:
    src = event["source"]

    def row(check, label, whole_header):
        return F.when(whole_header, _issue("source", check, PASS, label, TEXT["header_whole"])).otherwise(
            _issue("source", check, WARNING, label, TEXT["header_incomplete"])
        )

    cef = event["signature_id"].isNotNull() & src["vendor"].isNotNull()
    leef = src["vendor"].isNotNull() & src["product"].isNotNull()
    return F.when(src["format"] == X.CEF, row("cef_header", "CEF", cef)).when(
        src["format"] == X.LEEF, row("leef_header", "LEEF", leef)
    )


def issue_list(event: Column) -> Column:
    net = event["network"]
    checks = [
        check_ip(X.SRC_IP, net["source_ip"]),
        check_ip(X.DST_IP, net["destination_ip"]),
        check_port(X.SRC_PORT, net["source_port"]),
        check_port(X.DST_PORT, net["destination_port"]),
        check_protocol(event["network_protocol"]),
        check_action(event["action"]),
        check_provenance(event["provenance"]),
        check_coverage(event),
        check_header(event),
    ]
    return F.array_compact(F.array(*checks))


def verdict(issues: Column) -> Column:
    """Struct(result, issues, checks_run, failed, warnings)."""

    severities = issues["severity"]

    def count(severity):
        return F.size(severities) - F.size(F.array_remove(severities, severity))

    failed, warned = count(FAIL), count(WARNING)
    return F.struct(
        F.when(failed > 0, FAIL).when(warned > 0, WARNING).otherwise(PASS).alias("result"),
        issues.alias("issues"),
        F.lit(X.CHECKS_RUN).alias("checks_run"),
        failed.alias("failed"),
        warned.alias("warnings"),
    )


def validate(df: DataFrame) -> DataFrame:
    """Add ``validation`` to rows with a ``canonical`` event."""
    issues, result = _columns()
    return df.withColumn("_issues", issues).withColumn("validation", result).drop("_issues")


@cache
def _columns() -> tuple[Column, Column]:
    return kept(issue_list(F.col("canonical"))), kept(verdict(F.col("_issues")))


def issues_table(df: DataFrame) -> DataFrame:
    """One row per issue of validated events."""
    return df.select("batch_id", "pos", F.posexplode("validation.issues").alias("issue_no", "i")).select(
        "batch_id", "pos", "issue_no", "i.field", "i.check", "i.severity", "i.message"
    )


def route_verdict(df: DataFrame) -> DataFrame:
    """Add ``route``: ``held`` for events that failed or were not understood, else ``usable``.

    One pass; written once partitioned by route, either part is read without the other.
    """
    usable = (F.col("validation.result") != FAIL) & F.col("understood")
    return df.withColumn("route", F.when(usable, USABLE).otherwise(HELD))


def split_verdict(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, held back) of rows with a ``route``, best of a stored table: each part is a scan of its own."""
    routed = df if "route" in df.columns else route_verdict(df)
    return routed.filter(F.col("route") == USABLE), routed.filter(F.col("route") == HELD)


def quality_report(df: DataFrame) -> DataFrame:
    """Verdict counts, fail rate and top failing check per format and vendor, with subtotals.

    Rows are first counted per (format, vendor) in one pass with a map-side
    combine; the subtotals are rolled up from those few counts.
    """
    issues = F.col("validation.issues")

    def failing(check):
        return F.size(F.filter(issues, lambda i: (i["check"] == check) & (i["severity"] == FAIL))).cast("bigint")

    result = F.col("validation.result")
    sums = ["events", "passed", "warned", "failed", *[f"_{c}" for c in X.FAIL_CHECKS]]
    base = (
        df.select(
            F.col("canonical.source.format").alias("format"),
            F.col("canonical.source.vendor").alias("vendor"),
            result.alias("_result"),
            *[failing(c).alias(f"_{c}") for c in X.FAIL_CHECKS],
        )
        .groupBy("format", "vendor")
        .agg(
            F.count(F.lit(1)).alias("events"),
            *[
                F.count_if(F.col("_result") == r).alias(n)
                for n, r in (("passed", PASS), ("warned", WARNING), ("failed", FAIL))
            ],
            *[F.sum(f"_{c}").alias(f"_{c}") for c in X.FAIL_CHECKS],
        )
    )
    rolled = base.rollup("format", "vendor").agg(
        F.grouping_id().alias("level"), *[F.sum(c).alias(c) for c in sums]
    )
    most = F.greatest(*[F.col(f"_{c}") for c in X.FAIL_CHECKS])
    top = F.when(F.lit(False), "")
    for c in X.FAIL_CHECKS:
        top = top.when((most > 0) & (F.col(f"_{c}") == most), c)
    return rolled.select(
        "format", "vendor", "level", "events", "passed", "warned", "failed",
        (F.col("failed") / F.col("events")).alias("fail_rate"),
        top.alias("top_failing_check"),
    )
