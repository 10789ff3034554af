"""Registered queries: each takes (spark, sf_dir) and returns flat, aliased columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evlog import fixed as X
from evlog.functions.values import pri_severity
from evlog.operators import frontier as G
from evlog.operators import integrity as I
from evlog.operators import merkle as M
from evlog.operators import mine
from evlog.operators import onboard as U
from evlog.operators import parse as P
from evlog.operators import provenance as V
from evlog.operators import validate as Q
from evlog.operators.detect import detect, format_mix
from evlog.operators.ingest import mark_blank, seal
from evlog.operators.normalize import LEAVES, merge_fields, leaf_struct, normalize
from evlog.plans import batch as B
from evlog.plans.process import canonical_events, process, validated_events
from evlog.session import stored
from evlog.sources.lines import event_lines, read_table, rendered_lines


def _events(run):
    """Query over the rendered raw lines."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(event_lines(spark, sf_dir))

    return query


def _leaf_columns():
    cols = []
    for name in LEAVES:
        c = V.canonical_leaf(name)
        cols.append((c.cast("bigint") if name.endswith("_port") else c).alias(name))
    extra = F.transform(
        F.map_entries("canonical.fields.extra"), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return [*cols, F.array_join(extra, ";").alias("extra")]


def _leaves_of(parse_one):
    def run(df):
        return normalize(parse_one(P.classify(seal(df)))).select("batch_id", "pos", *_leaf_columns())

    return _events(run)


def _records(df: DataFrame) -> DataFrame:
    return V.provenance_table(df).withColumn("record_no", F.col("record_no").cast("bigint"))


def _unknown(df: DataFrame) -> DataFrame:
    return detect(seal(df)).filter(F.col("format") == X.UNKNOWN).select("batch_id", "pos", "raw")


def _document_lines(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "raw"
    )


# --- detection ---------------------------------------------------------------


def raw_seal(df):
    return seal(df.withColumn("raw", F.concat("raw", F.lit("\n\n")))).select("batch_id", "pos", "raw_sha256")


def detect_rules(df):
    return detect(seal(df)).select("batch_id", "pos", "format", "confidence", "reason", "method")


def page_formats(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages", "page_id", "html")
    return detect(seal(pages.select("page_id", F.col("html").alias("raw")))).select("page_id", "format", "confidence")


def quarantine(spark, sf_dir):
    lines = rendered_lines(spark, sf_dir).select(
        "batch_id", "pos", F.when(F.col("event_type") == "signup", F.lit(" \t \n")).otherwise(F.col("raw")).alias("raw")
    )
    return mark_blank(lines).select("batch_id", "pos", "reason")


# --- parsing -----------------------------------------------------------------


def props_json(spark, sf_dir):
    """The JSON column of ``events`` as raw events."""
    raw = read_table(spark, sf_dir, "events", "event_id", "props").select(
        F.lit("props").alias("batch_id"), F.col("event_id").alias("pos"), F.col("props").alias("raw")
    )
    done = P.parse(P.classify(seal(raw)))
    return done.select("pos", "format", F.col("parse.status").alias("status"), F.col("extra")["k"].alias("k"))


def pri_severities(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    pri = (F.col("event_id") % 192).cast("string")
    return events.select("event_id", pri.alias("pri"), pri_severity(pri).alias("severity"))


def parse_status(df):
    return P.parse(P.classify(seal(df))).select("batch_id", "pos", "parse.parser", "parse.status", "parse.detail")


def parse_failures(df):
    return P.parse_failures(P.parse(P.classify(seal(df)))).drop("distinct_lines")


# --- unknown lines -----------------------------------------------------------


def unknown_fingerprint(spark, sf_dir):
    return U.fingerprint(_document_lines(spark, sf_dir)).select(
        "doc_id", "line_no", "delimiter", "token_count", "has_ipv4", "ipv4_count", "has_port_range",
        F.array_join("alpha_tokens", ";").alias("alpha_tokens"),
        F.array_join("alphanumeric_tokens", ";").alias("alphanumeric_tokens"),
    )


def token_types(df):
    typed = U.type_tokens(_unknown(df))
    return typed.select("batch_id", "pos", F.posexplode("tokens").alias("n", "t")).select(
        "batch_id", "pos", F.col("n").cast("bigint").alias("token_no"), "t.token", "t.inferred_type"
    )


def unknown_mapping(df):
    return _records(U.onboard(_unknown(df)))


def _layouts(found):
    steps = F.transform(
        "mapping", lambda m: F.concat(m["position"].cast("string"), F.lit("="), m["canonical_field"])
    )
    return found.select("signature", "events", "sample", "arity", F.array_join(steps, ",").alias("mapping"), "leading_values")


def discover_templates(df):
    return _layouts(U.discover_templates(_unknown(df)))


def document_templates(spark, sf_dir):
    return _layouts(U.discover_templates(_document_lines(spark, sf_dir)))


def merged_layouts(df):
    """Layouts of all lines from stored parts, one for each batch; the merged estimates lie near the exact numbers of leading names."""
    parts = U.merge_layouts(U.layout_parts(_unknown(df), "batch_id"))
    exact = U.discover_templates(_unknown(df)).select("signature", "leading_values")
    off = F.abs(F.col("leading_estimate") - F.col("leading_values"))
    return parts.join(exact, "signature").select("signature", "events", "sample", "leading_values", (off * 20 <= F.col("leading_values")).alias("near"))


def _registry(df):
    found = U.discover_templates(_unknown(df)).filter(F.startswith("signature", F.lit("|")))
    return U.template_rows(found)


def apply_templates(df):
    return _records(U.apply_templates(_unknown(df), _registry(df)))


def templated_events(df):
    """Canonical leaves of unknown lines when their layouts are registered: the same as by position."""
    done = canonical_events(df, _registry(df)).filter(F.col("format") == X.UNKNOWN)
    return done.select("batch_id", "pos", *_leaf_columns(), F.size("provenance").cast("bigint").alias("records"))


def template_summary(df):
    return _summary(U.apply_templates(_unknown(df), _registry(df)))


def long_tokens(spark, sf_dir):
    """Each document as one word before a bar: words of any length go through the whole pipeline."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    word = F.translate("text", " \t\r\n|", "")
    lines = docs.select(F.lit("docs").alias("batch_id"), F.col("doc_id").alias("pos"), F.concat(word, F.lit("|drop|tcp")).alias("raw"))
    return process(lines).select(
        F.col("pos").alias("doc_id"), "format", F.length("canonical_event.source.vendor").cast("bigint").alias("vendor_chars"),
        "canonical_event.action", "canonical_event.network_protocol",
    )


def apply_mined(df):
    """Every line by the layouts that its table was mined for."""
    found = mine.apply_mined(df, mine.mined_templates(df))
    return found.select("batch_id", "pos", "template", F.array_join("variables", ";").alias("variables"))


def document_mined(spark, sf_dir):
    return mine.mined_templates(_document_lines(spark, sf_dir))


# --- events ------------------------------------------------------------------


def event_leaves(df):
    return canonical_events(df).select(
        "batch_id", "pos", "canonical.event_id", "canonical.source.format", "canonical.raw_sha256", *_leaf_columns()
    )


def mapped_keys(df):
    """Canonical leaves by a key registry: new keys, and other meanings of known ones."""
    rows = [("CEF", "cs1Label", "user"), ("LEEF", "usrName", "host"), ("SYSLOG", "Policy", "signature_id"), ("XML", "note", "message"), ("JSON", "user", "host")]
    keys = df.sparkSession.createDataFrame(rows, "format string, key string, canonical_field string")
    return canonical_events(df, keys=keys).select("batch_id", "pos", *_leaf_columns(), F.size("provenance").cast("bigint").alias("records"))


def merged_fields(df):
    """Parser and onboarding leaves merged; onboarding wins where both have a value."""
    known = P.parse(P.classify(seal(df)))
    both = U.map_positions(known.withColumnRenamed("provenance", "_parsed")).select(
        "batch_id", "pos", leaf_struct(F.col("_parsed")).alias("p"), leaf_struct(F.col("provenance")).alias("o")
    )
    return both.select("batch_id", "pos", merge_fields(F.col("p"), F.col("o")).alias("m")).select(
        "batch_id", "pos", "m.vendor", "m.product", "m.source_ip", F.col("m.source_port").cast("bigint").alias("source_port"),
        "m.action", "m.policy_id",
    )


def field_confidence(df):
    return canonical_events(df).select("batch_id", "pos", F.explode("canonical.confidence")).select(
        "batch_id", "pos", F.col("key").alias("canonical_field"), F.col("value").alias("confidence")
    )


def event_results(df):
    """Flat view of the whole result row."""
    return process(df).select(
        "batch_id", "pos", "event_id", "raw_evidence",
        F.col("format_detection.confidence").alias("detect_confidence"),
        F.get("parse", F.lit(0))["status"].alias("parse_status"),
        F.size("provenance").cast("bigint").alias("records"),
        "validation.result",
        "integrity.canonical_sha256",
        "integrity.algorithm",
        "understood",
        F.array_join(F.col("onboarding.stages")["detail"], "; ").alias("stages"),
    )


# --- provenance --------------------------------------------------------------


def provenance_table(df):
    return _records(canonical_events(df))


def _summary(df, *by):
    methods = F.transform(F.map_entries("methods"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return V.provenance_summary(df, *by).withColumn("methods", F.array_join(methods, ";"))


def provenance_summary(df):
    return _summary(canonical_events(df), "format")


def event_provenance(df):
    done = canonical_events(df).withColumn("s", V.event_summary(F.col("provenance")))
    return done.select(
        "batch_id", "pos", "s.count", "s.mean_confidence",
        F.col("s.methods")["heuristic"].cast("bigint").alias("heuristic"),
    )


def merged_provenance(df):
    seal_record = F.array(P.record("raw_sha256", "raw", F.col("raw_sha256"), "derived"))
    done = P.parse(P.classify(seal(df)))
    return _records(done.withColumn("provenance", V.merge_provenance(F.col("provenance"), seal_record.cast(P.RECORDS))))


def field_coverage(df):
    return V.field_coverage(canonical_events(df))


def lineage_mismatch(df):
    """Every CEF line gets a second source address, so its first record no longer holds."""
    repeated = df.withColumn(
        "raw", F.when(F.startswith("raw", F.lit("CEF:")), F.concat("raw", F.lit(" src=9.9.9.9"))).otherwise(F.col("raw"))
    )
    return V.lineage_mismatch(canonical_events(repeated)).withColumn("record_no", F.col("record_no").cast("bigint"))


# --- validation --------------------------------------------------------------


def issues_table(df):
    return Q.issues_table(validated_events(df)).withColumn("issue_no", F.col("issue_no").cast("bigint"))


def verdicts(df):
    v = F.col("validation")
    return validated_events(df).select(
        "batch_id", "pos", v["result"].alias("result"),
        *[v[c].cast("bigint").alias(c) for c in ("checks_run", "failed", "warnings")], "understood",
    )


def quality_report(df):
    return Q.quality_report(validated_events(df)).withColumn("level", F.col("level").cast("bigint"))


def split_verdict(df):
    return Q.route_verdict(validated_events(df)).select("batch_id", "pos", "format", "route")


# --- integrity ---------------------------------------------------------------


def canonical_hash(df):
    return B.process_batch(df).select("batch_id", "pos", "event_id", "format", "canonical_sha256", "validation")


def verify_hashes(spark, sf_dir):
    """Manifest with upper-case hashes between white space of several kinds, wrong ones for errors, and no entry for views."""
    lines = rendered_lines(spark, sf_dir)
    manifest = (
        lines.filter("event_type <> 'view'")
        .withColumn("expected_sha256", F.concat(F.lit("\t \u00a0"), F.upper(F.sha2("raw", 256)), F.lit("\r\n\u2003")))
        .withColumn("expected_sha256", F.when(F.col("event_type") == "error", F.lit("0" * 64)).otherwise(F.col("expected_sha256")))
    )
    sealed = seal(lines.filter("event_type <> 'click'"))
    return I.verify_hashes(sealed, manifest).select("batch_id", "pos", "matches", "status")


def valid_digest(spark, sf_dir):
    lines = rendered_lines(spark, sf_dir).select("event_id", "event_type", F.sha2("raw", 256).alias("leaf"))
    short = F.when(F.col("event_type") == "click", F.substring("leaf", 1, 40)).otherwise(F.col("leaf"))
    ok, bad = I.valid_digest(lines.withColumn("leaf", short), "leaf")
    return ok.select("event_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("event_id", "reason"))


def leaf_positions(spark, sf_dir):
    """Dense positions of all lines in one batch, in the order of a hash."""
    rows = rendered_lines(spark, sf_dir).select(F.lit("all").alias("batch_id"), "event_id", F.md5(F.col("event_id").cast("string")).alias("at"))
    return M.leaf_positions(rows, "at").select("event_id", "pos")


def bad_positions(spark, sf_dir):
    """Lines of which some were lost, some lost their position, and some got their neighbour's."""
    lines = rendered_lines(spark, sf_dir).filter("event_id % 50 <> 11")
    pos = F.when(F.col("event_id") % 50 == 7, None).when(F.col("event_id") % 50 == 3, F.col("pos") + 1).otherwise(F.col("pos"))
    return M.position_faults(lines.select("batch_id", pos.alias("pos")))


def one_batch_root(spark, sf_dir):
    """The whole table as a single batch."""
    lines = rendered_lines(spark, sf_dir)
    rows = lines.select(F.lit("all").alias("batch_id"), F.col("event_id").alias("pos"), F.sha2("raw", 256).alias("leaf"))
    return M.merkle_root(rows)


def merkle_root(df):
    return M.merkle_root(B.leaves(df))


def merkle_nodes(df):
    return M.merkle_nodes(B.leaves(df)).withColumn("level", F.col("level").cast("bigint"))


def merkle_proofs(df):
    proofs = M.merkle_proofs(B.leaves(df))
    return proofs.select("batch_id", "pos", F.posexplode("proof").alias("step", "s")).select(
        "batch_id", "pos", F.col("step").cast("bigint").alias("step"), "s.hash", "s.position"
    )


def verify_proofs(df):
    """Proofs of the whole table, checked; some leaves and some steps are replaced and must be refused."""
    proofs = M.merkle_proofs(B.leaves(df))
    forged = F.when(F.col("pos") % 500 == 0, F.sha2(F.lit("tampered"), 256)).otherwise(F.col("leaf"))
    step = F.transform(
        "proof",
        lambda s, i: F.struct(F.when((F.col("pos") % 7 == 3) & (i == 1), F.sha2(s["hash"], 256)).otherwise(s["hash"]).alias("hash"), s["position"].alias("position")),
    )
    return M.verify_proofs(proofs.withColumn("leaf", forged).withColumn("proof", step)).select("batch_id", "pos", "valid")


def _shorter(df):
    """The table before: its first batch ends early."""
    return df.filter("not (batch_id = 'b0' and pos >= 900)")


def _tampered(df):
    """The table after: inner and last lines changed, the second batch cut off, the third lost."""
    changed = F.when(F.expr("pos % 512 = 317 or pos = 899"), F.concat("raw", F.lit("x"))).otherwise(F.col("raw"))
    return df.withColumn("raw", changed).filter("not (batch_id = 'b1' and pos >= 4000) and batch_id <> 'b2'")


def verify_batch(df):
    """Claims of the original lines against changed ones: a batch changed inside, one with a cut claim, one lost, one that nobody claims."""
    roots = M.merkle_root(B.leaves(df)).withColumn("root", F.when(F.col("batch_id") == "b1", F.substring("root", 1, 40)).otherwise(F.col("root")))
    lost = df.filter("batch_id = 'b0' and pos = 0").select(F.lit("lost").alias("batch_id"), F.sha2("raw", 256).alias("root"))
    changed = df.withColumn("raw", F.when(F.expr("batch_id = 'b0' and pos = 317"), F.concat("raw", F.lit("x"))).otherwise(F.col("raw")))
    unclaimed = df.filter("batch_id = 'b0' and pos < 5").withColumn("batch_id", F.lit("new"))
    return M.verify_batch(B.leaves(changed.unionByName(unclaimed)), roots.select("batch_id", "root").unionByName(lost))


def tamper_diff(df):
    return M.tamper_diff(B.leaves(_shorter(df)), B.leaves(_tampered(df)))[1]


def tamper_roots(df):
    return M.tamper_diff(B.leaves(_shorter(df)), B.leaves(_tampered(df)))[0]


def tamper_locate(df):
    """Each side's tree is built once and stored by level, so the walk reads nodes and never builds them again."""
    before, after = (stored(M.merkle_nodes(B.leaves(side)), "nodes", "level") for side in (_shorter(df), _tampered(df)))
    return M.tamper_locate(before, after)


def merkle_append(df):
    """Batches that grow: each tree's first lines are stored, the others are put behind them; some batches get no more."""
    leaves = B.leaves(df)
    old = F.col("pos") < 1 + F.substring("batch_id", 2, 9).cast("int") * 977 % 4500
    before = leaves.filter(old)
    counts = before.groupBy("batch_id").agg(F.count(F.lit(1)).alias("leaf_count"))
    stored = G.merkle_frontier(M.merkle_nodes(before), counts)
    grown = G.with_root(G.merkle_append(stored, leaves.filter(~old))[1])
    return grown.select("batch_id", "leaf_count", F.size("peaks").cast("bigint").alias("peaks"), "root")


def consistency_proofs(df):
    """Earlier states of each batch against its tree now: whole ones, one with a wrong root, and one whose first lines were swapped."""
    leaves = B.leaves(df)
    cuts = leaves.withColumn("cut", F.explode(F.array(*[F.lit(c).cast("bigint") for c in (1, 2, 3, 1000, 2048, 4095)])))
    swapped = F.when((F.col("cut") == 2048) & (F.col("pos") < 2), 1 - F.col("pos")).otherwise(F.col("pos"))
    states = cuts.filter("pos < cut").select(F.concat_ws("/", "batch_id", F.col("cut").cast("string")).alias("batch_id"), swapped.alias("pos"), "leaf")
    name = F.split("batch_id", "/")
    olds = M.merkle_root(states).select(F.get(name, F.lit(0)).alias("batch_id"), F.get(name, F.lit(1)).cast("bigint").alias("cut"), F.col("root").alias("old_root"), "leaf_count")
    olds = olds.filter("leaf_count = cut").withColumn("old_root", F.when(F.col("cut") == 1000, F.sha2("old_root", 256)).otherwise(F.col("old_root")))
    news = M.merkle_root(leaves).select("batch_id", F.col("root").alias("new_root"), F.col("leaf_count").alias("new_count"))
    claims = olds.join(news, "batch_id").filter("cut < new_count").select("batch_id", F.col("cut").alias("old_count"), "new_count", "old_root", "new_root")
    proofs = G.consistency_proofs(M.merkle_nodes(leaves), claims).join(claims, ["batch_id", "old_count", "new_count"])
    return G.verify_consistency(proofs).select("batch_id", "old_count", "new_count", F.size("proof").cast("bigint").alias("steps"), "valid")


QUERIES = {
    "raw_seal": _events(raw_seal),
    "quarantine": quarantine,
    "detect_rules": _events(detect_rules),
    "format_mix": _events(lambda df: format_mix(detect(seal(df)))),
    "page_formats": page_formats,
    "parse_json": _leaves_of(P.parse_json),
    "parse_cef": _leaves_of(P.parse_cef),
    "parse_leef": _leaves_of(P.parse_leef),
    "parse_syslog": _leaves_of(P.parse_syslog),
    "parse_xml": _leaves_of(P.parse_xml),
    "props_json": props_json,
    "pri_severity": pri_severities,
    "parse_status": _events(parse_status),
    "parse_failures": _events(parse_failures),
    "unknown_fingerprint": unknown_fingerprint,
    "token_types": _events(token_types),
    "position_profile": _events(lambda df: U.position_profile(_unknown(df))),
    "unknown_mapping": _events(unknown_mapping),
    "discover_templates": _events(discover_templates),
    "document_templates": document_templates,
    "merged_layouts": _events(merged_layouts),
    "apply_templates": _events(apply_templates),
    "templated_events": _events(templated_events),
    "template_summary": _events(template_summary),
    "long_tokens": long_tokens,
    "mined_templates": _events(mine.mined_templates),
    "document_mined": document_mined,
    "apply_mined": _events(apply_mined),
    "canonical_events": _events(event_leaves),
    "mapped_keys": _events(mapped_keys),
    "merged_fields": _events(merged_fields),
    "field_confidence": _events(field_confidence),
    "event_results": _events(event_results),
    "provenance_table": _events(provenance_table),
    "provenance_summary": _events(provenance_summary),
    "event_provenance": _events(event_provenance),
    "merged_provenance": _events(merged_provenance),
    "field_coverage": _events(field_coverage),
    "lineage_mismatch": _events(lineage_mismatch),
    "issues_table": _events(issues_table),
    "verdicts": _events(verdicts),
    "quality_report": _events(quality_report),
    "split_verdict": _events(split_verdict),
    "canonical_hash": _events(canonical_hash),
    "verify_hashes": verify_hashes,
    "valid_digest": valid_digest,
    "leaf_positions": leaf_positions,
    "bad_positions": bad_positions,
    "merkle_root": _events(merkle_root),
    "one_batch_root": one_batch_root,
    "merkle_nodes": _events(merkle_nodes),
    "merkle_proofs": _events(merkle_proofs),
    "verify_proofs": _events(verify_proofs),
    "verify_batch": _events(verify_batch),
    "merkle_append": _events(merkle_append),
    "consistency_proofs": _events(consistency_proofs),
    "tamper_diff": _events(tamper_diff),
    "tamper_roots": _events(tamper_roots),
    "tamper_locate": _events(tamper_locate),
    "batch_summary": _events(B.batch_summary),
}
