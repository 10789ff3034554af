"""Layouts of free text: lines are cut at blanks, tokens that many lines share are kept, all others become wildcards.

Mining goes in two levels. Lines with equally many tokens are a family; a token is kept where enough lines of its family
have it at that place (``frequent_tokens``, a table of bounded size). Lines masked by it are counted as candidates. Within
candidates that begin alike, a place with many kept tokens is a variable after all, and becomes a wildcard too.

Applying a registry of layouts needs no shuffle: a line is masked by the masks of its family, and the first masked text that is
registered is its layout. Layouts with fewer wildcards are tried first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlog import fixed as X
from evlog.functions.text import kept, let, strip

WILD, TAIL = "<*>", "<*>..."
#: Tokens of a line that are judged one by one; the rest of a longer line is a tail, and all longer lines are one family.
DEPTH = 32
#: A token is kept if one line in ``SHARE`` of its family has it there, and ``LEAST`` lines at least.
SHARE, LEAST = 100, 5
#: Tokens that begin a layout and say which ones are compared; kept tokens of one place among these before it is a variable.
PREFIX, BRANCHES = 2, 8
#: Bytes of a registry that tasks may hold whole.
REGISTRY_BYTES = 8 << 20
#: Above that, tasks that a layout of all lines would be dealt to.
SALTS = 1024


def blank_tokens(raw: Column, depth: int = DEPTH) -> Column:
    """Tokens between runs of blanks; of a longer line the first ``depth`` ones and the mark of a tail."""
    text = strip(raw)
    cut = F.filter(F.split(text, f"{X.S}+", depth + 1), lambda t: t != "")
    return let(cut, lambda t: F.when(F.size(t) > depth, F.concat(F.slice(t, 1, depth), F.array(F.lit(TAIL)))).otherwise(t))


def _constant(token: Column) -> Column:
    """Whether a token may be kept: numbers, addresses and names with digits are values, and so is a wildcard of the line itself."""
    return ~token.rlike(X.D) & (token != WILD)


def frequent_tokens(lines: DataFrame, share: int = SHARE, least: int = LEAST, depth: int = DEPTH) -> DataFrame:
    """(tokens, kept): of each number of tokens the frequent ones of every place, as one list a place.

    ``lines`` has ``_tokens``. At most ``share`` tokens of a place can be frequent, and there are ``depth + 1`` families, so
    the table is small whatever the number of lines is: its bound is about ``share * depth ** 2 / 2`` tokens.
    """
    n = F.size("_tokens")
    sizes = lines.groupBy(n.alias("tokens")).agg(F.count(F.lit(1)).alias("_lines"))
    places = lines.select(n.alias("tokens"), F.posexplode("_tokens").alias("_place", "_token")).filter(_constant(F.col("_token")))
    counts = places.groupBy("tokens", "_place", "_token").agg(F.count(F.lit(1)).alias("_n"))
    often = counts.join(F.broadcast(sizes), "tokens").filter((F.col("_n") * share >= F.col("_lines")) & (F.col("_n") >= least))
    each = often.groupBy("tokens", "_place").agg(F.sort_array(F.collect_list("_token")).alias("_some"))
    found = each.groupBy("tokens").agg(F.map_from_entries(F.collect_list(F.struct("_place", "_some"))).alias("_by_place"))
    dense = F.transform(F.sequence(F.lit(0), F.col("tokens") - 1), lambda i: F.coalesce(F.try_element_at("_by_place", i), F.array().cast("array<string>")))
    return found.select("tokens", dense.alias("kept"))


def _masked(tokens: Column, keep: Column) -> Column:
    return F.transform(tokens, lambda t, i: F.when(F.coalesce(F.array_contains(F.get(keep, i), t), F.lit(False)) | (t == TAIL), t).otherwise(WILD))


def _first_tokens(places: Column) -> Column:
    return F.array_join(F.slice(places, 1, PREFIX), " ")


def mined_templates(df: DataFrame, share: int = SHARE, least: int = LEAST, branches: int = BRANCHES, depth: int = DEPTH) -> DataFrame:
    """(template, tokens, wildcards, events) of the lines of ``df`` (raw).

    Every line but those of blanks alone counts in exactly one layout. Equal lines count each; a line that equals no other is
    a layout of wildcards. Counts combine before each shuffle, so a layout that most lines share costs one row per task. Lines are read
    twice, once for the tokens and once for the candidates; texts of lines are never shuffled.
    """
    lines = df.select(kept(blank_tokens(F.col("raw"), depth)).alias("_tokens")).filter(F.size("_tokens") > 0)
    often = frequent_tokens(lines, share, least, depth)
    met = lines.withColumn("tokens", F.size("_tokens")).join(F.broadcast(often), "tokens", "left")
    candidates = met.select("tokens", _masked(F.col("_tokens"), F.col("kept")).alias("places")).groupBy("tokens", "places").agg(F.count(F.lit(1)).alias("events"))
    group = ["tokens", "_begins"]
    candidates = candidates.withColumn("_begins", _first_tokens(F.col("places")))
    spread = candidates.select(*group, F.posexplode("places").alias("_place", "_token")).filter(F.col("_place") >= PREFIX).distinct()
    many = spread.groupBy(*group, "_place").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > branches)
    variable = many.groupBy(*group).agg(F.collect_list("_place").alias("_variable"))
    merged = F.transform("places", lambda t, i: F.when(F.coalesce(F.array_contains(F.col("_variable"), i), F.lit(False)) & (t != TAIL), WILD).otherwise(t))
    final = candidates.join(variable, group, "left").select(F.col("tokens").cast("bigint").alias("tokens"), merged.alias("places"), "events")
    wild = F.size(F.filter("places", lambda t: t == WILD)).cast("bigint")
    return final.groupBy(F.array_join("places", " ").alias("template"), "tokens", wild.alias("wildcards")).agg(F.sum("events").alias("events"))


# --- lines by a registry of mined layouts ------------------------------------


def _mask(tokens: Column) -> Column:
    """A character for each place: ``*`` for a wildcard, ``+`` for the tail, ``=`` for a token."""
    return F.array_join(F.transform(tokens, lambda t: F.when(t == WILD, "*").when(t == TAIL, "+").otherwise("=")), "")


def mask_index(templates: DataFrame) -> DataFrame:
    """(tokens, masks): of each number of tokens its masks, those with fewer wildcards first, each with its layouts and their hashes."""
    places = F.split("template", " ")
    rows = templates.select("template").distinct().select(F.size(places).alias("tokens"), _mask(places).alias("mask"), "template", F.xxhash64("template").alias("hash"))
    each = rows.groupBy("tokens", "mask").agg(F.sort_array(F.collect_list(F.struct("hash", "template"))).alias("known"))
    wild = F.length(F.replace(F.replace("mask", F.lit("="), F.lit("")), F.lit("+"), F.lit("")))
    entry = F.struct(wild.alias("wildcards"), "mask", F.col("known.hash").alias("hashes"), F.col("known.template").alias("layouts"))
    return each.groupBy("tokens").agg(F.sort_array(F.collect_list(entry)).alias("masks"))


def _by_mask(tokens: Column, mask: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t, i: F.when(F.substring(mask, i + 1, F.lit(1)) == "*", WILD).otherwise(t)), " ")


def _chosen(tokens: Column, masks: Column) -> Column:
    """The first registered layout that a line fits; a hash is only looked up, the text decides."""

    def fits(m: Column) -> Column:
        return let(_by_mask(tokens, m["mask"]), lambda text: F.when(F.array_contains(m["hashes"], F.xxhash64(text)) & F.array_contains(m["layouts"], text), text))

    return F.get(F.filter(F.transform(masks, fits), lambda t: t.isNotNull()), F.lit(0))


def registry_bytes(templates: DataFrame) -> int:
    return templates.agg(F.coalesce(F.sum(F.octet_length("template") + 16), F.lit(0))).first()[0]


def apply_mined(df: DataFrame, templates: DataFrame, limit: int = REGISTRY_BYTES, depth: int = DEPTH) -> DataFrame:
    """``df`` with ``template`` (null if no registered layout fits) and ``variables``, the tokens at its wildcards.

    Of several layouts that fit, that with the fewest wildcards is taken, then that whose mask and text come first. The mined layout
    of a line always fits it, but a narrower one of other lines may fit too. A registry of up to ``limit`` bytes
    is broadcast and lines stay where they are; a larger one is met by hash (``_met_by_hash``; lines need batch_id and pos).
    """
    lines = df.withColumn("_tokens", kept(blank_tokens(F.col("raw"), depth))).withColumn("_n", F.size("_tokens"))
    index = mask_index(templates).withColumnRenamed("tokens", "_n")
    if registry_bytes(templates) <= limit:
        found = lines.join(F.broadcast(index), "_n", "left").withColumn("template", kept(_chosen(F.col("_tokens"), F.col("masks"))))
    else:
        found = _met_by_hash(lines, templates, limit)
    places = F.split("template", " ")
    values = F.filter(F.col("_tokens"), lambda t, i: F.get(places, i) == WILD)
    return found.select(*df.columns, "template", F.when(F.col("template").isNotNull(), values).alias("variables"))


def _met_by_hash(lines: DataFrame, templates: DataFrame, limit: int) -> DataFrame:
    """As in ``apply_mined``, for registries of any size: lines probe one hash for each mask of their number of tokens.

    Probes carry batch_id, pos and the hash, not the text. A layout that ``events`` says is frequent is repeated under salts, in
    proportion to its share of the lines, so its probes are dealt to as many tasks. Masks are broadcast while they fit.
    """
    key = ["batch_id", "pos"]
    places = F.split("template", " ")
    events = F.col("events") if "events" in templates.columns else F.lit(1)
    hashes = lambda text: [F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2")]
    known = templates.select("template", F.size(places).alias("_n"), _mask(places).alias("_m"), events.cast("long").alias("_events"), *hashes(F.col("template")))
    total = known.agg(F.coalesce(F.sum("_events"), F.lit(1))).first()[0]
    masks = known.groupBy("_n").agg(F.sort_array(F.collect_set("_m")).alias("_masks"))
    size = masks.agg(F.coalesce(F.sum(F.size("_masks") * F.col("_n")), F.lit(0))).first()[0]
    probes = lines.select(*key, "_n", "_tokens").join(F.broadcast(masks) if size <= limit else masks, "_n")
    probes = probes.select(*key, F.explode(F.transform("_masks", lambda m: _by_mask(F.col("_tokens"), m))).alias("_text"))
    probes = probes.select(*key, *hashes(F.col("_text")), F.pmod(F.xxhash64(*key), F.lit(SALTS)).alias("_own"))
    copies = known.withColumn("_of", F.least(F.floor(F.col("_events") * SALTS / F.lit(total)) + 1, F.lit(SALTS)))
    often = copies.filter("_of > 1").select("_h1", "_h2", "_of")  # fewer than ``SALTS`` rows
    probes = probes.join(F.broadcast(often), ["_h1", "_h2"], "left").withColumn("_salt", F.coalesce(F.pmod("_own", "_of"), F.lit(0)))
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1))).drop("_of")
    met = probes.join(copies, ["_h1", "_h2", "_salt"])
    wild = F.length(F.replace(F.replace("_m", F.lit("="), F.lit("")), F.lit("+"), F.lit("")))
    best = met.groupBy(*key).agg(F.min(F.struct(wild.alias("wildcards"), "_m", "template")).alias("_best"))
    return lines.join(best.select(*key, F.col("_best.template").alias("template")), key, "left")
