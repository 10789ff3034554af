"""URL filters as a temporal list join: each capture is judged by the list entries that were active when it was fetched.

Only DataFrame functions: dated entries become validity intervals, and captures meet them in an as-of join on the pattern
and a bucket of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import join_hot

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"
#: Seconds of a time bucket: an interval meets the captures of each bucket it reaches into.
BUCKET = 30 * 24 * 3600
#: Actions of entries. At equal length of the pattern, allow goes before block.
REMOVE, BLOCK, ALLOW = "remove", "block", "allow"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dots; empty if there is none."""
    return F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))


def patterns_of(url: Column) -> Column:
    """What a list may name a URL by: its host and every domain above it, and its host with every leading part of its path."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")
    paths = F.transform(steps, lambda s, i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i + 1), "/")))
    return F.when(host != "", F.array_distinct(F.concat(domains, paths))).otherwise(F.array().cast("array<string>"))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, action, valid_from, valid_to) of dated entries (list, pattern, action, effective in seconds).

    An entry holds from its date until the next one of its list and pattern; ``remove`` entries only end others. Of entries of
    one date, allow goes before block before remove. Rows with a null in any of the columns, or an unknown action, are ignored.
    """
    known = entries.select("list", "pattern", "action", "effective").filter(F.col("action").isin(REMOVE, BLOCK, ALLOW)).dropna()
    day = known.groupBy("list", "pattern", "effective").agg(F.max(F.when(F.col("action") == ALLOW, 2).when(F.col("action") == BLOCK, 1).otherwise(0)).alias("_rank"))
    following = F.lead("effective").over(Window.partitionBy("list", "pattern").orderBy("effective"))
    held = day.withColumn("valid_to", following).filter("_rank > 0")
    return held.select("list", "pattern", F.when(F.col("_rank") == 2, ALLOW).otherwise(BLOCK).alias("action"), F.col("effective").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, intervals: DataFrame, url_col: str = "url", time_col: str = "fetch_time", bucket: int = BUCKET) -> DataFrame:
    """``captures`` with verdict (allow, block or none), list, pattern and valid_from of the entry that decides.

    The longest pattern active at the fetch time decides; at equal length allow goes before block, then the first list by
    name. A capture without url, host or time, or that no entry meets, has verdict none and nulls. Each different
    (url, time) is judged once, however often it occurs, and hot ones are dealt out evenly; a hot host is split by time.
    Repeated rows and other columns stay; columns named as the results are replaced; empty tables are no special case.
    """
    results = ["verdict", "list", "pattern", "valid_from"]
    rows = captures.drop(*results).withColumn("_llm_key", F.concat_ws(" ", F.col(time_col).cast("string"), url_col))
    once = rows.select("_llm_key", F.col(url_col).alias("_llm_url"), F.col(time_col).cast("long").alias("_llm_time")).dropna().groupBy("_llm_key", "_llm_url", "_llm_time").agg(F.count("*").alias("_llm_n"))
    asked = once.select("_llm_key", "_llm_n", "_llm_time", F.floor(F.col("_llm_time") / bucket).alias("_llm_bucket"), F.explode(patterns_of(F.col("_llm_url"))).alias("pattern"))
    reach = captures.agg(F.min(F.col(time_col).cast("long")).alias("first"), F.max(F.col(time_col).cast("long")).alias("last"), F.count("*").alias("n")).first()
    first, last = reach["first"] or 0, reach["last"] or 0
    start = F.greatest(F.col("valid_from"), F.lit(first))
    end = F.least(F.coalesce(F.col("valid_to") - 1, F.lit(last)), F.lit(last))
    spread = intervals.filter(start <= end).withColumn("_llm_bucket", F.explode(F.sequence(F.floor(start / bucket), F.floor(end / bucket))))
    active = (F.col("valid_from") <= F.col("_llm_time")) & (F.col("valid_to").isNull() | (F.col("_llm_time") < F.col("valid_to")))
    met = asked.join(spread, ["pattern", "_llm_bucket"]).filter(active)
    # one number ranks an entry by length and action; of equals the smallest list name decides
    rank = F.length("pattern") * 2 + F.when(F.col("action") == ALLOW, 1).otherwise(0)
    best = met.groupBy("_llm_key", "_llm_n").agg(F.min(F.struct((-rank).alias("rank"), "list", "pattern", "action", "valid_from")).alias("_llm_best"))
    found = join_hot(rows, best, "_llm_key", "_llm_n", reach["n"])
    return found.select(*captures.drop(*results).columns, F.coalesce("_llm_best.action", F.lit("none")).alias("verdict"), F.col("_llm_best.list").alias("list"), F.col("_llm_best.pattern").alias("pattern"), F.col("_llm_best.valid_from").alias("valid_from"))
