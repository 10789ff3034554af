"""The registered queries of these operators, with production parameters over whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, decontaminate, exact, extract, interaction, language, neighbours, packing, quality, simhash, substrings, urlfilter, warc
from .common import shared_folder, table

DAY, START, YEAR = 86_400, 1_704_067_200, 31_536_000


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged at its fetch time, which follows from its id, by two lists.

    The tables hold no lists, so dated entries are made from all pages: a pattern of a page's URL gets an entry on the
    page's day if the hash of pattern and day says so; further digits of it choose the list and the action.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetch_time", F.lit(START) + F.pmod(F.col("page_id") * 7919, F.lit(YEAR)))
    seen = captures.select(F.explode(urlfilter.patterns_of(F.col("url"))).alias("pattern"), F.floor(F.col("fetch_time") / DAY).alias("day")).filter("day is not null").distinct()
    digest = seen.withColumn("h", F.md5(F.concat_ws("#", "pattern", F.col("day").cast("string")))).filter(F.substring("h", 1, 1) < "4")
    action = F.when(F.substring("h", 2, 1) < "8", urlfilter.BLOCK).when(F.substring("h", 2, 1) < "c", urlfilter.ALLOW).otherwise(urlfilter.REMOVE)
    entries = digest.select(F.when(F.substring("h", 3, 1) < "8", "abuse").otherwise("brand").alias("list"), "pattern", action.alias("action"), (F.col("day") * DAY).alias("effective"))
    return urlfilter.judge(captures, urlfilter.validity_intervals(entries))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    warc.write_streams(table(spark, sf_dir, "pages"), f"{folder}/streams")
    index = warc.normalise(spark, f"{folder}/streams", f"{folder}/archives")
    records = warc.read_members(index, with_payload=False)
    return records.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "url")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract.extract(pages, extract.train(pages))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per region of a document that repeats a passage of a benchmark item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.filter("vec_id % 100 = 0"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", (language.part_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (quality.bucket("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_warc, op3_simhash, op4_extract, op5_decontaminate, op6_neighbours, op7_packing, op8_language, op9_quality, op10_substrings,
        op11_exact, op12_alignment, op13_filter_audit,
    )
}

OP1 = r"""
WITH c AS (SELECT row_number() OVER () AS r, page_id, url, 1704067200 + (page_id * 7919) % 31536000 AS fetch_time FROM pages),
 h AS (SELECT *, rtrim(lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
  list_filter(string_split(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS steps FROM c),
 p AS (SELECT DISTINCT r, page_id, url, fetch_time, unnest(
   list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, 1000000), '.'))
   || list_transform(range(1, len(steps) + 1), lambda i: host || '/' || array_to_string(list_slice(steps, 1, i), '/'))) AS pattern FROM h WHERE host <> ''),
 s AS (SELECT DISTINCT pattern, CAST(floor(fetch_time / 86400) AS BIGINT) AS day FROM p WHERE fetch_time IS NOT NULL),
 e AS (SELECT pattern, day * 86400 AS effective, substr(m, 2, 1) AS a, CASE WHEN substr(m, 3, 1) < '8' THEN 'abuse' ELSE 'brand' END AS list
  FROM (SELECT *, md5(pattern || '#' || day) AS m FROM s) x WHERE substr(m, 1, 1) < '4'),
 v AS (SELECT *, lead(effective) OVER (PARTITION BY list, pattern ORDER BY effective) AS valid_to FROM e),
 m AS (SELECT p.r, v.list, v.pattern, v.effective, CASE WHEN v.a < '8' THEN 'block' ELSE 'allow' END AS action
  FROM p JOIN v ON p.pattern = v.pattern AND v.a < 'c' AND effective <= fetch_time AND (valid_to IS NULL OR fetch_time < valid_to)),
 b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(pattern) DESC, action, list, pattern) = 1)
SELECT page_id, url, fetch_time, coalesce(action, 'none') AS verdict, list, pattern, effective AS valid_from FROM c LEFT JOIN b USING (r)
"""

OP2 = r"""
WITH d AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
 r AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
  (((strpos('0123456789abcdef', substr(h, CAST(floor(5 * i / 4) AS INTEGER) + 1, 1)) - 1) * 16 + (strpos('0123456789abcdef', substr(h, CAST(floor(5 * i / 4) AS INTEGER) + 2, 1)) - 1))
   >> (3 - CAST(5 * i % 4 AS INTEGER))) & 31 AS INTEGER), 1)), '') AS payload_digest,
 CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, url FROM r
"""

#: The given pages have one article each, of headings and paragraphs, and no character references but those of ampersands and quotes in it.
OP4 = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '<br>', ' ', 'g') AS inside FROM pages),
 b AS (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split_regex(inside, '</?(?:p|h1)>'),
  lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM a)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM b
"""

OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
 s AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35) x),
 n AS (SELECT win FROM s GROUP BY win HAVING count(*) > 1),
 c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM s SEMI JOIN n USING (win)),
 l AS (SELECT r, list(k) AS gone FROM c GROUP BY r),
 k AS (SELECT d.r, doc_id, w, gone, CASE WHEN gone IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(gone, x))) END AS kept FROM d LEFT JOIN l USING (r))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
 g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY t) AS group_size
  FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST, r))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM g
"""

#: Every order is walked; a filter's share is the plain sum of its removals over all of them.
OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
 f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
   CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
   || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
   || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first < doc_id THEN 'E' ELSE '' END AS fails
  FROM (SELECT d.*, min(d.doc_id) OVER (PARTITION BY t) AS first, l.good, l.toxic FROM d LEFT JOIN l ON d.doc_id = l.doc_id) x),
 n AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
 x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
 o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a JOIN x b ON b.x <> a.x JOIN x c ON c.x NOT IN (a.x, b.x) JOIN x d ON d.x NOT IN (a.x, b.x, c.x) JOIN x e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
 s AS (SELECT o, k, substr(o, k, 1) AS x, substr(o, 1, k - 1) AS earlier FROM o, range(1, 6) r(k)),
 c AS (SELECT part, o, k, x, n, good, toxic, contains(fails, x) AS hit, fails = x AS only_x, fails <> '' AND earlier <> '' AND len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AS gone FROM s, n),
 t AS (SELECT part, o AS filter_order, k AS step, x, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed,
   coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant, coalesce(sum(n) FILTER (only_x), 0) AS unique_fails,
   coalesce(sum(good) FILTER (NOT gone AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND hit), 0) AS toxic_lost FROM c GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
 CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
 CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM t
"""

ORACLE = {"op1_url_filter": OP1, "op2_warc": OP2, "op4_extract": OP4, "op10_substrings": OP10, "op11_exact": OP11, "op13_filter_audit": OP13}
