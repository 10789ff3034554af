"""A training corpus from raw documents: quality filter, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes the rows its predecessor kept and calls one operator of ``evlog.llm``; ``run`` writes each result as
Parquet to the shared folder and rereads it, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evlog.llm import decontaminate, packing, quality, simhash, substrings
from evlog.llm.common import shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject; it learns from the labelled ones outside the held-out third."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(COLUMNS), model).filter("predicted = 1").select(COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (fingerprints of four-word shingles within 4 bits) the document with the smallest id."""
    return simhash.keep_one(docs.select(COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated 35-word windows; a text that loses none stays as it is, and n_chars follows."""
    cut = substrings.remove_repeats(docs.select(COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", text).select(COLUMNS)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontaminate.keep_clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of binary lengths with their ids; one row per piece."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("substrings", without_repeats),
    ("decontamination", without_leaks),
    ("packing", packed),
]

#: No stage but the third can be said in SQL; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
