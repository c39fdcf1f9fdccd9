"""The corpus pipeline: documents that pass five stages become token ids.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Null, empty and blank texts are
scored like others and are copies of each other, so at most one of them is left; rows with a null doc_id pass the
near-dedup stage; of repeated rows one passes it. Columns beyond those of documents are left behind, so names cannot
clash. An empty table runs through to an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediapulse.llm.bpe import bpe_encode
from mediapulse.llm.common import discard, table, written
from mediapulse.llm.decontaminate import decontaminate
from mediapulse.llm.quality import score_quality
from mediapulse.llm.queries import vocabulary
from mediapulse.llm.simhash import keep_one
from mediapulse.llm.substring import substring_dedup

#: All stages but the last return these columns of documents, and no others.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL cannot express these stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones."""
    scored = score_quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one(docs.select(*COLUMNS))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier document holds; n_chars follows the text."""
    cut = substring_dedup(docs.select(*COLUMNS))
    n_chars = F.when(F.col("n_removed_runs") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return cut.withColumn("n_chars", n_chars).select(*COLUMNS)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that benchmark windows cover; those that are half benchmark or more go."""
    found = decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), clean=True)
    found = found.where("n_hit = 0 or 2 * n_hit < n_words")
    n_chars = F.when(F.col("n_hit") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return found.withColumn("n_chars", n_chars).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document."""
    return bpe_encode(docs, vocabulary()).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", passage_dedup),
    ("benchmark decontamination", benchmark_filter),
    ("bpe encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each one's result is written, read again, and deleted after its successor's."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        discard(before)
    return docs
