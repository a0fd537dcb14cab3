"""A training-data pipeline over `documents`: classify, drop near copies, decontaminate, redact secrets, tokenize.

Each stage reads what the one before wrote. No stage can be said in SQL as a whole (the classifier is fitted, near copies need
XXH64, the tokenizer merges by rank), so ORACLE_SQL is None; tests/llm holds run()'s rows on a small table against a plain version
of every stage.

In all stages a null text counts as empty and stays null where texts are returned, an empty table gives an empty table, texts of any
length are taken whole, and further columns are returned whatever their names (the last stage returns its own columns only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bpe_transducer, importance_resampling, qgram_decontam, secret_ledger, simhash_neardup
from folioflow.llm.common import remove, shared_dir, table

ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps. Null or empty texts are told neither good nor bad (log importance 0), null ids
    share one noise, ties with the last kept one and repeated rows stay together; without labels all stay."""
    return importance_resampling.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (sets of five-word shingles of similarity 0.8 or more), that with the smallest id.
    Null and empty texts are copies of each other; rows without an id stay; of repeated rows one stays."""
    return simhash_neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark. Null and empty texts, and all where the benchmark is empty, stay; repeated rows
    stay or go alike."""
    return qgram_decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; n_chars follows the text (null texts and their n_chars stay null; repeated rows stay)."""
    out = secret_ledger.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) for training: no tokens for null and empty texts, a row for each row."""
    return bpe_transducer.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", classify),
    ("near-duplicates", drop_near_copies),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote is removed when the next one has read it; the last folder stays for the reader."""
    docs, at = table(spark, sf_dir, "documents"), shared_dir(spark)
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{n}")
        docs = spark.read.parquet(f"{at}/{n}")
        if n:
            remove(spark, f"{at}/{n - 1}")
    return docs
