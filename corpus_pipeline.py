"""Corpus pipeline: documents to packed training sequences.

Every stage takes what the one before kept, reread from Parquet. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm import exact_dedup, near_dedup, packing, quality, secret_scan
from sentrel.llm._store import written
from sentrel.llm.queries import byte_tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the labels, accepts.

    Null text is judged as empty; repeated rows stay or go together; without documents none come out.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.train(docs, quality.graded(labels)))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest identifier.

    Null text equals an empty one. A null identifier loses to any other, so such a row stays only where
    nothing else has its text. Of repeated rows (identifier and text) one stays.
    """
    return exact_dedup.deduplicated(docs, keep="largest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest identifier, null last.

    Texts without words (null, empty) are classes of their own; of repeated rows one stays.
    """
    return near_dedup.deduplicated(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts and n_chars to match.

    Null text stays null and keeps its n_chars; rows that share an identifier or repeat are redacted each.
    """
    clean = secret_scan.redact(docs, secret_scan.train(words=secret_scan.dictionary(docs)))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1,024 tokens.

    Null text is the closing token alone; each row is placed by itself, whether or not its identifier
    repeats; without documents there are no pieces.
    """
    return packing.pack(docs, byte_tokenizer())


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]
#: A trained classifier, signatures and retrieval are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
