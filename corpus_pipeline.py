"""From raw documents to packed training sequences, stage by stage.

Every stage reads the table that the one before it wrote. All but the last return the
columns of ``documents``; what a stage decides about a row holds for all later ones.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm import decontam, lines, minhash, packing, quality
from mailsift.llm.common import table
from mailsift.sources.scratch import land

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _keep(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of a stage's input that its decisions ``doc_id, kept`` do not reject.

    Only rejected ids meet the documents. A row without an id cannot be named, so it stays.
    """
    rejected = land(decided.filter("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "rejected")
    return docs.join(rejected, "doc_id", "left_anti").select(docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies within the bounds of their language (operator 5)."""
    trusted = quality.trusted_ids(table(spark, sf_dir, "labels"))
    return _keep(docs, quality.classify(docs, trusted))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share (operator 3).

    ``n_chars`` follows the text of documents that lost lines.
    """
    out = lines.drop_shared_lines(docs)
    changed = (F.col("n_dropped") > 0) & F.col("n_chars").isNotNull()
    count = F.when(changed, F.char_length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", count.cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id (operator 1)."""
    return _keep(docs, minhash.near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 4)."""
    leaks = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return _keep(docs, leaks.select("doc_id", F.lit(False).alias("kept")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens (operator 9)."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: No SQL: a trained model, hashed signatures and a tokenizer are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), name)
    return docs
