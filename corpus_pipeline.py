"""Corpus preparation: filter, deduplicate, redact and pack ``documents``.

Each stage calls one operator of ``sessionflow.llm`` with the documents that
its predecessor kept. All stages but the last return the columns of
``documents``; each result is written as Parquet and read again.

Edge cases: a null text is empty for every decision and stays null where its
row stays. Repeated rows are judged alike; near-dedup keeps one of them. An
empty table passes through. Extra columns are carried along unread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionflow.llm import packing, pii, quality, simhash, toxicity
from sessionflow.llm.common import held_out, staged, table
from sessionflow.llm.queries import ship, tokenizer_file


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity operator marks."""
    ship(spark)
    score = "_" * max(map(len, docs.columns)) + "score"
    scored = toxicity.scored(docs, table(spark, sf_dir, "labels"), held_out(F.col("doc_id"), 5, 0), score)
    return scored.where(F.col(score) < 0.5).drop(score)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    ship(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), held_out(F.col("doc_id"), 3, 1))
    return docs.where(quality.score(model, F.col("text")) >= 0.5)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group."""
    ship(spark)
    return simhash.drop_near_duplicates(docs, shingle=3, max_bits=3)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts; ``n_chars`` follows the new text."""
    ship(spark)
    model = pii.fit(docs)
    redacted = docs.withColumn("text", pii.redact(model, F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        redacted = redacted.withColumn(
            "n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars"))
        )
    return redacted


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into training sequences: one row per piece."""
    ship(spark)
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), 2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("simhash", simhash_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Trained models, hashes and tokenizers: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
