"""The corpus pipeline: quality, near copies, benchmark leaks, personal data, packing.

Every stage works on all its predecessor kept. All but the last return the columns of documents.
An empty table goes through as an empty one. Near copies and benchmark leaks are decided by row: rows
that repeat an id or have none are tested like any other, and only rows that fail go. Null texts are
empty ones. Other columns go along untouched up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, near_dup, packing, pii, quality_model, tokens
from lectern.llm.common import stored, table

LEAST_QUALITY = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below 0.3 go."""
    model = quality_model.train_held_in(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality_model.score(model) >= LEAST_QUALITY)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 or more over five-word shingles stays."""
    return near_dup.drop_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark text go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind; all documents stay."""
    hidden = pii.redact(docs)
    return hidden.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else hidden


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack(docs, tokens.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good), ("near-duplicates", drop_near_copies), ("decontamination", drop_leaks),
    ("personal data", hide_personal_data), ("packing", pack),
]
#: The classifier and the tokenizer can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
