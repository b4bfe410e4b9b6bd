"""The registered corpus queries, each over its whole table, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import (
    chat_tools, decontaminate, fewest_bins, licenses, near_dup, packing, pii, quality_model, quality_rules, spelling, token_store, tokens, url_filter, whitening,
)
from lectern.llm.common import table
from lectern.llm.twins import CHAT_TOOLS, DECONTAMINATION, NEAR_DUPLICATES, PERSONAL_DATA, QUALITY_RULES, SPELLING


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.fit(url_filter.hand_labels(pages)))


def op4_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tools.format_messages(*chat_tools.calls_of(table(spark, sf_dir, "conversations")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, as its contract says."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(spark, table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_fewest_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fewest_bins.pack(table(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"))


QUERIES = {
    "op1_pii": (op1_pii, PERSONAL_DATA),
    "op2_quality_rules": (op2_quality_rules, QUALITY_RULES),
    "op3_url_filter": (op3_url_filter, None),
    "op4_chat_tools": (op4_chat_tools, CHAT_TOOLS),
    "op5_packing": (op5_packing, None),
    "op6_decontamination": (op6_decontamination, DECONTAMINATION),
    "op7_near_duplicates": (op7_near_duplicates, NEAR_DUPLICATES),
    "op8_licenses": (op8_licenses, None),
    "op9_quality_classifier": (op9_quality_classifier, None),
    "op10_token_store": (op10_token_store, None),
    "op11_spelling_variants": (op11_spelling_variants, SPELLING),
    "op12_whitening": (op12_whitening, None),
    "op13_fewest_sequences": (op13_fewest_sequences, None),
}
