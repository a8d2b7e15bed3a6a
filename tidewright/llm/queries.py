"""The training-data queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import chat, decontaminate, licenses, mixing, quality, simhash, substring, token_counts, toxicity, urls
from tidewright.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.spans(table(spark, sf_dir, "documents"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a page's path is its document's id; documents of quality 0 are bad."""
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path_key"), (F.col("quality") == 0).alias("bad"))
    return urls.judge(table(spark, sf_dir, "pages"), labelled)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline; it is at the repository's top and built on this package, so it is imported when it is called."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_license_scans": op2_license_scans,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_token_counts": op10_token_counts,
    "pipeline": pipeline,
}
ORACLE_SQL: dict[str, str] = {
    "op2_license_scans": licenses.ORACLE_SQL,
    "op3_chat_formatting": chat.ORACLE_SQL,
    "op4_decontamination": decontaminate.ORACLE_SQL,
    "op7_url_filters": urls.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
}
