"""The corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. Stages are written as Parquet and read again by the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import decontaminate, mixing, quality, simhash, substring
from tidewright.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and short texts go. A row goes by its own text: rows alike stay or go
    together, null ids are like others. Columns, extra ones too, are as they were.
    """
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id, nulls being the greatest.

    A row goes by its own text, whatever other rows have its id; of rows alike in id and text one stays.
    """
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that stand in an earlier one; n_chars is the new length.

    A row loses what its own text repeats, whatever other rows have its id; rows alike in id
    and text are one document and lose the same. A row may be left with an empty text. Null texts are as they were.
    """
    return substring.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark.

    A row goes by its own text, whatever other rows have its id. Null and empty texts are
    clean, and so is all when the benchmark is empty.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: a row for each use of a document, with its block, place and text.

    Repeated rows are used as often as they are there; rows with one id or none each have their own text.
    """
    return mixing.mix_texts(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: The isolation forest and the gear hash are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
