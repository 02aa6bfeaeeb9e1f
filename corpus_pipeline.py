"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from alphaline.llm import decontam, lines, mixing, nearcopies, quality
from alphaline.llm.shared import cut, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality rules accept; rows are judged one by one, null texts go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out repeated three-line windows; documents left without a word go.

    Null texts stay; a null doc_id comes before all others; rows equal in doc_id and text stay equal.
    """
    return lines.drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, with the smallest id, of each group of 5-word Jaccard 0.8 or more.

    Null ids come last; of rows that repeat an id and differ in text each stands for its own group.
    """
    return nearcopies.keep_first_of_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop every document that holds a benchmark passage, however small a part of it.

    Rows are judged by their text, so null and repeated ids neither save nor cost a row.
    """
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add tokens, domain posteriors, rate and ``target_gap`` to every document that is left.

    All columns and rows stay; equal rows and rows that repeat an id, or have none, are rated one by one.
    """
    return mixing.mix(docs, read_table(spark, sf_dir, "labels"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing_weights", mixing_weights),
]

#: SQL can't express the near-duplicate and fitting stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; each stage's rows are written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
