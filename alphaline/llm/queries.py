"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from alphaline.llm import decontam, langid, lexical, licenses, lines, mixing, quality, recompress, simhash, suffixes, toolcalls, urls, whitening
from alphaline.llm.shared import read_table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.substring_report(read_table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(read_table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.format_chats(read_table(spark, sf_dir, "conversations"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read_table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read_table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeat_report(read_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(read_table(spark, sf_dir, "documents"))


def op10_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), keep=["doc_id"])


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(read_table(spark, sf_dir, "documents"))


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_language_id": op5_language_id,
    "op6_quality_rules": op6_quality_rules,
    "op7_url_filters": op7_url_filters,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing_weights": op10_mixing_weights,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_license_scans": op12_license_scans,
    "op13_ranked_lexical_search": op13_ranked_lexical_search,
}

ORACLES: dict[str, str] = {
    "op1_benchmark_decontamination": decontam.ORACLE,
    "op2_substring_dedup": recompress.ORACLE,
    "op4_chat_formatting": toolcalls.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op7_url_filters": urls.ORACLE,
    "op9_line_dedup": lines.ORACLE,
    "op12_license_scans": licenses.ORACLE,
    "op13_ranked_lexical_search": lexical.ORACLE,
}
