"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, language, minhash, packing, quality, quality_rules, suffix_dedup, token_counts, toxicity
from .common import read_table


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.query(spark, read_table(spark, sf_dir, "documents"))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), minhash.Similarity(shingle=3, percent=85))


def op2_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.query(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.query(read_table(spark, sf_dir, "conversations"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.query(read_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(read_table(spark, sf_dir, "documents"))


def quality_rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.base_query(read_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_quality_mil": op2_quality_mil,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_token_counts": op5_token_counts,
    "op6_language_id": op6_language_id,
    "op7_chat_format": op7_chat_format,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality_rules": op9_quality_rules,
    "quality_rules_base": quality_rules_base,
    "op10_decontaminate": op10_decontaminate,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": minhash.SQL,
    "op7_chat_format": chat.SQL,
    "op8_suffix_dedup": suffix_dedup.SQL,
    "quality_rules_base": quality_rules.BASE_SQL,
    "op10_decontaminate": decontaminate.SQL,
}
