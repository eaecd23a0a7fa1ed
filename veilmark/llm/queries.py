"""Registered queries of the operators for text corpora, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import op1_license_scan

    return op1_license_scan(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import op2_language_id

    return op2_language_id(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import op3_pii

    return op3_pii(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import op4_quality_rules

    return op4_quality_rules(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import op5_url_filter

    return op5_url_filter(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import op6_decontamination

    return op6_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import op7_warc

    return op7_warc(table(spark, sf_dir, "pages"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import op8_byte_bpe

    return op8_byte_bpe(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import op9_jaccard_join

    return op9_jaccard_join(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import op10_quality_classifier

    return op10_quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .word_bpe import op11_word_bpe

    return op11_word_bpe(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import op12_periodic_runs

    return op12_periodic_runs(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import op13_conversation_repair

    return op13_conversation_repair(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    found = [
        op1_license_scan, op2_language_id, op3_pii, op4_quality_rules, op5_url_filter, op6_decontamination, op7_warc, op8_byte_bpe, op9_jaccard_join, op10_quality_classifier,
        op11_word_bpe, op12_periodic_runs, op13_conversation_repair,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
