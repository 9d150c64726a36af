"""Queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontaminate, html_text, language_id, lexical, line_dedup, quality, secrets, sentencepieces, simhash, token_counts, url_filter, warc
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"), copies_once=False)


def op4_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digest(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.digest(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.digest(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.digest(spark, sf_dir)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.digest(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_simhash": op2_simhash,
        "op3_line_dedup": op3_line_dedup,
        "op4_sentencepieces": op4_sentencepieces,
        "op5_language_id": op5_language_id,
        "op6_html_text": op6_html_text,
        "op7_token_counts": op7_token_counts,
        "op8_quality": op8_quality,
        "op9_secrets": op9_secrets,
        "op10_url_filter": op10_url_filter,
        "op11_collocations": op11_collocations,
        "op12_warc": op12_warc,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontaminate.SQL,
        "op3_line_dedup": line_dedup.SQL,
        "op8_quality": quality.SQL,
        "op10_url_filter": url_filter.SQL,
        "op11_collocations": collocations.SQL,
        "op12_warc": warc.SQL,
        "op13_lexical_search": lexical.SQL,
    }
