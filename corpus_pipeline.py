"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages are written as Parquet to the shared folder
and reread, so each starts from a table and a lost executor never costs more than the running stage.

Defined results: a document with a null or empty text fails the quality rules and goes; a null source is a host of its own in quality and no site in
line dedup; of repeated rows of one doc_id, and of a group of near copies, one row stays (the least doc_id, then the least row), rows without doc_id
all stay; texts of any length are worked on whole; a benchmark without items, or an empty documents table, gives what the other stages leave of it. All stages but
the last return the columns of documents, further columns whatever their names included; the last returns doc_id, lang, source, n_tokens, ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import decontaminate, line_dedup, quality, sentencepieces, simhash
from strandloom.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and aren't depleted, without the lines that their host repeats too often."""
    return quality.stage(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of many sites leave the texts."""
    return line_dedup.stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.removed_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages for a twentieth of their words or more go."""
    return decontaminate.removed_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids."""
    return sentencepieces.stage(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_rules),
    ("line_dedup", lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Near-dedup and token ids are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
