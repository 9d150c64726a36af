"""Texts that a stage neither changes nor removes aren't shuffled, however small the tables are that may be broadcast."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandloom.llm import line_dedup, simhash
from strandloom.operators.joins import likely


@pytest.fixture
def no_broadcast(spark):
    keys = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _rows():
    rng = random.Random(5)
    said = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=9)) for _ in range(n))
    rows = [(i, said(1500), f"s{i}") for i in range(200)]
    menu = said(5)
    rows += [(200 + i, menu + "\n" + said(300), f"s{i}") for i in range(12)]
    return rows + [(300 + i, rows[i][1] + " more", "s1") for i in range(5)] + [(7, rows[7][1], "s7"), (None, said(60), "s1"), (None, None, "s2"), (400, None, "s3")], menu


def _shuffled(spark, df):
    summary = spark.sparkContext._jsc.sc().statusStore().executorSummary
    before = summary("driver").totalShuffleWrite()
    rows = [tuple(r) for r in df().collect()]
    return rows, summary("driver").totalShuffleWrite() - before


def test_likely(spark):
    rows = spark.range(-3000, 3000).select(F.col("id"), F.xxhash64("id").alias("h"))
    asked = spark.range(0, 300).select(F.xxhash64("id").alias("a"))
    marked = {r["id"] for r in likely(rows, F.col("h"), asked, F.col("a")).collect() if r["__likely"]}
    assert set(range(300)) <= marked and len(marked) < 310
    assert likely(rows, F.col("h"), asked.limit(0), F.col("a")).filter("__likely").isEmpty()
    assert likely(rows, F.col("h"), asked, F.col("a")).count() == 6000


def test_lines(spark, no_broadcast):
    rows, menu = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, moved = _shuffled(spark, lambda: line_dedup.deduped(docs, at=None))
    assert sorted(got, key=str) == sorted(((i, t and t.removeprefix(menu + "\n"), s) for i, t, s in rows), key=str)
    assert moved < 0.5 * sum(len(t or "") for _, t, _ in rows)


def test_copies(spark, no_broadcast):
    rows, _ = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, moved = _shuffled(spark, lambda: simhash.removed_copies(docs))
    left = {r[0]: r for r in rows[:212]} | {400: rows[-1]}
    assert sorted(got, key=str) == sorted([*left.values(), *(r for r in rows if r[0] is None)], key=str)
    assert moved < 0.5 * sum(len(t or "") for _, t, _ in rows)
