"""Phrase collocations against plain counting."""

import random

import pytest
from pyspark.sql import functions as F
from strandloom.llm import collocations
from strandloom.llm.common import looked_up

SCHEMA = "doc_id long, text string, lang string"


def rows():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)] + ["New", "York", "é", "日本", "a\x0bb\x00"]
    out = [(i, rng.choice([" ", "  ", "\t"]).join(rng.choice(vocab) + rng.choice(["", "", "", ",", ".", "!\n"]) for _ in range(rng.randint(1, 60))), rng.choice(["en", "de", None, "und"])) for i in range(300)]
    out += [(1000 + i, "New York City; san francisco bay area. of the", "en") for i in range(40)]
    out += [(2000, " ".join(rng.choice(vocab) for _ in range(30_000)), "fr"), (2001, None, "en"), (2002, "", None), (2003, " \t.,;\n", "xx"), (None, "New York City", None)]
    return out + out[:50]


def test_against_plain_counting(spark):
    want = collocations.brute_force([(t, g) for _, t, g in rows()])
    d = spark.createDataFrame(rows(), SCHEMA).select("*", *[F.lit(7).alias(c) for c in ("piece", "n", "gram", "f", "part", "role", "rank", "words", "head")])
    assert sorted(map(tuple, collocations.digest(d).collect())) == sorted(want) and len(want) > 500
    few = collocations.collocations(d, top=3, bucket_words=1000)
    assert sorted(map(tuple, few.collect())) == sorted(x for x in want if x[1] <= 3)
    assert collocations.digest(d.limit(0)).isEmpty()


def test_chunks_and_scratch_do_not_change_counts(spark):
    d = spark.createDataFrame(rows(), SCHEMA)
    found = collocations.pieces(d)
    small = collocations.counted(collocations.weighted_grams(found, chunk_words=50), 7, memory="32MB")
    large = collocations.counted(collocations.weighted_grams(found), 2)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_scores_beyond_64_bits(spark):
    a, left, right = 3_000_000_007, 4_000_000_009, 9_000_000_001
    counts = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, left), ("en", "y", 1, right)], "lang string, gram string, words int, f long")
    assert [r.score for r in collocations.scored(counts).collect()] == [1_000_000 * a * a // (left * right)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_looked_up_hot_keys(spark, how):
    asked = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "i long, k string")
    answers = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 300, 2)], "k string, v long")
    assert sorted(map(str, looked_up(asked, answers, ["k"], how, hot_rows=20).collect())) == sorted(map(str, asked.join(answers, ["k"], how).collect()))
