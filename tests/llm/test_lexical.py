"""Ranked lexical search against scoring every document."""

import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from strandloom.llm import lexical


def tables():
    rng = random.Random(9)
    vocab = [f"term{i}" for i in range(60)] + ["Ünï", "日本", "x9"]
    docs = [(rng.choice([i, -i]), " ".join(rng.choice(vocab[: rng.randint(5, 63)]) for _ in range(rng.randint(1, 80)))) for i in range(1, 400)]
    docs += [(None, "term1 term2 rare"), (None, "term1 term2 rare"), (5000, "rare " * 3), (5000, "rare " * 3), (6000, None), (6001, ""), (6002, "!!, --"), (2**62, "term3 " * 30_000 + "rare")]
    docs += [(7000 + i, "same words again") for i in range(120)]
    items = [(1, "Term1, term2; RARE rare"), (2, "same words"), (3, None), (4, ""), (5, "unheard of"), (None, "ünï x9"), (6, " ".join(vocab)), (6, "same"), (7, "rare"), (8, "日本")]
    return docs, items


def test_against_scoring_every_document(spark):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit(7).alias(c) for c in ("id", "term", "shard", "q", "score", "rank", "n_words")])
    i = spark.createDataFrame(items, "item_id long, text string").select("*", F.lit(1).alias("q"), F.lit(2).alias("rank"), F.lit(3).alias("__asked"))
    want = sorted(lexical.brute_force(docs, items), key=repr)
    assert sorted(map(tuple, lexical.digest(d, i).collect()), key=repr) == want and len(want) > 200
    index = lexical.build_index(d, shard_words=500, shard_docs=20).cache()
    assert index.select("shard").distinct().count() > 20
    assert sorted(map(tuple, lexical.search(index, i, block_terms=20, block_queries=1).collect()), key=repr) == want
    three = sorted(lexical.brute_force(docs, items, 3), key=repr)
    assert sorted(map(tuple, lexical.search(index, i, 3).collect()), key=repr) == three
    assert lexical.digest(d.limit(0), i).isEmpty() and lexical.digest(d, i.limit(0)).isEmpty() and lexical.digest(d, i.filter("item_id = 5")).isEmpty()


def test_windows_of_the_merge():
    rng = np.random.default_rng(3)
    n = 5 * lexical.WINDOW + 17
    lists, total = [], np.zeros(n, np.int64)
    for k in (1, 40, 3000, n // 2):
        docs = np.sort(rng.choice(n, k, replace=False))
        parts = rng.integers(1, 50, k)
        lists.append((docs, parts, 3))
        total[docs] += 3 * parts
    ids = [int(x) for x in np.sort(rng.choice(10 * n, n, replace=False))]
    best = lexical._Best(20)
    lexical.merge(lists, ids, best)
    want = sorted(((-s, i) for s, i in zip(total.tolist(), ids) if s), key=lambda x: x)[:20]
    assert sorted((-s, -i) for s, _, i in best.heap) == want


@given(st.lists(st.integers(0, 2**64 - 1)))
def test_packed_numbers(values):
    body, ends = lexical.packed(np.array(values, np.uint64))
    assert lexical.unpacked(body.tobytes()).tolist() == values and len(ends) == len(values)
