"""The duals of the matching prove it optimal; other matchings and other duals don't pass as proofs."""

import random

import pytest
from pyspark.sql import functions as F
from strandloom.kernels import graphs
from strandloom.operators import grouped


def random_edges(rng, n, m, base=0):
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return [(base + a, base + b, rng.randint(1, 9)) for a, b in sorted(pairs)]


def best_weight(edges):
    if not edges:
        return 0
    (u, v, w), rest = edges[0], edges[1:]
    return max(best_weight(rest), w + best_weight([e for e in rest if not {u, v} & set(e[:2])]))


def test_kernel_duals():
    rng, with_blossoms = random.Random(8), 0
    for _ in range(400):
        n = rng.randint(2, 9)
        edges = random_edges(rng, n, rng.randint(1, 14))
        picked, y, blossoms = graphs.matching_with_duals(edges)
        weight = sum(edges[i][2] for i in picked)
        assert weight == best_weight(edges)
        assert all(x >= 0 for x in y.values()) and all(z > 0 and len(b) % 2 for b, z in blossoms)
        assert all(y[u] + y[v] + sum(z for b, z in blossoms if u in b and v in b) >= 2 * w for u, v, w in edges)
        assert sum(y.values()) + sum(z * (len(b) - 1) // 2 for b, z in blossoms) == 2 * weight
        with_blossoms += bool(blossoms)
    assert with_blossoms > 20


@pytest.fixture(scope="module")
def case(spark):
    rng, edges = random.Random(6), []
    for g in range(60):
        edges += random_edges(rng, rng.randint(2, 11), rng.randint(1, 25), 100 * g)
    # Equal weights on odd rings: nothing is heavy there, and blossoms have duals.
    for g in range(60, 80):
        n = rng.choice([3, 5, 7])
        edges += [(100 * g + min(i, (i + 1) % n), 100 * g + max(i, (i + 1) % n), 5) for i in range(n)]
    cand = spark.createDataFrame(edges, "source long, target long, bw long").cache()
    return cand, [grouped.settled(t, "case") for t in grouped.matching_with_duals(cand)]


def verdict(rows):
    out = rows.agg(F.count("*"), F.min("covered"), F.min("optimal")).first()
    return out[0], out[1] and out[2]


def test_proof(case):
    cand, (matched, duals, blossoms) = case
    assert not blossoms.isEmpty()
    assert verdict(grouped.matching_proof(cand, matched, duals, blossoms)) == (cand.count(), True)


def test_wrong_proofs_fail(case):
    cand, (matched, duals, blossoms) = case
    one = matched.orderBy("source").limit(1)
    less = matched.join(one, ["source", "target"], "left_anti")
    assert not verdict(grouped.matching_proof(cand, less, duals, blossoms))[1]
    assert not verdict(grouped.matching_proof(cand, matched, duals.withColumn("y", F.col("y") - F.when(F.col("node") == duals.orderBy("node").first()["node"], 1).otherwise(0)), blossoms))[1]
    assert not verdict(grouped.matching_proof(cand, matched, duals, blossoms.limit(0)))[1]
    assert not verdict(grouped.matching_proof(cand, cand, duals, blossoms))[1]


def test_nothing_to_match(spark, case):
    cand, _ = case
    none = cand.limit(0)
    assert grouped.matching_proof(none, *grouped.matching_with_duals(none)).isEmpty()
