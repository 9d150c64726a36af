"""Biconnected components by DataFrame rounds against the depth-first kernel."""

import random

import pytest
from strandloom.kernels import graphs
from strandloom.operators.biconnected import biconnected_components


def by_kernel(edges):
    edges = sorted(edges)
    label = graphs.biconnected(edges)
    least = {}
    for e, c in zip(edges, label):
        least.setdefault(c, e)
    return {e: "-".join(map(str, least[c])) for e, c in zip(edges, label)}


def frame(spark, edges):
    return spark.createDataFrame(list(edges), "source long, target long")


def test_random_graphs(spark):
    rng, edges = random.Random(2), set()
    for g in range(40):
        n, base = rng.randint(2, 14), 1000 * g
        for _ in range(rng.randint(1, 2 * n)):
            a, b = rng.sample(range(n), 2)
            edges.add((base + min(a, b), base + max(a, b)))
    want = by_kernel(edges)
    assert len(set(want.values())) > 60
    assert {(r.source, r.target): r.bcc for r in biconnected_components(frame(spark, edges)).collect()} == want


@pytest.mark.parametrize("partitions", [2, 7])
def test_giant_component(spark, partitions):
    """A long ring of rings with chords, a hub with many leaves and a long tail, as one component."""
    rng, edges = random.Random(4), set()
    for r in range(60):
        ring = list(range(20 * r, 20 * r + 20))
        edges |= {tuple(sorted((ring[i], ring[(i + 1) % 20]))) for i in range(20)}
        edges |= {tuple(sorted(rng.sample(ring, 2))) for _ in range(5)}
        edges.add((20 * r + 3, 20 * r + 20 if r < 59 else 5000))
    edges |= {(7, 6000 + i) for i in range(800)} | {(8000 + i, 8001 + i) for i in range(300)} | {(9, 8000)}
    want = by_kernel(edges)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {(r.source, r.target): r.bcc for r in biconnected_components(frame(spark, edges)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == want


def test_loops_parallels_and_nothing(spark):
    d = frame(spark, [(1, 2), (2, 1), (2, 3), (4, 4), (None, 5)])
    got = sorted(((r.source, r.target, r.bcc) for r in biconnected_components(d).collect()), key=str)
    assert got == sorted([(1, 2, "1-2"), (2, 1, "1-2"), (2, 3, "2-3"), (4, 4, "4-4"), (None, 5, None)], key=str)
    assert biconnected_components(d.limit(0)).isEmpty()
