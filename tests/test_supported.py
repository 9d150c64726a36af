"""Supported paths against the depth-first search of the kernel."""

import random

import pytest
from strandloom.config import DEFAULT
from strandloom.kernels import paths
from strandloom.operators.supported import supported_paths, supporting_parts


def world(seed, n=9):
    rng, edges = random.Random(seed), {}
    for c in range(n):
        edges[2 * c, 2 * c + 1] = (True, rng.randint(500, 1500), 0)
    while len(edges) < 4 * n:
        u, v = sorted(rng.sample(range(2 * n), 2))
        if u // 2 != v // 2:
            edges[u, v] = (False, rng.randint(-50, 3000), rng.randint(50, 400))
    reads = [(u, v, r, rng.randint(1, 6)) for u, v in edges for r in range(4) if rng.random() < 0.75]
    return edges, reads, {rng.randrange(2 * n) for _ in range(2)}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_the_kernel(spark, seed):
    edges, reads, blocked = world(seed)
    asked = [(u, v, d, sd) for (u, v), (kind, d, sd) in edges.items() if not kind and d >= 1000]
    ids = {e: i for i, e in enumerate(sorted(edges))}
    g = paths.Graph({ids[e]: [*e, k, d, sd, 0] for e, (k, d, sd) in edges.items()})
    on = {}
    for u, v, r, h in reads:
        on.setdefault(ids[u, v], {})[r] = h
    want = set()
    for u, v, d, sd in asked:
        i = ids[u, v]
        needed = [r for r, h in on.get(i, {}).items() if h > DEFAULT.read_hits]
        found = paths.search(g, u, v, d, sd, lambda n: n not in blocked, lambda p, needed=needed: all(r in on.get(x, ()) for x in p for r in needed), 10**7, 10**6, skip=i)
        for nodes, path in found:
            plen, pvar = paths.measure(g, path)
            want.add((u, v, tuple(nodes), plen, pvar, sum(on[x][r] for x in path for r in needed)))
    e = spark.createDataFrame([(u, v, k, d, sd) for (u, v), (k, d, sd) in edges.items()], "source long, target long, dummy boolean, bd long, bd_std long")
    a = spark.createDataFrame(asked, "source long, target long, bd long, bd_std long")
    r = spark.createDataFrame(reads, "source long, target long, read_id long, hits long")
    b = spark.createDataFrame([(x,) for x in blocked], "node long")
    got = {(x.source, x.target, tuple(x.path), x.plen, x.pvar, x.weight) for x in supported_paths(e, a, r, b).collect()}
    assert got == want and want
    assert supported_paths(e, a.limit(0), r, b).isEmpty()


def test_division_leaves_unsupported_parts_out(spark):
    r = spark.createDataFrame([(1, 2, 7, 5), (1, 2, 8, 3), (1, 2, 9, 2), (3, 4, 7, 1), (3, 4, 8, 1), (5, 6, 7, 9), (1, 3, 1, 1)], "source long, target long, read_id long, hits long")
    a = spark.createDataFrame([(1, 2), (1, 3)], "source long, target long")
    assert sorted(map(tuple, supporting_parts(a, r).collect())) == [(1, 2, 1, 2, 8), (1, 2, 3, 4, 2)]
