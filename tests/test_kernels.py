"""Graph and sequence kernels against hand-worked cases and plain definitions."""

import random

import pytest
from strandloom.config import DEFAULT
from strandloom.kernels import align, gaps, graphs, paths


def brute_weight(edges, used=frozenset(), i=0):
    best = 0
    for k in range(i, len(edges)):
        u, v, w = edges[k]
        if u not in used and v not in used:
            best = max(best, w + brute_weight(edges, used | {u, v}, k + 1))
    return best


def test_matching_is_best_on_small_graphs():
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randint(2, 8)
        edges = [(u, v, rng.randint(1, 12)) for u in range(n) for v in range(u) if rng.random() < 0.5][:12]
        got = graphs.max_weight_matching(edges)
        ends = [x for i in got for x in edges[i][:2]]
        assert len(ends) == len(set(ends))
        weight = sum(edges[i][2] for i in got)
        assert weight == brute_weight(edges)
        assert weight >= sum(edges[i][2] for i in graphs.greedy_matching(edges))


def test_matching_and_greedy_by_hand():
    edges = [(0, 1, 5), (1, 2, 8), (2, 3, 5)]
    assert sum(edges[i][2] for i in graphs.max_weight_matching(edges)) == 10
    assert sum(edges[i][2] for i in graphs.greedy_matching(edges)) == 8
    assert graphs.max_weight_matching([]) == []


def test_biconnected_components():
    labels = graphs.biconnected([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3)])
    assert labels[0] == labels[1] == labels[2] and labels[4] == labels[5] == labels[6]
    assert len({labels[0], labels[3], labels[4]}) == 3


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[j - 1] + 1))
    return row[-1]


def test_semi_global_alignment():
    rng = random.Random(3)
    for _ in range(80):
        q, t = ("".join(rng.choice("ACGT") for _ in range(rng.randint(1, n))) for n in (20, 40))
        edits, start, end = align.semi_global(q, t)
        every = [[distance(q, t[a : b + 1]) for a in range(b + 1)] for b in range(len(t))]
        assert edits == min(min(x) for x in every)
        assert end == next(b for b, x in enumerate(every) if min(x) == edits)
        assert start == max(a for a, e in enumerate(every[end]) if e == edits)
        assert sum(c != "=" for c in align.path(q, t)) == distance(q, t)


def test_lis_and_chains():
    assert len(align.lis([3, 1, 2, 5, 4])) == 3 and align.lis([]) == []
    rng = random.Random(1)
    for _ in range(50):
        v = [rng.randint(0, 9) for _ in range(rng.randint(0, 12))]
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        assert len(align.lis(v)) == max(best, default=0)
    line = [(i * 100, i * 100 + 7) for i in range(6)]
    assert align.chains(line, False) == [(0, 500, 7, 507, 6, 500, 500)]
    assert align.chains([(t, 1000 - q) for t, q in line], True)[0][4] == 6
    assert align.chains(line[:3], False) == []


def test_greedy_cover():
    hits = [(0, 1000, 9, 900), (100, 500, 8, 300), (900, 1500, 7, 400), (950, 1100, 6, 100)]
    assert align.greedy_cover(hits) == [0, 2]


def noisy(rng, s):
    return "".join(rng.choice("ACGT") if rng.random() < 0.05 else c for c in s if rng.random() > 0.02)


def test_consensus_and_gap_filling():
    rng = random.Random(2)
    true = "".join(rng.choice("ACGT") for _ in range(1200))
    text, depth = align.consensus([noisy(rng, true[:200]) for _ in range(9)])
    assert distance(text, true[:200]) <= 3 and len(text) == len(depth)
    lead, others = noisy(rng, true), [noisy(rng, true) for _ in range(7)]
    cns, cover = gaps.gap_consensus(lead, others)
    assert distance(cns, true) < distance(lead, true) / 2 and len(cns) == len(cover)
    got = gaps.joined(cns, cover, true[:100], true[-100:], 1000, 30)
    assert got["proper_gap"] == 1 and abs(got["overlap"] - 1000) < 20
    assert gaps.gap_consensus("", [])[0] == ""


def test_polishing_replaces_an_aligned_span():
    rng = random.Random(4)
    true = "".join(rng.choice("ACGT") for _ in range(400))
    gap = true[:200] + ("A" if true[200] != "A" else "C") + true[201:]
    fixed, n = gaps.polished(gap, [true[100:300]], 0.8)
    assert n == 1 and distance(fixed, true) <= 1
    assert gaps.polished(gap, [], 0.8) == (gap, 0)


def test_transitive_reduction_by_hand():
    # Contigs 0, 1, 2; mate edges 1-2, 3-4 and the long one 1-4 beside them.
    edges = {0: [0, 1, True, 3000, 0, 0], 1: [2, 3, True, 3000, 0, 0], 2: [4, 5, True, 3000, 0, 0], 3: [1, 2, False, 500, 10, 6], 4: [3, 4, False, 700, 24, 7], 5: [1, 4, False, 4200, 60, 5]}
    reads = {i: {7: 4} for i in edges}
    changed, reduced = paths.reduce_component(edges, [5], reads, set(), DEFAULT)
    assert reduced == [(5, 4200, 26, 12)] and changed == {3: 11, 4: 12}
    reads[4] = {}
    assert paths.reduce_component(edges, [5], reads, set(), DEFAULT) == ({}, [])
    assert paths.reduce_component(edges, [5], {}, {2}, DEFAULT) == ({}, [])
    assert not paths.alternates([True, True]) and paths.alternates([True, False, True])


@pytest.mark.parametrize("seq,want", [("ACGTN", "NACGT"), ("acgR", "Ycgt")])
def test_revcomp(seq, want):
    assert gaps.revcomp(seq) == want


def test_band_gives_the_script_of_the_whole_table():
    rng = random.Random(12)
    for _ in range(400):
        q = "".join(rng.choice("ACGT"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 50)))
        t = "".join(c for c in q for c in [c, rng.choice("ACGT")][: rng.choice([0, 1, 1, 1, 1, 2])]) if rng.random() < 0.7 else "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 50)))
        whole = align.path(q, t, band=10_000)
        assert all(align.path(q, t, band=b) == whole for b in (1, 2, 5, 64))
        row = list(range(len(t) + 1))
        for i, c in enumerate(q, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(t, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        assert sum(c != "=" for c in whole) == row[-1]
        assert sum(c in "=XI" for c in whole) == len(q) and sum(c in "=XD" for c in whole) == len(t)


def test_work_follows_the_edits(monkeypatch):
    """Two alike sequences need no wider band, however long they are."""
    widths, made = [], align._Band.__init__
    monkeypatch.setattr(align._Band, "__init__", lambda self, q, t, k: (widths.append(k), made(self, q, t, k))[1])
    rng = random.Random(13)
    q = "".join(rng.choice("ACGT") for _ in range(6000))
    t = q[:1000] + "A" + q[1000:4000] + q[4020:]
    assert sum(c != "=" for c in align.path(q, t)) == 21 and widths == [64]
    align.path(q[:600], q[600:1200])
    assert widths[1:] == [64, 128, 256, 512]


def test_semi_global_scans_only_where_the_query_can_be(monkeypatch):
    rng, scan, columns = random.Random(3), align._scan, []

    def counted(query, target, within=None):
        columns.append(len(target))
        return scan(query, target, within)

    def plain(query, target):
        edits, ends = scan(query, target)
        return edits, ends[0] - min(scan(query[::-1], target[: ends[0] + 1][::-1], within=edits)[1]), ends[0]

    target = "".join(rng.choice("ACGT") for _ in range(5000))
    exact, other = target[3000:3200], target[3000:3090] + "A" + target[3092:3200]
    want = [plain(q, target) for q in (exact, other)]
    monkeypatch.setattr(align, "_scan", counted)
    assert [align.semi_global(q, target) for q in (exact, other)] == want and sum(columns) < 1000
    for _ in range(200):
        t = "".join(rng.choice("AC") for _ in range(rng.randint(0, 300)))
        a = rng.randint(0, max(0, len(t) - 1))
        q = "".join(c for c in t[a : a + 120] if rng.random() > 0.02)
        assert align.semi_global(q, t) == (plain(q, t) if q else (0, 0, 0))
