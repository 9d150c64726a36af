"""Anchors of pairs against plain definitions, however they are cut into cells and rounds; and what they shuffle."""

import random
from collections import defaultdict

import pytest
from strandloom.config import DEFAULT
from strandloom.kernels import align, kmers
from strandloom.operators import anchors, sequences
from strandloom.plans import registry

SMALL = {"cell_rows": 700, "most": 50}


def family(n, length, seed=3):
    """Copies with changed bases, some turned around, and an empty one."""
    r = random.Random(seed)
    lead = "".join(r.choice("ACGT") for _ in range(length))
    out = [(0, ""), (1, None)]
    for i in range(2, n):
        s = "".join(r.choice("ACGT") if r.random() < 0.01 else c for c in lead[r.randrange(length // 4) :])
        out.append((i, s[::-1].translate(str.maketrans("ACGT", "TGCA")) if i % 5 == 0 else s))
    return out


def plain(rows, f):
    """{(qid, tid, rev): [(tpos, qpos)]} of even against odd sequences."""
    at, many, out = defaultdict(list), defaultdict(int), defaultdict(list)
    mins = [(i, int(c), int(p), bool(w), (int(k) + 1) * DEFAULT.w) for i, s in rows if s for ks, cs, ps, ws in kmers.minimizers(s, DEFAULT.k, DEFAULT.w) for k, c, p, w in zip(ks, cs, ps, ws)]
    for i, c, _, w, stop in mins:
        if i % 2:
            at[c].append((i, stop, w))
            many[c] += 1
    for i, c, p, w, _ in mins:
        if i % 2 == 0 and many[c] <= f:
            for t, stop, tw in at[c]:
                out[i, t, w != tw].append((stop, p))
    return out


@pytest.mark.parametrize("sizes", [{}, SMALL])
@pytest.mark.parametrize("f", [1000, 6])
def test_pairs_against_plain_python(spark, sizes, f):
    from dataclasses import replace

    data = family(20, 500)
    m = sequences.minimizer_codes(spark.createDataFrame(data, "id long, seq string"))
    q, t, want = m.filter("id % 2 = 0"), m.filter("id % 2 = 1"), plain(data, f)
    assert want
    got = sorted(map(tuple, anchors.totals(q, t, f, **sizes).collect()))
    assert got == sorted((*k, len(v), sum(x[1] for x in v), sum(x[0] for x in v)) for k, v in want.items())
    got = sorted(map(tuple, anchors.chains(q, t, replace(DEFAULT, f=f), **sizes).collect()))
    assert got == sorted((*k, *c) for k, v in want.items() for c in align.chains(v, k[2]))
    segs = []
    for k, v in want.items():
        run = []
        for x in sorted(v) if not k[2] else []:
            if not run or x[0] - run[-1][-1][0] > 20 or abs(x[1] - run[-1][-1][1]) > 20:
                run.append([])
            run[-1].append(x)
        segs += [(*k[:2], n, len(r), min(x[1] for x in r), max(x[1] for x in r), r[0][0], r[-1][0]) for n, r in enumerate(run)]
    assert sorted(map(tuple, anchors.segments(q, t, 20, f, **sizes).collect())) == sorted(segs)


def test_nothing_to_meet(spark):
    m = sequences.minimizer_codes(spark.createDataFrame([(0, "A" * 100), (2, None)], "id long, seq string"))
    assert anchors.totals(m, m.filter("id = 1")).count() == anchors.chains(m.filter("id = 1"), m).count() == anchors.segments(m, m.filter("id = 1")).count() == 0


def test_anchors_are_not_shuffled(spark, tmp_path):
    """400 texts with the same 60 passages in another order each: 2,000,000 anchors and more."""
    r = random.Random(5)
    passages = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(80)) for _ in range(60)]
    rows = [(i, "".join(r.sample(passages, 60))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def written():
        x = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(x.apply(i).totalShuffleWrite() for i in range(x.size()))

    before = written()
    n = registry.minimizer_join(spark, str(tmp_path)).agg({"n": "sum"}).first()[0]
    assert n > 2_000_000 and written() - before < 25_000_000 and 15 * n > 25_000_000
    before = written()
    assert registry.anchor_chains(spark, str(tmp_path)).count() >= 0
    assert written() - before < 25_000_000
