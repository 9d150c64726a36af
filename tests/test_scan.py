"""Two-level scans against plain loops, with bins of a few rows and with lines that fill many."""

import random

import pytest
from pyspark.sql import functions as F
from strandloom.operators import scan, validate


@pytest.fixture(params=[2, 7, 65_536])
def bins(request, monkeypatch):
    monkeypatch.setattr(scan, "BIN", request.param)


def test_sums_and_neighbours(spark, bins):
    rng = random.Random(1)
    rows = [(g, k, rng.randint(-5, 9)) for g in (1, 2, 3) for k in sorted(rng.sample(range(200), 40))] + [(4, 0, 5)]
    d = spark.createDataFrame(rows, "g long, k long, v long")
    out = scan.running_sum(d, "g", "k", F.col("v"), "s")
    out = scan.neighbour(scan.neighbour(out, "g", "k", "v", "after", True), "g", "k", "v", "before", False)
    want = []
    for g in (1, 2, 3, 4):
        mine = [r for r in rows if r[0] == g]
        for i, (_, k, v) in enumerate(mine):
            want.append((g, k, v, sum(x[2] for x in mine[: i + 1]), mine[i + 1][2] if i + 1 < len(mine) else None, mine[i - 1][2] if i else None))
    assert sorted(out.select("g", "k", "v", "s", "after", "before").collect()) == sorted(want)
    assert scan.running_sum(d.limit(0), "g", "k", F.col("v"), "s").isEmpty()


def test_shifts(spark):
    d = spark.createDataFrame([(1, i, 10 * i) for i in range(5)] + [(2, 0, 7)], "g long, i long, p long")
    got = {(r.g, r.i): (r.p, r.before, r.after2) for r in scan.shifted(d, "g", "i", "p", {"before": -1, "after2": 2}).collect()}
    assert got == {(1, i): (10 * i, 10 * i - 10 if i else None, 10 * i + 20 if i < 3 else None) for i in range(5)} | {(2, 0): (7, None, None)}


def test_coverage_of_a_giant_line(spark, bins):
    """Depth and low intervals of one long line, base by base."""
    rng = random.Random(7)
    size = 900
    frags = [(1, a, rng.randint(1, 25)) for a in (rng.randrange(size) for _ in range(45))]
    frags += [(1, -3, 10), (1, size - 1, 5), (2, 0, 30)]
    f = spark.createDataFrame(frags, "line_id long, pos long, d long")
    sizes = spark.createDataFrame([(1, size), (2, 30), (3, 12)], "line_id long, size long")
    depths = validate.depth(f, sizes)
    got = sorted(map(tuple, depths.collect()))
    cover = {1: [0] * size, 2: [0] * 30, 3: [0] * 12}
    for line, pos, d in frags:
        if pos >= 0 and pos + d <= len(cover[line]):
            for x in range(pos, pos + d):
                cover[line][x] += 1
    flat = {line: [n for a, b, n in [(a, b, n) for g, a, b, n in got if g == line] for _ in range(a, b)] for line in cover}
    assert flat == cover and all(a[3] != b[3] for a, b in zip(got, got[1:]) if a[0] == b[0])
    want = []
    for line, c in cover.items():
        bare = [i for i, n in enumerate(c) if n < 1]
        runs = []
        for i in bare:
            if runs and i - runs[-1][1] < 10:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        want += [(line, a, b) for a, b in runs]
    assert sorted(map(tuple, validate.low_intervals(depths).collect())) == sorted(want) and len(want) > 5
