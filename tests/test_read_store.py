"""The ordered read store: order, lookups, and what these read."""

import random

import pytest
from pyspark.sql import functions as F
from strandloom.sources import read_store


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    rng = random.Random(3)
    seqs = {i * 7 - 50: "".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 60))) for i in range(500)}
    use = [(i, rng.randrange(10_000)) for i in seqs for _ in range(rng.randint(0, 3))] + [(99_999, 1)]
    reads = spark.createDataFrame(list(seqs.items()), "read_id long, seq string").repartition(5)
    store = read_store.write_store(reads, spark.createDataFrame(use, "read_id long, rank long"), str(tmp_path_factory.mktemp("store") / "s"), part=40)
    first = {}
    for i, r in use:
        if i in seqs:
            first[i] = min(r, first.get(i, r))
    return store, seqs, sorted(first, key=lambda i: (first[i], i))


def scanned(df):
    """(files, rows) that the scans of df read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    out = [leaves.apply(i).metrics() for i in range(leaves.size())]
    return sum(m.apply("numFiles").value() for m in out), sum(m.apply("numOutputRows").value() for m in out)


def test_order(case):
    store, seqs, order = case
    rows = sorted((r.place, r.read_id, r.seq) for r in store.between(0, len(order)).collect())
    assert rows == [(p, i, seqs[i]) for p, i in enumerate(order)] and store.parts == -(-len(order) // 40)


def test_lookup_reads_matching_parts_only(case):
    store, seqs, order = case
    some = [order[45], order[47], order[79], order[200]]
    assert sorted((r.place, r.seq) for r in store.lookup([*some, 123_456_789]).collect()) == [(p, seqs[order[p]]) for p in (45, 47, 79, 200)]
    files, rows = scanned(store.at([45, 47, 79, 200]))
    assert files == 2 and rows <= 80
    assert scanned(store.between(85, 110))[0] == 1
    files, _ = scanned(store.places(some))
    assert files <= 4 < store.parts
    assert store.lookup([]).isEmpty() and store.lookup([5]).isEmpty()
    with pytest.raises(ValueError):
        store.places(list(range(read_store.MOST_IDS + 1)))


def test_fetch_by_table(spark, case):
    store, seqs, order = case
    asked = spark.createDataFrame([(i, k) for k, i in enumerate([*order, order[0], 1_000_000])], "read_id long, k long")
    got = sorted((r.k, r.read_id, r.place, r.seq) for r in store.fetch(asked).collect())
    assert got == [(k, i, k, seqs[i]) for k, i in enumerate(order)] + [(len(order), order[0], 0, seqs[order[0]])]
    assert store.fetch(asked.filter(F.col("k") < 0)).isEmpty()
