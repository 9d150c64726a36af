"""The transitive reduction of one large component is dealt over tasks and gives what one task with all of it gives."""

import random

from pyspark.sql import functions as F
from strandloom.operators import grouped as K


def test_ring_is_reduced_in_clusters(spark, monkeypatch):
    n, r = 60, random.Random(2)
    edges = [(2 * i, 2 * i + 1, True, 5000, 0, 0) for i in range(n)]
    reads = []
    for i in range(n):
        a, b, c = i, (i + 1) % n, (i + 2) % n
        short, skip = tuple(sorted((2 * a + 1, 2 * b))), tuple(sorted((2 * a + 1, 2 * c)))
        edges += [(*short, False, 500, 10, 10 + i), (*skip, False, 6000, 10, 3)]
        over = [skip, short, (2 * b, 2 * b + 1), tuple(sorted((2 * b + 1, 2 * c)))]
        for x in over if i % 7 else over[:2]:
            reads.append((*x, 100 + i, r.randint(3, 9)))
    # Every fifth of these three contigs long edges can only take another asked edge.
    for i in range(0, n, 5):
        a, b, c, d = (2 * ((i + k) % n) for k in range(4))
        far = tuple(sorted((a + 1, d)))
        edges.append((*far, False, 11500, 20, 5))
        for x in (far, tuple(sorted((a + 1, c))), (c, c + 1), tuple(sorted((c + 1, d)))):
            reads.append((*x, 1000 + i, 4))
    e = spark.createDataFrame(edges, "source long, target long, dummy boolean, bd long, bd_std long, bw long").cache()
    bcc = e.select("source", "target", F.lit("x").alias("bcc"))
    rd = spark.createDataFrame(reads, "source long, target long, read_id long, hits long").cache()
    wanted = e.filter("bd >= 2000 AND NOT dummy").select("source", "target")
    blocked = spark.createDataFrame([(7,), (40,)], "node long")
    want = sorted(map(tuple, K._reduced_whole(e, bcc, rd, blocked, wanted, K.DEFAULT).collect())) if hasattr(K, "_reduced_whole") else None
    sizes, spread = [], K.spread

    def counted(rows, *keys):
        sizes.append(rows.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return spread(rows, *keys)

    monkeypatch.setattr(K, "spread", counted)
    got = sorted(map(tuple, K.transitive_reduction(e, bcc, rd, blocked, wanted, K.DEFAULT).collect()))
    assert max(sizes) < n // 2
    assert got == want and {x[2] for x in got} == {"reduced", "gained"}
    # With an asked edge that needs no reads the component stays whole.
    few = rd.filter("read_id <> 101")
    want = sorted(map(tuple, K._reduced_whole(e, bcc, few, blocked, wanted, K.DEFAULT).collect()))
    assert sorted(map(tuple, K.transitive_reduction(e, bcc, few, blocked, wanted, K.DEFAULT).collect())) == want
