"""Nothing is lost or cut: dense numbers, matchings of any size, long alignments, circular lines, logs, streams."""

import random

import pytest
from pyspark.sql import functions as F
from strandloom import session
from strandloom.config import DEFAULT
from strandloom.kernels import align, graphs, kmers
from strandloom.operators import graph, grouped, polish, sequences, validate
from strandloom.sources import readers, writers
from strandloom.streaming import support


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_dense_numbers_of_many_wide_rows(spark):
    n = 300_000
    wide = spark.range(n).select(F.xxhash64("id").alias("k"), *[F.repeat(F.md5(F.concat(F.lit(c), "id")), 4).alias(c) for c in "abcd"])
    got, total = readers.numbered(wide.repartition(64, "k").orderBy("k"))
    assert total == n
    s = got.agg(F.count("*"), F.count_distinct("idx"), F.min("idx"), F.max("idx")).first()
    assert tuple(s) == (n, n, 0, n - 1)
    spans = got.select("k", (F.col("idx") / 5000).cast("int").alias("b")).groupBy("b").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("b").collect()
    assert all(a.hi < b.lo for a, b in zip(spans, spans[1:]))
    assert readers.dense_index(wide.limit(0).orderBy("k")).isEmpty()


def test_shared_folder_is_needed_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())
    t = session.settled(spark.range(3), "three")
    path = t.__dict__["settled_at"].removeprefix("file://")
    session.dropped(t, None)
    import os

    assert not os.path.exists(path)


def optimal(edges, picked):
    """Whether a matching has maximum weight: its duals are found again by the solver's own invariants."""
    g = graphs._Matcher(1 + max(max(e[:2]) for e in edges), edges)
    for v in range(g.n):
        g.add(v)
    around = lambda v: around(g.up[v]) + [v] if g.up[v] >= 0 else [v]
    for u, v, w in edges:
        z = sum(g.z[b] for b in set(around(u)) & set(around(v)) if b >= g.n)
        assert g.y[u] + g.y[v] + z >= 2 * w
        assert g.mate[u] != v or g.y[u] + g.y[v] + z == 2 * w
    # The duals' sum is the bound that no matching exceeds; a blossom of s vertices counts (s - 1) / 2 times.
    assert all(g.mate[v] >= 0 or g.y[v] == 0 for v in range(g.n))
    bound = sum(g.y) + sum(g.z[b] * (len(g.leaves(b)) // 2) for b in range(g.n, len(g.z)) if g.kids[b])
    return 2 * sum(edges[i][2] for i in picked) == bound


@pytest.mark.parametrize("n,degree,most", [(400, 4, 30), (1000, 6, 3), (3000, 3, 100), (2001, 2, 1)])
def test_large_matchings_are_exact(n, degree, most):
    rng = random.Random(n)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(n * degree // 2)}
    edges = [(u, v, rng.randint(1, most)) for u, v in sorted(pairs)]
    picked = graphs.max_weight_matching(edges)
    ends = [x for i in picked for x in edges[i][:2]]
    assert len(ends) == len(set(ends)) and optimal(edges, picked)


def test_heavy_edges_keep_the_weight(spark):
    rng = random.Random(4)
    pairs = {tuple(sorted(rng.sample(range(900), 2))) for _ in range(1500)}
    edges = [(u, v, rng.randint(1, 40)) for u, v in sorted(pairs)]
    got = grouped.max_weight_cover(spark.createDataFrame(edges, "source long, target long, bw long")).collect()
    ends = [x for r in got for x in (r.source, r.target)]
    assert len(ends) == len(set(ends)) and {tuple(r) for r in got} <= set(edges)
    assert sum(r.bw for r in got) == sum(edges[i][2] for i in graphs.max_weight_matching(edges))
    none = spark.createDataFrame([], "source long, target long, bw long")
    assert grouped.max_weight_cover(none).isEmpty()
    totals = grouped.matching_totals(none, none).first()
    assert (totals.candidate_edges, totals.matched_weight, totals.share) == (0, 0, None)


def table_path(query, target):
    """The edit script by the whole cost table."""
    n, m = len(query), len(target)
    cost = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (query[i - 1] != target[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    out, i, j = "", n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (query[i - 1] != target[j - 1]):
            i, j = i - 1, j - 1
            out = ("=" if query[i] == target[j] else "X") + out
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i, out = i - 1, "I" + out
        else:
            j, out = j - 1, "D" + out
    return out


def test_paths_without_the_whole_table():
    rng = random.Random(8)
    for _ in range(120):
        a, b = ("".join(rng.choice("ACG") for _ in range(rng.randint(0, 40))) for _ in "ab")
        assert align.path(a, b) == table_path(a, b)
    long_ = "".join(rng.choice("ACGT") for _ in range(30_000))
    assert align.path(long_, long_[:15_000] + long_[15_010:]).count("I") == 10


def test_kmers_by_definition(spark):
    code = lambda s: sum("ACTG".index(c) * 4 ** (len(s) - 1 - i) for i, c in enumerate(s))
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rng = random.Random(2)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 4, 17, 90)]
    d = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)] + [(9, None)], "id long, seq string")
    want = [(i, p, code(s[p : p + 5]), min(code(s[p : p + 5]), code(back(s[p : p + 5]))), code(s[p : p + 5]) <= code(back(s[p : p + 5]))) for i, s in enumerate(seqs) for p in range(len(s) - 4)]
    assert rows(sequences.kmer_rows(d, 5)) == sorted(want)
    whole = [tuple(map(list, x)) for x in kmers.minimizers(seqs[3], 7, 3)]
    old, kmers.PART = kmers.PART, 4
    try:
        parts = list(kmers.minimizers(seqs[3], 7, 3))
    finally:
        kmers.PART = old
    assert [sum((list(p[k]) for p in parts), []) for k in range(4)] == list(whole[0])
    assert [tuple(r)[1:] for r in sequences.tiles(d, 40).filter("id = 3").orderBy("tile").collect()] == [(0, seqs[3][:40]), (1, seqs[3][40:80]), (2, seqs[3][80:])]


def test_circular_lines(spark):
    # Nodes 0-1, 2-3, 4-5 are contigs of 1000; mate edges 1-2 and 3-4 of 100; 5-0 of 50 closed the ring and went.
    pos = spark.createDataFrame([(0, i, n, p) for i, (n, p) in enumerate([(0, 0), (1, 1000), (2, 1100), (3, 2100), (4, 2200), (5, 3200)])], "line_id long, idx long, node long, pos long")
    steps = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 1, 2), (0, 4, 4, 5)], "line_id long, idx long, node long, next long")
    closed = validate.circles(steps, spark.createDataFrame([(0, 5, 50), (70, 71, 9)], "source long, target long, bd long"))
    assert rows(closed) == [(0, 50)]
    reduced = spark.createDataFrame([(1, 4, 1160, 10), (3, 2, 2300, 10), (3, 2, 9000, 10), (4, 1, 2050, 5)], "source long, target long, plen long, pvar long")
    sizes = validate.line_sizes(pos)
    inline = validate.reduced_in_line(reduced, pos)
    over = validate.circular_distance(inline, sizes, closed)
    assert {(r.source, r.target, r.around) for r in over.collect()} == {(1, 4, 2050), (3, 2, 2250), (4, 1, 2050)}
    lengths = spark.createDataFrame([(0, 3200, 20)], "line_id long, plen long, pvar long")
    from dataclasses import replace

    config = replace(DEFAULT, mlp=1000)
    got = validate.path_fragments(inline, lengths, config, sizes, closed)
    assert rows(got) == [(0, 1, 4, 1000, 1200), (0, 3, 2, 0, 1100), (0, 3, 2, 2100, 1100), (0, 4, 1, 0, 1000), (0, 4, 1, 2200, 1000)]
    assert rows(validate.path_fragments(inline, lengths, config)) == [(0, 1, 4, 1000, 1200)]
    one = validate.physical_coverage(reduced.filter("plen < 9000"), got, lengths, config).first()
    assert (one.n_tried, one.n_added, one.path_length, one.line_length, one.coverage) == (3, 3, 5510, 3200, 1.721875)


def test_low_intervals_meet_by_bins(spark):
    rng = random.Random(6)
    low = [(1, s, s + rng.randint(0, 90_000)) for s in (rng.randint(0, 900_000) for _ in range(60))]
    frags = [(1, "suspicious", i, i + 1, p, rng.choice([0, 300, 5000, 200_000])) for i, p in enumerate(rng.randint(0, 900_000) for _ in range(60))]
    got = validate.suspicious_overlaps(spark.createDataFrame(low, "line_id long, start long, stop long"), spark.createDataFrame(frags, "line_id long, kind string, u long, v long, pos long, d long"))
    want = [(1, s, e, u, v, p, d) for _, s, e in low for _, _, u, v, p, d in frags if p <= s <= p + d or p <= e <= p + d]
    assert rows(got) == sorted(want) and len(want) > 100


def test_cuts_reach_back_over_parts(spark):
    parts = [(1, 0, "ACGTACGT", 0), (1, 1, None, -3), (1, 2, "TT", 0), (1, 3, None, -4), (1, 4, "G", 0), (2, 0, "AC", 0), (2, 1, None, -9), (2, 2, "GG", 0), (3, 0, "", 0), (3, 1, None, 4), (3, 2, "A", 0)]
    want = {}
    for line, _, seq, over in parts:
        s = want.get(line, "")
        want[line] = s + seq if seq is not None else s[: max(0, len(s) + over)]
    d = spark.createDataFrame([(*p[:2], "x", *p[2:]) for p in parts], "line_id long, idx int, kind string, seq string, overlap int")
    assert dict(writers.scaffold_sequences(d).collect()) == want


def test_gap_log_and_totals(spark):
    g = spark.createDataFrame([(1, 2, 7, "ACGTACG", 3, 90, 91, 80, 81, 0, 1, 20)], ", ".join(grouped.GAP.split(", ")))
    log = writers.gap_log(g, spark.createDataFrame([(1, 2, 5, 2, 9)], "c1 long, c2 long, bd long, bd_std long, bw long"))
    assert log.columns == ["eid", "proper_gap", "low_iden", "overlap", "bd", "bd_std", "cns_cov", "cov_s", "iden_s", "cov_t", "iden_t"]
    assert tuple(log.first()) == (9, 1, 0, 7, 5, 2, 3, 80, 90, 81, 91)
    e = spark.createDataFrame([(400, True, False), (300, False, True), (500, True, True)], "overlap long, graph boolean, sequence boolean")
    assert tuple(polish.sequence_totals(e).first()) == (2, 900, 2, 800)


def test_paths_of_any_depth(spark):
    # A chain of contigs 0-1, 2-3, ... of 100 with mate edges of 10, and an edge from its first to its last contig.
    n = 7
    edges = [(2 * i, 2 * i + 1, True, 100, 0) for i in range(n)] + [(2 * i + 1, 2 * i + 2, False, 10, 1) for i in range(n - 1)]
    long_ = (1, 2 * n - 2, False, 100 * (n - 2) + 10 * (n - 1) + 3, 1)
    e = spark.createDataFrame([*edges, long_], "source long, target long, dummy boolean, bd long, bd_std long")
    asked = e.filter("NOT dummy AND bd > 100").select("source", "target", "bd", "bd_std")
    got = graph.alternating_paths(e, asked).collect()
    assert [(r.path, r.plen, r.pvar) for r in got] == [(list(range(1, 2 * n - 1)), 560, 2)]
    assert graph.alternating_paths(e, asked.withColumn("bd", F.lit(5000).cast("long"))).isEmpty()


def test_coverage_file_and_command_line(spark, tmp_path, monkeypatch):
    (tmp_path / "cov").write_text("ctg1 10.5\nctg2 7\n")
    assert rows(readers.read_coverage(spark, str(tmp_path / "cov"))) == [("ctg1", 10.5), ("ctg2", 7.0)]
    from strandloom import __main__ as cli

    seen = {}
    monkeypatch.setattr(cli, "run", lambda *a: seen.update(a=a))
    monkeypatch.setattr("sys.argv", ["x", "--contigs", "c", "--longreads", "l", "--samlist", "s", "--prefix", "p", "--mlp", "7", "--rcn", "2.5"])
    cli.main()
    assert seen["a"][1:6] == ("c", "l", "s", "p", None) and (seen["a"][6].mlp, seen["a"][6].rcn, seen["a"][6].k) == (7, 2.5, 17)


def test_support_of_a_stream_equals_the_batch(spark, tmp_path):
    schema = "ctgid long, read_id long, w int"
    parts = [[(1, 7, 2), (1, 8, 1)], [(1, 7, 1), (2, 7, 2)], [(2, 9, 1)]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = support.running_support(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("support").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {}
    for c, r, w in sum(parts, []):
        want[c, r] = want.get((c, r), 0) + w
    assert {(r.ctgid, r.read_id): r.hits for r in spark.table("support").collect()} == want
    old, new = (support.running_support(spark.createDataFrame(x, schema)) for x in (parts[0], parts[1] + parts[2]))
    assert {(r.ctgid, r.read_id): r.hits for r in support.merged_support(old, new).collect()} == want


def test_long_links_and_physical_coverage_take_all_inserts_and_paths_from_5000(spark):
    from strandloom.plans import registry

    data = "/root/testdata/sf0.001"
    c = registry._Case(spark, data)
    inserts = c.kept.filter("gap_end - gap_start + 400 >= 5000")
    assert inserts.filter("lib = 1").count() and sum(r.n_links for r in registry.long_links(spark, data).collect()) == inserts.count()
    assert registry.physical_coverage(spark, data).first().n_tried == c.around.filter("plen >= 5000").count() > c.around.filter("plen >= 11500").count()


def test_no_generated_method_is_too_large_for_hotspot(spark):
    from strandloom.plans import registry

    registry._links(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_bundles_by_counts_are_those_of_the_kept_links(spark):
    from strandloom.operators import bundles
    from strandloom.plans import registry

    links = registry._links(spark, "/root/testdata/sf0.01").localCheckpoint()
    want = bundles.bundles(bundles.kept_links(links))
    got = bundles.bundles_of(links)
    assert got.columns == want.columns and got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_rounding_is_half_away_from_zero(spark):
    from strandloom.plans.adapters import _rounded

    xs = [0.5, 1.5, 2.5, -0.5, -2.5, 12.499999999999998, 7.000000000000001, 0.49999999999999994, -0.2, 0.0, 1e15 + 0.5, 3.0]
    d = spark.createDataFrame([(x,) for x in xs], "x double")
    assert all(r.a == r.b for r in d.select(_rounded(F.col("x")).alias("a"), F.round("x").alias("b")).collect())
