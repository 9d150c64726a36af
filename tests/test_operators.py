"""Operators on small hand-worked tables."""

from pyspark.sql import functions as F
from strandloom.functions import dna, morton
from strandloom.operators import bundles, graph, grouped, links, repeats, sequences, validate
from strandloom.sources import readers, writers


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_link_distance_and_nodes(spark):
    contigs = spark.createDataFrame([(0, "a", 5000), (1, "b", 5000)], "ctgid long, name string, length int")
    aln = spark.createDataFrame([(0, 2000, 200, 1, 200, 1800, "a", 4000, True, "b", 300, False), (0, 2000, 200, 1, 200, 1800, "a", 4000, True, "x", 300, False)], "lib int, avg int, std int, read_id long, gap_start int, gap_end int, name1 string, pos1 int, fwd1 boolean, name2 string, pos2 int, fwd2 boolean")
    got = links.links_of(aln, contigs).select("c1", "c2", "dist", "switched").collect()
    assert [tuple(r) for r in got] == [(0, 3, 500, False)]  # the pair with an unknown contig goes


def test_bundle(spark):
    data = [(0, 3, d, 0, 200, 1) for d in (481, 490, 500, 510, 521, 2000)]
    li = spark.createDataFrame(data, "c1 long, c2 long, dist long, lib int, std int, read_id long")
    assert rows(bundles.bundles(bundles.kept_links(li))) == [(0, 3, 500, 89, 5, 6)]
    assert rows(bundles.bundles(bundles.kept_links(li.limit(4)))) == []


def test_top_reads_keeps_one_more(spark):
    s = spark.createDataFrame([(0, 1, r, 30 - r) for r in range(30)], "c1 long, c2 long, read_id long, hits long")
    assert bundles.top_reads(s).count() == 21
    assert rows(bundles.lead_reads(s)) == [(0, 1, 0, 30)]


def test_repeats(spark):
    c = spark.createDataFrame([(i, 100 + i, float(c)) for i, c in enumerate([16, 15, 14, 9, 9, 9, 9, 9, 9, 10])], "ctgid long, length int, coverage double")
    assert [r.ctgid for r in repeats.by_longest(c).filter("repeat").collect()] == [0]
    n = spark.createDataFrame([(0, 37)], "ctgid long, num_reads long")
    assert repeats.by_reads(c.withColumn("length", F.lit(1000)), n).filter("ctgid = 0").first().cov == 7


def test_components_and_lines(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (200, 201)], "source long, target long")
    comp = dict(graph.connected_components(e).collect())
    assert comp[40] == 0 and comp[102] == 100 and comp[201] == 200
    got = rows(graph.lines(e))
    assert [r[2] for r in got if r[0] == 0] == list(range(41)) and [r[2] for r in got if r[0] == 100] == [100, 101, 102] and not [r for r in got if r[0] == 200]


def test_coverage_and_low_intervals(spark):
    f = spark.createDataFrame([(1, 0, 10), (1, 5, 10), (1, 20, 5), (1, 25, 99)], "line_id long, pos long, d long")
    size = spark.createDataFrame([(1, 30)], "line_id long, size long")
    d = validate.depth(f, size)
    assert rows(d) == [(1, 0, 5, 1), (1, 5, 10, 2), (1, 10, 15, 1), (1, 15, 20, 0), (1, 20, 25, 1), (1, 25, 30, 0)]
    bare = spark.createDataFrame([(1, 0, 5, 0), (1, 5, 20, 1), (1, 20, 25, 0), (1, 25, 50, 1), (1, 50, 51, 0), (1, 51, 60, 1)], "line_id long, beg long, end long, depth long")
    assert rows(validate.low_intervals(bare)) == [(1, 0, 4), (1, 20, 24), (1, 50, 50)]


def test_minimizers_by_hand(spark):
    s = spark.createDataFrame([(1, "ACGTACG"), (2, "AC")], "id long, seq string")
    got = sequences.minimizers(s, 3, 2).orderBy("win").collect()
    assert [(r.id, int(r.code, 4), r.pos, r.stop, r.fwd) for r in got] == [(1, 7, 0, 2, True), (1, 33, 2, 4, False)]


def test_strings_and_keys(spark):
    s = spark.createDataFrame([("ACGTN", 1, 2), ("acgR", 3, 5)], "s string, x long, y long")
    got = s.select(dna.revcomp(F.col("s")), morton.pair_key(F.col("x"), F.col("y")), morton.unpaired(morton.pair_key(F.col("x"), F.col("y")))).collect()
    assert [tuple(r)[:2] for r in got] == [("NACGT", 9), ("Ycgt", 39)]
    assert [(r[2].x, r[2].y) for r in got] == [(1, 2), (3, 5)]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "c.fa").write_text(">a one\nACG\nT\n>b\nAC\n\nGG\n>bad\nAC GT\n>c\nTT")
    assert rows(readers.read_fasta(spark, str(tmp_path / "c.fa"))) == [("a", "ACGT"), ("b", "AC"), ("c", "TT")]
    assert [tuple(r) for r in readers.read_contigs(spark, str(tmp_path / "c.fa")).select("ctgid", "name", "header").orderBy("ctgid").collect()] == [(0, "a", 0), (1, "b", 2), (2, "c", 4)]
    (tmp_path / "x.sam").write_text("@HD\n14660869_FG_6000_13100\t0\tc1\t10\t60\t200M\n14660869_FG_6000_13100\t16\tc2\t20\t60\t150M3S\n")
    r = readers.read_sam(spark, str(tmp_path / "x.sam")).first()
    assert (r.contig1, r.pos1, r.len2, r.fwd1, r.fwd2) == ("c1", 10, 150, True, False)
    n = spark.createDataFrame([("14660869_FG_6000_13100",)], "n string").select(readers.read_name(F.col("n")).alias("r")).first().r
    assert (n.read_id, n.gap_start, n.gap_end) == (14660869, 13300, 18900)
    parts = spark.createDataFrame([(1, 0, "CTG", "ACGT", 0), (1, 1, "GAPO", None, -2), (1, 2, "CTG", "GG", 0)], "line_id long, idx int, kind string, seq string, overlap int")
    assert rows(writers.scaffold_sequences(parts)) == [(1, "ACGG")]
    assert [tuple(r)[1:] for r in writers.bed(parts).orderBy("idx").collect()] == [(0, "CTG", 0, 4), (1, "GAPO", 2, 4), (2, "CTG", 2, 4)]
    writers.write_fasta(spark.createDataFrame([("s", "A" * 70)], "name string, seq string"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == [">s", "A" * 60, "A" * 10]


def test_cover_breaks_cycles(spark):
    m = spark.createDataFrame([(1, 2, 7), (0, 3, 9)], "source long, target long, bw long")
    c = spark.createDataFrame([(0, 1), (2, 3)], "source long, target long")
    kept, cut = grouped.acyclic_cover(m, c)
    assert rows(kept) == [(0, 3, 9)] and rows(cut) == [(1, 2, 7)]


def test_greedy_matching_equals_the_kernel(spark):
    import random

    from strandloom.kernels.graphs import greedy_matching

    rng = random.Random(7)
    edges = [(u, v, rng.randint(1, 9)) for u in range(25) for v in range(u + 1, 25) if rng.random() < 0.2]
    got = rows(grouped.greedy_matching(spark.createDataFrame(edges, "source long, target long, bw long")))
    assert got == sorted(edges[i] for i in greedy_matching(edges))


def test_sequence_polish(spark):
    import random

    from strandloom.operators.polish import sequence_polish

    rng = random.Random(9)
    true = "".join(rng.choice("ACGT") for _ in range(1500))
    gap = true[:700] + ("A" if true[700] != "A" else "C") + true[701:]
    edges = spark.createDataFrame([(1, gap, 1), (3, "".join(rng.choice("ACGT") for _ in range(400)), 1)], "id long, seq string, depth int")
    for piece in (true[200:1300], true[200:1300][::-1].translate(str.maketrans("ACGT", "TGCA"))):
        contigs = spark.createDataFrame([(0, piece)], "id long, seq string")
        got = {r.id: r for r in sequence_polish(contigs, edges).collect()}
        assert got[3].n_replaced == 0 and got[1].n_replaced == 1
        assert sum(a != b for a, b in zip(got[1].seq, true)) == 0
