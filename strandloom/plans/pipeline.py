"""The whole run: contigs, long reads and alignment libraries in; AGP, FASTA, BED and the gap log out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, ScaffoldConfig
from ..functions import dna, packed
from ..functions.morton import pair_key
from ..operators import bundles as B
from ..operators import graph as G
from ..operators import grouped as K
from ..operators import links as L
from ..operators import repeats as R
from ..operators import validate as V
from ..operators.polish import sequence_polish
from ..session import dropped, guarded
from ..sources import readers, writers


@dataclass
class Scaffolds:
    """The tables of a run."""

    contigs: DataFrame
    links: DataFrame
    edges: DataFrame
    reduced: DataFrame
    cover: DataFrame
    steps: DataFrame
    circular: DataFrame
    physical: DataFrame
    totals: DataFrame
    validated: DataFrame
    steps_validated: DataFrame
    agp: DataFrame
    agp_validated: DataFrame


def alignments(spark: SparkSession, sam_list: str) -> DataFrame:
    """All libraries of a list, ranked by insert size. The list is a handful of lines, each of which names a file."""
    libs = [r["l"] for r in spark.read.text(sam_list).filter("trim(value) <> ''").select(readers.library_line(F.col("value")).alias("l")).collect()]
    sized = []
    for lib in libs:
        pairs = readers.read_sam(spark, lib["path"])
        avg, std = lib["avg"], lib["std"]
        if avg is None:
            got = readers.insert_size(pairs).first()
            avg, std = got["avg"], got["std"]
        sized.append((avg, lib["path"], std, pairs))
    out = None
    for rank, (avg, _, std, pairs) in enumerate(sorted(sized, key=lambda x: x[:2])):
        one = pairs.select(
            F.lit(rank).alias("lib"), F.lit(avg).alias("avg"), F.lit(std).alias("std"), readers.read_name(F.col("name1")).alias("r"),
            F.col("contig1").alias("name1"), "pos1", "fwd1", F.col("contig2").alias("name2"), "pos2", "fwd2",
        ).select("lib", "avg", "std", "r.read_id", "r.gap_start", "r.gap_end", "name1", "pos1", "fwd1", "name2", "pos2", "fwd2")
        out = one if out is None else out.unionByName(one)
    return out


def scaffold(aln: DataFrame, contigs: DataFrame, config: ScaffoldConfig = DEFAULT, by_coverage: bool = True) -> Scaffolds:
    """From pairs and contigs to the validated lines; contigs have a coverage column, null where unknown."""
    guarded(aln.sparkSession)
    contigs = G.settled(contigs, "contigs")
    aln = G.settled(aln, "alignments")
    ends = L.pair_ends(aln, contigs, config)
    links = G.settled(L.links_of(aln, contigs, config), "links")
    kept = G.settled(B.kept_links(links, config), "links")
    dropped(links)
    support = G.settled(B.edge_read_support(kept), "edge-reads")
    found = G.settled(B.bundles(kept, config), "bundles")
    if by_coverage:
        repeats = R.by_longest(contigs, config)
    else:
        marked = R.by_reads(contigs, L.contig_read_counts(ends), config)
        repeats = marked.select("ctgid", "repeat")
        contigs = G.settled(contigs.drop("coverage").join(marked.select("ctgid", F.col("cov").cast("double").alias("coverage")), "ctgid"), "contigs")
    nodes = G.settled(G.nodes(contigs, repeats, config), "nodes")
    edges = G.settled(G.edges(contigs, found), "edges")
    ends2 = G.settled(G.endpoints(edges, nodes), "endpoints")

    # Transitive reduction, each biconnected component on its own.
    length = contigs.select(F.col("header").alias("source"), F.col("length").cast("long").alias("len"))
    sized = edges.join(length, "source", "left").select("source", "target", "dummy", F.when(F.col("dummy"), F.col("len")).otherwise(F.col("bd")).alias("bd"), "bd_std", "bw")
    reads = support.select(F.col("c1").alias("source"), F.col("c2").alias("target"), "read_id", "hits").unionByName(
        L.contig_read_support(ends).select((2 * F.col("ctgid")).alias("source"), (2 * F.col("ctgid") + 1).alias("target"), "read_id", "hits")
    )
    bcc = G.settled(K.biconnected_components(edges), "bcc")
    blocked = nodes.filter("repeat OR short").select(F.col("node_id").alias("node"))
    change = G.settled(K.transitive_reduction(sized, bcc, reads, blocked, G.reducible(ends2, config).select("source", "target"), config), "reduction")
    reduced = change.filter("kind = 'reduced'").select("source", "target", "plen", "pvar")
    gained = change.filter("kind = 'gained'").select("source", "target", "weight")
    live = ends2.join(reduced.select("source", "target"), ["source", "target"], "left_anti").join(gained, ["source", "target"], "left").withColumn("bw", F.coalesce("weight", "bw")).drop("weight")
    live = G.settled(live, "live")

    # Matching cover without cycles.
    candidates = G.settled(G.matching_candidates(live, contigs, config).select("source", "target", "bw"), "candidates")
    matched = G.settled(K.max_weight_cover(candidates), "matched")
    acyclic, cut = K.acyclic_cover(matched, G.contig_edges(contigs))
    cut = cut.join(live.select("source", "target", "bd"), ["source", "target"])
    cover = G.settled(acyclic.join(live.select("source", "target", "bd", "bd_std"), ["source", "target"]).select(F.col("source").alias("c1"), F.col("target").alias("c2"), "bd", "bd_std", "bw"), "cover")

    def stepped(mates):
        both = contigs.select(F.col("header").alias("source"), F.col("tail").alias("target")).unionByName(mates.select(F.col("c1").alias("source"), F.col("c2").alias("target")))
        return G.settled(V.steps(G.settled(G.lines(both), "lines"), contigs, mates), "steps")

    steps = stepped(cover)
    pos = V.positions(steps)
    frags = G.settled(V.fragments(steps, pos, B.long_links(kept, config.mlp)), "fragments")
    closed = G.settled(V.circles(steps, cut), "circular")
    paths = G.settled(V.path_fragments(V.reduced_in_line(reduced, pos), V.path_length(steps), config, V.line_sizes(pos), closed), "path-fragments")
    covering = frags.filter("kind <> 'suspicious'").select("line_id", "pos", "d").unionByName(paths.select("line_id", "pos", "d"))
    low = V.low_intervals(V.depth(covering, V.line_sizes(pos)), config)
    checked = G.settled(V.validated(cover, V.suspicious_overlaps(low, frags), support, config), "validated")
    again = stepped(checked)
    physical, totals = V.physical_coverage(reduced, paths, V.path_length(steps), config), K.matching_totals(candidates, matched)
    return Scaffolds(contigs, kept, live, reduced, cover, steps, closed, physical, totals, checked, again, V.agp(steps, contigs, config), V.agp(again, contigs, config))


def gap_members(s: Scaffolds, reads: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """(c1, c2, rank, seq): the read parts of each validated edge, the lead first; all in the edge's stored direction."""
    kept = s.links.join(s.validated.select("c1", "c2"), ["c1", "c2"], "left_semi")
    top = B.top_reads(B.edge_read_support(kept), config.consensus_reads)
    # Reads go through the shuffle at two bits a base, and only the bytes of the part are unpacked.
    bits = reads.select("read_id", packed.pack(F.col("seq")).alias("p"))
    m = B.consensus_links(kept, top, config.consensus_reads).join(bits, "read_id")
    n, a, b = F.col("p.n"), F.col("gap_start"), F.col("gap_end")
    lead = F.col("rank") == 1
    begin = F.when(lead & (a - 1000 > 0), a - 1000).otherwise(a)
    end = F.when(lead & (b + 1000 < n), b + 1000).otherwise(b)
    part = packed.substring(F.col("p"), begin, end - F.greatest(begin, F.lit(0)))
    cut = m.select("c1", "c2", "rank", "switched", packed.unpacked(part).alias("part"))
    return cut.select("c1", "c2", "rank", F.when(F.col("switched"), dna.revcomp(F.col("part"))).otherwise(F.col("part")).alias("seq"))


def contig_ends(s: Scaffolds, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """(c1, c2, left, right, bd, bd_std): the bases at both sides of each validated edge."""
    # Only both ends of a contig travel, packed.
    k, p = F.lit(config.end_bases), F.col("p")
    c = s.contigs.select("ctgid", "length", packed.pack(F.col("seq")).alias("p"))
    c = c.select("ctgid", "length", packed.substring(p, F.lit(0), k).alias("head"), packed.substring(p, p["n"] - k, k).alias("tail"))
    one = c.select(F.col("ctgid").alias("i1"), F.col("head").alias("h1"), F.col("tail").alias("t1"), F.col("length").alias("l1"))
    two = c.select(F.col("ctgid").alias("i2"), F.col("head").alias("h2"), F.col("tail").alias("t2"), F.col("length").alias("l2"))
    e = s.validated.withColumns({"i1": F.shiftright("c1", 1), "i2": F.shiftright("c2", 1)}).join(one, "i1").join(two, "i2")
    e = e.select(*s.validated.columns, "l1", "l2", *[packed.unpacked(F.col(x)).alias(x) for x in ("h1", "t1", "h2", "t2")])
    k = F.least(k, "l1", "l2")
    left = F.when(F.col("c1") % 2 == 0, F.right("t1", k)).otherwise(dna.revcomp(F.left("h1", k)))
    right = F.when(F.col("c2") % 2 == 1, F.left("h2", k)).otherwise(dna.revcomp(F.right("t2", k)))
    return e.select("c1", "c2", left.alias("left"), right.alias("right"), "bd", "bd_std")


def polished_gaps(s: Scaffolds, gaps: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """gaps with gap_seq and overlap corrected by the contigs of alternative paths."""
    asked = gaps.filter(F.col("overlap") > config.polish_overlap).join(s.validated.select("c1", "c2", "bd", "bd_std"), ["c1", "c2"]).select(F.col("c1").alias("source"), F.col("c2").alias("target"), "bd", "bd_std")
    used = s.steps_validated.filter("is_contig").select(F.explode(F.array("node", "next")).alias("node"))
    length = s.contigs.select(F.col("header").alias("source"), F.col("length").cast("long").alias("len"))
    edges = s.edges.select("source", "target", "dummy", "bd", "bd_std", "bw").join(length, "source", "left").withColumn("bd", F.when(F.col("dummy"), F.col("len")).otherwise(F.col("bd"))).drop("len")
    paths = K.alternative_paths(edges, asked, used, config)
    # The inner contigs of a path in order, each in the direction it is passed.
    at = F.posexplode(F.slice("path", 2, F.size("path") - 2)).alias("i", "node")
    inner = paths.select("source", "target", at).filter("i % 2 = 1").withColumn("ctgid", F.shiftright("node", 1)).join(s.contigs.select("ctgid", "seq"), "ctgid")
    piece = F.when(F.col("node") % 2 == 0, F.col("seq")).otherwise(dna.revcomp(F.col("seq")))
    pieces = inner.groupBy("source", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", piece.alias("p")))), lambda x: x["p"]).alias("pieces"))
    work = gaps.join(pieces, (F.col("c1") == F.col("source")) & (F.col("c2") == F.col("target"))).select(pair_key(F.col("c1"), F.col("c2")).alias("id"), F.col("gap_seq").alias("gap"), F.col("avg_cns").alias("depth"), "pieces")
    done = K.graph_polish(work).select("id", F.col("seq").alias("__seq"))
    out = gaps.join(done, pair_key(F.col("c1"), F.col("c2")) == F.col("id"), "left")
    return out.withColumns({"gap_seq": F.coalesce("__seq", "gap_seq"), "overlap": F.when(F.col("__seq").isNotNull(), F.length("__seq")).otherwise(F.col("overlap"))}).drop("id", "__seq")


def minimizer_polished(s: Scaffolds, gaps: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """gaps with gap_seq corrected by contigs that no mate edge of the validated graph touches."""
    used = s.validated.select(F.explode(F.array(F.shiftright("c1", 1), F.shiftright("c2", 1))).alias("ctgid"))
    free = s.contigs.join(used, "ctgid", "left_anti").select(F.col("ctgid").alias("id"), "seq")
    keyed = gaps.withColumn("id", pair_key(F.col("c1"), F.col("c2")))
    edges = keyed.filter(F.col("overlap") >= config.polish_overlap).select("id", F.col("gap_seq").alias("seq"), F.col("avg_cns").alias("depth"))
    done = sequence_polish(free, edges, config).filter("n_replaced > 0").select("id", F.col("seq").alias("__seq"))
    out = keyed.join(done, "id", "left")
    return out.withColumns({"gap_seq": F.coalesce("__seq", "gap_seq"), "overlap": F.when(F.col("__seq").isNotNull(), F.length("__seq")).otherwise(F.col("overlap"))}).drop("id", "__seq")


def parts(s: Scaffolds, gaps: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """(line_id, idx, kind, seq, overlap) of every scaffold, single contigs of `singleton` bases or more among them."""
    g = gaps.select(F.col("c1").alias("u"), F.col("c2").alias("v"), "gap_seq", "overlap")
    st = s.steps_validated.join(s.contigs.select("ctgid", "seq"), "ctgid", "left").join(g, ["u", "v"], "left")
    ctg = F.when(F.col("plus"), F.col("seq")).otherwise(dna.revcomp(F.col("seq")))
    gap = F.when(F.col("node") == F.col("u"), F.col("gap_seq")).otherwise(dna.revcomp(F.col("gap_seq")))
    has = F.coalesce(F.col("overlap"), F.lit(0)) > 0
    lined = st.select(
        "line_id", "idx", F.when(F.col("is_contig"), "CTG").when(has, "GAPS").otherwise("GAPO").alias("kind"),
        F.when(F.col("is_contig"), ctg).when(has, gap).alias("seq"), F.when(F.col("is_contig"), 0).otherwise(F.coalesce("overlap", F.lit(0))).cast("int").alias("overlap"),
    )
    alone = s.contigs.filter(F.col("length") >= config.singleton).join(s.steps_validated.filter("is_contig").select("ctgid"), "ctgid", "left_anti")
    return lined.unionByName(alone.select(F.col("header").alias("line_id"), F.lit(0).cast("long").alias("idx"), F.lit("CTG").alias("kind"), "seq", F.lit(0).alias("overlap")))


def run(spark: SparkSession, contigs: str, longreads: str, samlist: str, prefix: str, coverage: str | None = None, config: ScaffoldConfig = DEFAULT) -> Scaffolds:
    """Writes prefix.raw.agp, .val.agp, .gaps, .fa and .bed (folders of text files) and returns the tables."""
    guarded(spark)
    c = readers.read_contigs(spark, contigs)
    if coverage:
        c = c.join(readers.read_coverage(spark, coverage), "name", "left")
    else:
        c = c.withColumn("coverage", F.lit(None).cast("double"))
    s = scaffold(alignments(spark, samlist), c, config, by_coverage=coverage is not None)
    order = ["scf", "part"]
    writers.write_table(s.agp.orderBy(*order), f"{prefix}.raw.agp")
    writers.write_table(s.agp_validated.orderBy(*order), f"{prefix}.val.agp")
    needed = s.links.join(s.validated.select("c1", "c2"), ["c1", "c2"], "left_semi").select("read_id")
    reads = readers.read_long_reads(spark, longreads, needed)
    gaps = G.settled(K.gap_fill(gap_members(s, reads, config), contig_ends(s, config), config), "gaps")
    writers.write_table(writers.gap_log(gaps, s.validated), f"{prefix}.gaps", " ")
    gaps = G.settled(polished_gaps(s, gaps, config), "polished")
    gaps = G.settled(minimizer_polished(s, gaps, config), "polished")
    p = G.settled(parts(s, gaps, config), "parts")
    seqs = writers.scaffold_sequences(p)
    writers.write_fasta(seqs.select(F.concat(F.lit("WSC"), "line_id").alias("name"), "seq"), f"{prefix}.fa", config.fasta_width)
    writers.write_table(writers.bed(p).orderBy("line_id", "idx"), f"{prefix}.bed")
    return s
