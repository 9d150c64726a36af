"""Queries over the driver's tables, one for each operator, with their SQL where SQL can express them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import dna, morton, packed, scoring
from ..operators import anchors
from ..operators import biconnected as N
from ..operators import bundles as B
from ..operators import graph as G
from ..operators import grouped as K
from ..operators import links as L
from ..operators import polish as P
from ..operators import repeats as R
from ..operators import sequences as S
from ..operators import supported as U
from ..operators import validate as V
from ..session import shared_folder
from ..sources import read_store, readers, writers
from . import adapters as A

#: The adapter's distances are below the default of mlp.
CONFIG = replace(DEFAULT, mlp=11_500)
#: Of long_links and physical_coverage: all inserts and paths from this length on.
LONG = replace(DEFAULT, mlp=5000)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

VIEWS: dict[str, str] = {
    **A.VIEWS, **L.VIEWS, **B.VIEWS,
    "nodes": """SELECT unnest([header, tail]) AS node_id, ctgid, unnest([true, false]) AS is_head, length AS ctg_len, length < 2000 AS short, repeat
        FROM contigs JOIN astat USING (ctgid)""",
    "astat": """SELECT ctgid, coverage > 1.5*(SELECT avg(coverage) FROM (SELECT coverage FROM contigs ORDER BY length DESC, ctgid LIMIT (SELECT CAST(floor(0.1*count(*)) AS BIGINT) FROM contigs))) AS repeat FROM contigs""",
    "edges": """SELECT header AS source, tail AS target, true AS dummy, 0 AS bd, 0 AS bd_std, 0 AS bw, 0 AS rw FROM contigs
        UNION ALL SELECT c1, c2, false, bd, bd_std, bw, rw FROM bundles""",
    "endpoints": """SELECT e.*, s.ctgid AS s_ctgid, s.repeat AS s_repeat, s.short AS s_short, s.ctg_len AS s_ctg_len,
        t.ctgid AS t_ctgid, t.repeat AS t_repeat, t.short AS t_short, t.ctg_len AS t_ctg_len
        FROM edges e JOIN nodes s ON source = s.node_id JOIN nodes t ON target = t.node_id""",
    "cover": "SELECT * FROM bundles WHERE abs(c1//2 - c2//2) = 1 AND least(c1//2, c2//2) % 25 <> 24",
    "cover_edges": "SELECT header AS u, tail AS v FROM contigs UNION ALL SELECT c1, c2 FROM cover",
    "lines": """SELECT 2*(ctgid - ctgid % 25) AS line_id, 2*(ctgid % 25) AS idx, CASE WHEN flip THEN header ELSE tail END AS node FROM contigs
        UNION ALL SELECT 2*(ctgid - ctgid % 25), 2*(ctgid % 25) + 1, CASE WHEN flip THEN tail ELSE header END FROM contigs""",
    "steps": """SELECT a.line_id, a.idx, a.node, b.node AS next, a.node//2 = b.node//2 AS is_contig, a.node//2 AS ctgid, name, length, b.node % 2 = 0 AS plus,
        CAST(CASE WHEN a.node//2 = b.node//2 THEN length ELSE bd END AS BIGINT) AS d, CASE WHEN a.node//2 <> b.node//2 THEN bd_std END AS bd_std,
        least(a.node, b.node) AS u, greatest(a.node, b.node) AS v
        FROM lines a JOIN lines b ON a.line_id = b.line_id AND b.idx = a.idx + 1 JOIN contigs ON ctgid = a.node//2
        LEFT JOIN cover ON c1 = least(a.node, b.node) AND c2 = greatest(a.node, b.node)""",
    "pos": """SELECT line_id, idx + 1 AS idx, next AS node, sum(d) OVER (PARTITION BY line_id ORDER BY idx) AS pos FROM steps
        UNION ALL SELECT line_id, 0, node, 0 FROM steps WHERE idx = 0""",
    "sizes": "SELECT line_id, arg_max(pos, idx) AS size FROM pos GROUP BY line_id",
    "plens": """SELECT line_id, sum(d) AS plen, sum(CASE WHEN is_contig THEN d ELSE 0 END) AS clen, CAST(trunc(sqrt(sum(coalesce(bd_std*bd_std, 0)))) AS BIGINT) AS pvar
        FROM steps GROUP BY line_id""",
    "far": "SELECT c1, c2, count(*) AS n_links, count(DISTINCT read_id) AS n_reads FROM kept WHERE gap_end - gap_start + 400 >= 11500 GROUP BY c1, c2",
    "frag0": """SELECT s.*, p.pos AS at0, lag(p.pos) OVER w AS pre, lead(p.pos, 1, e.size) OVER w AS nxt, lead(p.pos, 2) OVER (PARTITION BY s.line_id ORDER BY s.idx) AS nx2x, e.size
        FROM steps s JOIN pos p USING (line_id, idx) JOIN sizes e USING (line_id) WINDOW w AS (PARTITION BY s.line_id ORDER BY s.idx)""",
    "frag1": """SELECT f.line_id, f.idx, u, v, size, is_contig, q.pos IS NULL AS last,
        CASE WHEN is_contig AND at0 <= pre THEN pre + CASE WHEN q.pos IS NULL THEN 1 ELSE 0 END ELSE at0 END AS s0,
        CASE WHEN is_contig AND nxt >= q.pos THEN q.pos ELSE nxt END AS e0, x.c1 IS NOT NULL AS is_far
        FROM frag0 f LEFT JOIN pos q ON q.line_id = f.line_id AND q.idx = f.idx + 2 LEFT JOIN far x ON x.c1 = u AND x.c2 = v""",
    "frags": """SELECT line_id, idx, CASE WHEN is_contig THEN 'contig' WHEN is_far THEN 'edge' ELSE 'suspicious' END AS kind, u, v, least(s0, e0) AS pos,
        CASE WHEN (is_contig AND last) OR (NOT is_contig AND is_far) THEN least(abs(s0 - e0), size - least(s0, e0)) ELSE abs(s0 - e0) END AS d
        FROM frag1 WHERE least(s0, e0) >= 0""",
    "reduced": "SELECT c1 AS source, c2 AS target, bd AS plen, bd_std AS pvar FROM bundles WHERE bd >= 2000",
    "inline_": "SELECT a.line_id, source, target, plen, pvar, a.pos AS ps, b.pos AS pt FROM reduced JOIN pos a ON a.node = source JOIN pos b ON b.node = target AND a.line_id = b.line_id",
    "pfrags": """SELECT line_id, source, target, least(ps, pt) AS pos, abs(ps - pt) AS d FROM inline_ JOIN (SELECT line_id, pvar AS lv FROM plens) USING (line_id)
        WHERE plen >= 11500 AND abs(plen - abs(ps - pt)) <= 4*greatest(pvar, lv) AND least(ps, pt) >= 0""",
    "closed_": "SELECT line_id, size, 100 + line_id % 700 AS closing FROM sizes WHERE line_id % 100 = 0",
    "around_": """SELECT * FROM reduced UNION ALL SELECT a.node, b.node, 8000 + a.line_id*37 % 9000, 900 FROM pos a JOIN pos b ON a.line_id = b.line_id AND a.idx = 47 AND b.idx = 2""",
    "cinline": """SELECT a.line_id, source, target, plen, pvar, least(a.pos, b.pos) AS low, greatest(a.pos, b.pos) AS high
        FROM around_ JOIN pos a ON a.node = source JOIN pos b ON b.node = target AND a.line_id = b.line_id""",
    "over_": "SELECT * FROM cinline JOIN closed_ USING (line_id)",
    "cfrags": """SELECT line_id, source, target, low AS pos, high - low AS d FROM cinline JOIN (SELECT line_id, pvar AS lv FROM plens) USING (line_id)
            WHERE plen >= 11500 AND abs(plen - (high - low)) <= 4*greatest(pvar, lv) AND low >= 0
        UNION ALL SELECT line_id, source, target, unnest([0, high]), unnest([low, size - high]) FROM over_ JOIN (SELECT line_id, pvar AS lv FROM plens) USING (line_id)
            WHERE plen >= 11500 AND abs(plen - (high - low)) > 4*greatest(pvar, lv) AND abs(plen - (low + size - high + closing)) <= 4*greatest(pvar, lv) AND high >= 0""",
    "covering": "SELECT line_id, pos, d FROM frags WHERE kind <> 'suspicious' UNION ALL SELECT line_id, pos, d FROM pfrags",
    "turns": """SELECT line_id, at0, sum(w) AS w FROM (
        SELECT line_id, unnest([pos, pos + d]) AS at0, unnest([1, -1]) AS w FROM covering JOIN sizes USING (line_id) WHERE pos >= 0 AND d >= 0 AND pos + d <= size
        UNION ALL SELECT line_id, unnest([0, size]), 0 FROM sizes) GROUP BY line_id, at0""",
    "runs": """SELECT line_id, at0 AS beg, lead(at0) OVER (PARTITION BY line_id ORDER BY at0) AS fin, sum(w) OVER (PARTITION BY line_id ORDER BY at0) AS depth FROM turns""",
    "parts": """SELECT *, sum(n) OVER (PARTITION BY line_id ORDER BY beg) AS part FROM (
        SELECT *, CASE WHEN lag(depth) OVER (PARTITION BY line_id ORDER BY beg) = depth THEN 0 ELSE 1 END AS n FROM runs WHERE fin IS NOT NULL)""",
    "depths": "SELECT line_id, depth, min(beg) AS beg, max(fin) AS fin FROM parts GROUP BY line_id, depth, part",
    "low": """SELECT line_id, min(beg) AS start, max(fin) - 1 AS stop FROM (
        SELECT *, sum(n) OVER (PARTITION BY line_id ORDER BY beg) AS part FROM (
        SELECT *, CASE WHEN beg - (lag(fin) OVER (PARTITION BY line_id ORDER BY beg) - 1) < 10 THEN 0 ELSE 1 END AS n FROM depths WHERE depth < 1)) GROUP BY line_id, part""",
    "ovl": """SELECT low.line_id, low.start, low.stop, u, v, pos, d FROM low JOIN frags f ON f.line_id = low.line_id AND kind = 'suspicious'
        AND (low.start BETWEEN pos AND pos + d OR low.stop BETWEEN pos AND pos + d)""",
    "checked": """SELECT c.* FROM cover c WHERE NOT EXISTS (SELECT 1 FROM ovl o WHERE o.u = c1 AND o.v = c2)
        OR (SELECT count(*) FROM esupport s WHERE s.c1 = c.c1 AND s.c2 = c.c2) >= 30""",
    "p4": """SELECT e.c1 AS u, e.c2 AS v, m1.y AS x, m2.x AS y, e.bd, e.bd_std FROM bundles e
        JOIN twoway m1 ON m1.x = e.c1 JOIN twoway m2 ON m2.y = e.c2 AND m2.x = CASE WHEN m1.y % 2 = 0 THEN m1.y + 1 ELSE m1.y - 1 END
        WHERE m1.y//2 <> e.c2//2 AND m1.y//2 <> e.c1//2""",
    "twoway": "SELECT c1 AS x, c2 AS y FROM bundles UNION ALL SELECT c2, c1 FROM bundles",
    "sam": """SELECT event_id AS idx, user_id || '_FG_' || (1000 + event_id % 5000) || '_' || (event_id % 9000) AS name, 16*(event_id % 2) AS flag,
        'ctg' || (user_id % 10) AS contig, event_id*37 % 4000 AS pos, 50 + event_id % 100 AS len FROM events""",
    "sampairs": """SELECT a.idx // 2 AS pair_id, a.name AS name1, a.contig AS contig1, CAST(a.pos AS INT) AS pos1, CAST(a.len AS INT) AS len1, a.flag = 0 AS fwd1,
        b.name AS name2, b.contig AS contig2, CAST(b.pos AS INT) AS pos2, CAST(b.len AS INT) AS len2, b.flag = 0 AS fwd2
        FROM sam a JOIN sam b ON a.idx % 2 = 0 AND b.idx = a.idx + 1""",
    "kmers5": "SELECT id, pos, substring(seq, CAST(pos + 1 AS INT), 5) AS kmer FROM (SELECT id, seq, unnest(generate_series(0, length(seq) - 5)) AS pos FROM seqs)",
    "canon": "SELECT id, pos, least(translate(kmer, 'ACTG', '0123'), translate(translate(reverse(kmer), 'ACGT', 'TGCA'), 'ACTG', '0123')) AS code, translate(kmer, 'ACTG', '0123') <= translate(translate(reverse(kmer), 'ACGT', 'TGCA'), 'ACTG', '0123') AS fwd FROM kmers5",
    "k17": "SELECT id, pos, substring(seq, CAST(pos + 1 AS INT), 17) AS kmer, (length(seq) - 16)//5 AS nw FROM (SELECT id, seq, unnest(generate_series(0, length(seq) - 17)) AS pos FROM seqs)",
    "c17": "SELECT id, pos, pos//5 AS win, nw, translate(kmer, 'ACTG', '0123') AS f, translate(translate(reverse(kmer), 'ACGT', 'TGCA'), 'ACTG', '0123') AS r FROM k17",
    "mins": "SELECT id, win, arg_min(least(f, r), least(f, r) || lpad(CAST(pos AS VARCHAR), 6, '0')) AS code, arg_min(pos, least(f, r) || lpad(CAST(pos AS VARCHAR), 6, '0')) AS pos, arg_min(f <= r, least(f, r) || lpad(CAST(pos AS VARCHAR), 6, '0')) AS fwd FROM c17 WHERE win < nw GROUP BY id, win",
    "anch": """SELECT q.id AS qid, t.id AS tid, q.pos AS qpos, (t.win + 1)*5 AS tpos, q.fwd <> t.fwd AS rev FROM mins q JOIN mins t ON q.code = t.code AND q.id % 2 = 0 AND t.id % 2 = 1
        WHERE q.code IN (SELECT code FROM mins WHERE id % 2 = 1 GROUP BY code HAVING count(*) <= 1000)""",
    "hits_": "SELECT l_orderkey % 500 AS eid, l_linenumber % 2 AS side, l_partkey % 500 AS start, l_partkey % 500 + 50 + l_suppkey % 50 AS stop FROM lineitem",
}

VIEWS["lfrags"] = VIEWS["cfrags"].replace("11500", "5000")


def with_views(sql: str) -> str:
    """sql behind the views that it uses, in order of use."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"(?:FROM|JOIN)\s+(\w+)", text)):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in needed) + "\n" if needed else "") + sql


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return keep


# ---- inputs shared by queries -------------------------------------------------------------------------------------


def _links(s, d):
    return L.links_of(A.alignments(s, d), A.contigs(s, d))


def _ends(s, d):
    return L.pair_ends(A.alignments(s, d), A.contigs(s, d))


def _kept(s, d):
    """The links are read twice, for their windows and by these."""
    return B.kept_links(G.settled(_links(s, d), "links"))


def _bundles(s, d):
    return B.bundles_of(_links(s, d))


def _nodes(s, d):
    c = A.contigs(s, d)
    return G.nodes(c, R.by_longest(c))


def _edges(s, d):
    return G.edges(A.contigs(s, d), _bundles(s, d))


def _endpoints(s, d):
    return G.endpoints(_edges(s, d), _nodes(s, d))


def _neighbours(bundles):
    """The adapter's neighbours, cut after each 25th contig: lines that SQL can state, too."""
    a, b = F.shiftright("c1", 1), F.shiftright("c2", 1)
    return bundles.filter((F.abs(a - b) == 1) & (F.least(a, b) % 25 != 24))


def _cover_edges(contigs, cover):
    return contigs.select(F.col("header").alias("source"), F.col("tail").alias("target")).unionByName(cover.select(F.col("c1").alias("source"), F.col("c2").alias("target")))


class _Case:
    """Tables that several branches of one query read, each written once."""

    def __init__(self, s, d):
        self.s, self.d = s, d

    @cached_property
    def contigs(self):
        return A.contigs(self.s, self.d)

    @cached_property
    def kept(self):
        return G.settled(_kept(self.s, self.d), "links")

    @cached_property
    def support(self):
        return G.settled(B.edge_read_support(self.kept), "edge-reads")

    @cached_property
    def bundles(self):
        return G.settled(B.bundles(self.kept), "bundles")

    @cached_property
    def edges(self):
        return G.edges(self.contigs, self.bundles)

    @cached_property
    def nodes(self):
        return G.nodes(self.contigs, R.by_longest(self.contigs))

    @cached_property
    def endpoints(self):
        return G.settled(G.endpoints(self.edges, self.nodes), "endpoints")

    @cached_property
    def cover(self):
        return _neighbours(self.bundles)

    @cached_property
    def steps(self):
        lines = G.settled(G.lines(_cover_edges(self.contigs, self.cover)), "lines")
        return G.settled(V.steps(lines, self.contigs, self.cover), "steps")

    @cached_property
    def pos(self):
        return G.settled(V.positions(self.steps), "positions")

    @cached_property
    def sizes(self):
        return V.line_sizes(self.pos)

    @cached_property
    def closed(self):
        """Every second line counts as circular."""
        return self.sizes.filter("line_id % 100 = 0").select("line_id", (100 + F.col("line_id") % 700).alias("closing"))

    @cached_property
    def reduced(self):
        return self.bundles.filter("bd >= 2000").select(F.col("c1").alias("source"), F.col("c2").alias("target"), F.col("bd").alias("plen"), F.col("bd_std").alias("pvar"))

    @cached_property
    def around(self):
        """Reduced edges from near a line's end to near its begin, beside the others."""
        ends = self.pos.join(self.sizes, "line_id").groupBy("line_id").agg(F.max(F.when(F.col("idx") == 47, F.col("node"))).alias("source"), F.max(F.when(F.col("idx") == 2, F.col("node"))).alias("target"))
        made = ends.filter("source IS NOT NULL").select("source", "target", (8000 + F.col("line_id") * 37 % 9000).alias("plen"), F.lit(900).cast("long").alias("pvar"))
        return self.reduced.unionByName(made)

    @cached_property
    def fragments(self):
        return G.settled(V.fragments(self.steps, self.pos, B.long_links(self.kept, CONFIG.mlp)), "fragments")

    @cached_property
    def path_fragments(self):
        return V.path_fragments(V.reduced_in_line(self.reduced, self.pos), V.path_length(self.steps), CONFIG)

    def around_fragments(self, config):
        return V.path_fragments(V.reduced_in_line(self.around, self.pos), V.path_length(self.steps), config, self.sizes, self.closed)

    @cached_property
    def depth(self):
        every = self.fragments.filter("kind <> 'suspicious'").select("line_id", "pos", "d").unionByName(self.path_fragments.select("line_id", "pos", "d"))
        return V.depth(every, self.sizes)


# ---- scans ----------------------------------------------------------------------------------------------------------


@query("""SELECT 'd' || doc_id AS name, length(s) AS length, s AS seq FROM (SELECT doc_id, array_to_string(CASE WHEN list_position(ls, '') > 0 THEN ls[1:list_position(ls, '') - 1] ELSE ls END, '') AS s
    FROM (SELECT doc_id, string_split(regexp_replace(lower(text), '[^a-z\n]', '', 'g'), chr(10)) AS ls FROM documents))""")
def fasta_parse(s, d):
    record = F.concat(F.lit("d"), F.col("doc_id"), F.lit(" made from prose\n"), F.regexp_replace(F.lower("text"), "[^a-z\n]", ""))
    return A.table(s, d, "documents").select(readers.fasta_record(record).alias("r")).select("r.name", F.length("r.seq").alias("length"), "r.seq")


def _sam_lines(s, d):
    e = F.col("event_id")
    name = F.concat_ws("_", "user_id", F.lit("FG"), 1000 + e % 5000, e % 9000)
    line = F.concat_ws("\t", name, 16 * (e % 2), F.concat(F.lit("ctg"), F.col("user_id") % 10), e * 37 % 4000, F.lit(60), F.concat(50 + e % 100, F.lit("M")))
    return A.table(s, d, "events").select(e.alias("idx"), line.alias("line"))


@query("SELECT * FROM sampairs")
def sam_pairs(s, d):
    return readers.sam_pairs(_sam_lines(s, d))


@query("""SELECT idx, CAST(string_split(name, '_')[1] AS BIGINT) AS read_id, 1000 + idx % 5000 AS insert, idx % 9000 AS start, idx % 9000 + 200 AS gap_start, idx % 9000 + 1000 + idx % 5000 - 200 AS gap_end FROM sam""")
def parse_read_name(s, d):
    return _sam_lines(s, d).select("idx", readers.read_name(F.split("line", "\t")[0]).alias("r")).select("idx", "r.*")


def _library_lines(s, d):
    n = F.col("n_nationkey")
    cols = F.when(n % 3 == 0, F.array("n_name")).when(n % 3 == 1, F.array(F.col("n_name"), (n * 517 + 1005).cast("string"))).otherwise(F.array(F.col("n_name"), (n * 517 + 1005).cast("string"), (n * 11 + 50).cast("string")))
    return A.table(s, d, "nation").select(F.array_join(cols, "\t").alias("line"))


@query("""SELECT n_name AS path, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey*517 + 1005 END AS avg, CAST(CASE n_nationkey % 3 WHEN 1 THEN trunc((n_nationkey*517 + 1005)*0.1) WHEN 2 THEN n_nationkey*11 + 50 END AS INT) AS std FROM nation""")
def library_config(s, d):
    return _library_lines(s, d).select(readers.library_line(F.col("line")).alias("l")).select("l.*")


@query("SELECT path, avg, row_number() OVER (ORDER BY avg, path) - 1 AS rank FROM (SELECT n_name AS path, n_nationkey*517 + 1005 AS avg FROM nation WHERE n_nationkey % 3 > 0)")
def library_rank(s, d):
    libs = library_config(s, d).filter("avg IS NOT NULL").select("path", "avg")
    return readers.ranked_libraries(libs)


@query("SELECT CAST(trunc(avg(abs(pos2 - pos1))) AS INT) AS avg, CAST(trunc(trunc(avg(abs(pos2 - pos1)))*0.1) AS INT) AS std FROM (SELECT * FROM sampairs WHERE contig1 = contig2 ORDER BY pair_id LIMIT 10000)")
def insert_size(s, d):
    return readers.insert_size(sam_pairs(s, d))


@query("SELECT flip, round(avg(coverage), 6) AS mean, round(greatest(stddev_samp(coverage), 1.0), 6) AS std FROM contigs GROUP BY flip")
def avg_std(s, d):
    return A.contigs(s, d).groupBy("flip").agg(F.round(F.avg("coverage"), 6).alias("mean"), F.round(F.greatest(F.stddev_samp("coverage"), F.lit(1.0)), 6).alias("std"))


# ---- links ------------------------------------------------------------------------------------------------------------


@query("SELECT lib, o1, o2, count(*) AS n FROM oriented GROUP BY lib, o1, o2")
def link_orientation(s, d):
    return L.oriented(L.located(A.alignments(s, d), A.contigs(s, d))).groupBy("lib", "o1", "o2").agg(F.count("*").alias("n"))


@query("SELECT lib, read_id, ctg1, ctg2, plus1, plus2, dist FROM distanced")
def link_distance(s, d):
    return L.distanced(L.oriented(L.located(A.alignments(s, d), A.contigs(s, d)))).select("lib", "read_id", "ctg1", "ctg2", "plus1", "plus2", "dist")


@query("SELECT lib, read_id, ctg1, ctg2, dist FROM valid")
def valid_links(s, d):
    return L.valid(L.distanced(L.oriented(L.located(A.alignments(s, d), A.contigs(s, d))))).select("lib", "read_id", "ctg1", "ctg2", "dist")


@query("SELECT lib, read_id, c1, c2, p1, p2, dist, switched FROM links")
def canonical_links(s, d):
    return _links(s, d).select("lib", "read_id", "c1", "c2", "p1", "p2", "dist", "switched")


@query("SELECT name1, name2, ctg1, ctg2, len1, len2, count(*) AS n FROM located GROUP BY ALL")
def aln_contig_join(s, d):
    keys = ["name1", "name2", "ctg1", "ctg2", "len1", "len2"]
    return L.located(A.alignments(s, d), A.contigs(s, d)).groupBy(*keys).agg(F.count("*").alias("n"))


@query("SELECT ctgid, sum(w) AS num_reads FROM ends WHERE lib = 0 GROUP BY ctgid")
def contig_read_counts(s, d):
    return L.contig_read_counts(_ends(s, d))


@query("SELECT * FROM csupport")
def contig_read_support(s, d):
    return L.contig_read_support(_ends(s, d))


@query("SELECT * FROM bundles")
def edge_bundles(s, d):
    return _bundles(s, d)


@query("SELECT * FROM esupport")
def edge_read_support(s, d):
    return B.edge_read_support(_kept(s, d))


@query("SELECT c1, c2, count(*) AS n_links, count(DISTINCT read_id) AS n_reads FROM kept WHERE gap_end - gap_start + 400 >= 5000 GROUP BY c1, c2")
def long_links(s, d):
    return B.long_links(_kept(s, d), LONG.mlp)


@query("SELECT ctgid, repeat FROM astat")
def repeat_astat(s, d):
    return R.by_longest(A.contigs(s, d))


@query("""SELECT ctgid, cov, cov > 4.5*(SELECT avg(cov) FROM cov WHERE cov > 0) AS repeat FROM cov""".replace("FROM cov WHERE", "FROM (SELECT coalesce(n, 0)*200//length AS cov FROM contigs LEFT JOIN (SELECT ctgid, sum(w) AS n FROM ends WHERE lib = 0 GROUP BY ctgid) USING (ctgid)) WHERE").replace("AS repeat FROM cov", "AS repeat FROM (SELECT ctgid, coalesce(n, 0)*200//length AS cov FROM contigs LEFT JOIN (SELECT ctgid, sum(w) AS n FROM ends WHERE lib = 0 GROUP BY ctgid) USING (ctgid))"))
def repeat_longread(s, d):
    return R.by_reads(A.contigs(s, d), contig_read_counts(s, d))


@query("""SELECT ctgid, coverage > m + 2.5*sd + 0.5 AS repeat FROM contigs CROSS JOIN (SELECT avg(coverage) AS m, greatest(stddev_samp(coverage), 1.0) AS sd FROM (
    SELECT coverage, row_number() OVER (ORDER BY coverage, ctgid) AS i, count(*) OVER () AS n FROM contigs) WHERE i > floor(0.05*n) AND i <= n - floor(0.05*n))""")
def repeat_trimmed(s, d):
    return R.by_trimmed(A.contigs(s, d))


@query("""SELECT c1, c2, read_id, hits, rank FROM top""")
def top_reads_per_edge(s, d):
    return B.top_reads(edge_read_support(s, d))


@query("""SELECT c1, c2, read_id, rank, hits, x.lib AS lib, x.p1 AS p1, x.p2 AS p2, x.dist AS dist, x.gap_start AS gap_start, x.gap_end AS gap_end, x.switched AS switched FROM top JOIN (
    SELECT c1, c2, read_id, min(struct_pack(lib := lib, p1 := p1, p2 := p2, dist := dist, gap_start := gap_start, gap_end := gap_end, switched := switched)) AS x FROM kept GROUP BY c1, c2, read_id) USING (c1, c2, read_id) WHERE rank <= 20""")
def edge_consensus_links(s, d):
    kept = _kept(s, d)
    return B.consensus_links(kept, B.top_reads(B.edge_read_support(kept)))


@query("SELECT c1, c2, read_id, hits FROM top WHERE rank = 1")
def lead_read(s, d):
    return B.lead_reads(edge_read_support(s, d))


@query("SELECT id AS read_id, length(seq) AS length FROM seqs WHERE id IN (SELECT read_id FROM top)")
def needed_reads(s, d):
    reads = A.sequences(s, d).select(F.col("id").alias("read_id"), F.length("seq").alias("length"))
    return reads.join(top_reads_per_edge(s, d).select("read_id").distinct(), "read_id", "left_semi")


@query("""SELECT c1, c2, read_id, ord AS place, seq FROM top JOIN seqs ON id = read_id
    JOIN (SELECT read_id, row_number() OVER (ORDER BY f) - 1 AS ord FROM (SELECT read_id, min(struct_pack(a := c1, b := c2, r := rank)) AS f FROM top JOIN seqs ON id = read_id GROUP BY read_id)) USING (read_id)
    WHERE rank = 1""")
def read_lookup(s, d):
    """The lead reads from a store of the needed reads in the order of their first use."""
    top = G.settled(top_reads_per_edge(s, d), "top-reads")
    reads = A.sequences(s, d).select(F.col("id").alias("read_id"), "seq")
    first = top.select("read_id", F.struct("c1", "c2", "rank").alias("rank"))
    store = read_store.write_store(reads, first, f"{shared_folder(s)}/read-store-{uuid.uuid4().hex}")
    return store.fetch(top.filter("rank = 1").select("c1", "c2", "read_id")).select("c1", "c2", "read_id", "place", "seq")


@query("SELECT read_id, row_number() OVER (ORDER BY f) - 1 AS ord FROM (SELECT read_id, min(struct_pack(a := c1, b := c2, r := rank)) AS f FROM top GROUP BY read_id)")
def read_order(s, d):
    first = top_reads_per_edge(s, d).groupBy("read_id").agg(F.min(F.struct("c1", "c2", "rank")).alias("f"))
    return readers.dense_index(first.orderBy("f").select("read_id"), "ord")


# ---- graph --------------------------------------------------------------------------------------------------------------


@query("SELECT * FROM nodes")
def graph_nodes(s, d):
    return _nodes(s, d)


@query("SELECT source, target, dummy, bd, bd_std, bw, rw FROM edges")
def graph_edges(s, d):
    return _edges(s, d).drop("edge_key")


@query("SELECT source, target, dummy, s_ctgid, s_ctg_len, t_ctgid, t_ctg_len FROM endpoints")
def edge_endpoints(s, d):
    return _endpoints(s, d).select("source", "target", "dummy", "s_ctgid", "s_ctg_len", "t_ctgid", "t_ctg_len")


@query("SELECT source, target, bw FROM edges WHERE NOT (NOT dummy AND bd >= 2000)")
def live_edges(s, d):
    e = G.settled(_edges(s, d), "edges")
    deleted = e.filter("NOT dummy AND bd >= 2000").select("source", "target")
    return e.join(deleted, ["source", "target"], "left_anti").select("source", "target", "bw")


@query("SELECT source, target, bd FROM endpoints WHERE NOT dummy AND NOT s_repeat AND NOT t_repeat AND NOT s_short AND NOT t_short AND bd >= 2000")
def reducible_edges(s, d):
    return G.reducible(_endpoints(s, d)).select("source", "target", "bd")


@query("""SELECT source, target, bw FROM endpoints JOIN contigs a ON a.ctgid = s_ctgid JOIN contigs b ON b.ctgid = t_ctgid
    WHERE NOT dummy AND bw >= 5 AND least(s_ctg_len, t_ctg_len) >= 2000 AND greatest(a.coverage, b.coverage) <= 1.5*(SELECT avg(coverage) FROM contigs)""")
def matching_candidates(s, d):
    return G.matching_candidates(_endpoints(s, d), A.contigs(s, d)).select("source", "target", "bw")


@query("SELECT ctgid, length FROM contigs WHERE header NOT IN (SELECT unnest([c1, c2]) FROM bundles WHERE bd < 500) AND tail NOT IN (SELECT unnest([c1, c2]) FROM bundles WHERE bd < 500)")
def contigs_not_in_edges(s, d):
    used = _bundles(s, d).filter("bd < 500").select(F.explode(F.array(F.shiftright("c1", 1), F.shiftright("c2", 1))).alias("ctgid"))
    return A.contigs(s, d).join(used, "ctgid", "left_anti").select("ctgid", "length")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(length) AS BIGINT) AS total, min(length) AS least, max(length) AS most FROM contigs WHERE header NOT IN (SELECT unnest([c1, c2]) FROM bundles WHERE bd < 500) AND tail NOT IN (SELECT unnest([c1, c2]) FROM bundles WHERE bd < 500)")
def unused_contig_stats(s, d):
    return contigs_not_in_edges(s, d).agg(F.count("*").alias("n"), F.sum("length").alias("total"), F.min("length").alias("least"), F.max("length").alias("most"))


@query("SELECT node, count(*) AS degree FROM (SELECT unnest([source, target]) AS node FROM edges) GROUP BY node")
def node_degree(s, d):
    return G.degrees(_edges(s, d))


@query("""SELECT node, min(r) AS component FROM reach GROUP BY node""")
def connected_components(s, d):
    return G.connected_components(_cover_edges(A.contigs(s, d), _neighbours(_bundles(s, d))))


SQL["connected_components"] = with_views("SELECT 1 FROM cover_edges").replace("WITH ", "WITH RECURSIVE ", 1).rsplit("\n", 1)[0] + """,
    arcs AS (SELECT u, v FROM cover_edges UNION ALL SELECT v, u FROM cover_edges),
    reach(node, r) AS (SELECT u, u FROM arcs UNION SELECT a.u, x.r FROM arcs a JOIN reach x ON a.v = x.node)
    SELECT node, min(r) AS component FROM reach GROUP BY node"""


@query()
def component_sizes(s, d):
    return connected_components(s, d).groupBy("component").agg(F.count("*").alias("size"))


SQL["component_sizes"] = SQL["connected_components"].replace("SELECT node, min(r) AS component FROM reach GROUP BY node", "SELECT component, count(*) AS size FROM (SELECT node, min(r) AS component FROM reach GROUP BY node) GROUP BY component")


def _both(b):
    return b.select(F.col("c1").alias("x"), F.col("c2").alias("y")).unionByName(b.select(F.col("c2").alias("x"), F.col("c1").alias("y")))


def _paths4(b):
    one = _both(b).select(F.col("x").alias("u"), F.col("y").alias("x"))
    two = _both(b).select(F.col("x").alias("y"), F.col("y").alias("v"))
    near = b.select(F.col("c1").alias("u"), F.col("c2").alias("v"))
    p = near.join(one, "u").withColumn("y", F.col("x").bitwiseXOR(F.lit(1).cast("long"))).join(two, ["y", "v"])
    inner = F.shiftright("x", 1)
    return p.filter((inner != F.shiftright("u", 1)) & (inner != F.shiftright("v", 1))).select("u", "v", "x", "y")


@query("SELECT u, v, x, y FROM p4")
def paths_k(s, d):
    """Alternating four-node paths beside an edge: mate edge, contig, mate edge."""
    return _paths4(_Case(s, d).bundles)


def _sized(c):
    """Edges with the contig's length as the distance of contig edges."""
    length = c.contigs.select(F.col("header").alias("source"), F.col("length").cast("long").alias("len"))
    e = c.endpoints.join(length, "source", "left").select("source", "target", "dummy", F.when(F.col("dummy"), F.col("len")).otherwise(F.col("bd")).alias("bd"), "bd_std", "bw")
    return G.settled(e, "edges")


VIEWS["arcs_"] = """SELECT header AS a, tail AS b, true AS dummy, CAST(length AS BIGINT) AS d, 0 AS sd FROM contigs UNION ALL SELECT tail, header, true, length, 0 FROM contigs
    UNION ALL SELECT c1, c2, false, bd, bd_std FROM bundles UNION ALL SELECT c2, c1, false, bd, bd_std FROM bundles"""
VIEWS["asked_"] = "SELECT c1 AS u, c2 AS v, bd, bd_std FROM bundles WHERE bd >= 2000"


@query()
def paths_within(s, d):
    """All simple alternating paths beside an edge whose length agrees with it, whatever their number of nodes."""
    c = _Case(s, d)
    asked = c.bundles.filter("bd >= 2000").select(F.col("c1").alias("source"), F.col("c2").alias("target"), "bd", "bd_std")
    p = G.alternating_paths(_sized(c), asked, CONFIG)
    return p.select(F.col("source").alias("u"), F.col("target").alias("v"), F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), "plen", "pvar")


SQL["paths_within"] = with_views("SELECT 1 FROM arcs_ JOIN asked_ ON true").replace("WITH ", "WITH RECURSIVE ", 1).rsplit("\n", 1)[0] + """,
    walk(u, v, bd, sd0, last, path, plen, var, dummy) AS (
        SELECT u, v, bd, bd_std, u, [u], CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BOOLEAN) FROM asked_
        UNION ALL
        SELECT u, v, bd, sd0, b, list_append(path, b), plen + d, var + sd*sd, arcs_.dummy FROM walk JOIN arcs_ ON a = last
        WHERE last <> v AND (walk.dummy IS NULL OR walk.dummy <> arcs_.dummy) AND NOT list_contains(path, b) AND len(path) <= 80
        AND NOT (plen > bd AND abs(plen - bd) > 4*greatest(sd0, CAST(floor(sqrt(var)) AS BIGINT))) AND NOT (len(path) = 1 AND b = v AND NOT arcs_.dummy))
    SELECT u, v, array_to_string(path, '-') AS path, plen, CAST(floor(sqrt(var)) AS BIGINT) AS pvar FROM walk
    WHERE last = v AND len(path) >= 4 AND abs(plen - bd) <= 4*greatest(sd0, CAST(floor(sqrt(var)) AS BIGINT))"""


@query("""SELECT p.u, p.v, p.x, p.y, count(r.read_id) AS needed,
    CASE WHEN count(r.read_id) = count(a.read_id) AND count(r.read_id) = count(b.read_id) THEN CASE WHEN count(r.read_id) = count(c.read_id) THEN 3 ELSE 2 END WHEN count(r.read_id) = count(c.read_id) THEN 1 ELSE 0 END AS score
    FROM p4 p LEFT JOIN esupport r ON r.c1 = p.u AND r.c2 = p.v AND r.hits > 2
    LEFT JOIN esupport a ON a.c1 = least(p.u, p.x) AND a.c2 = greatest(p.u, p.x) AND a.read_id = r.read_id
    LEFT JOIN esupport b ON b.c1 = least(p.y, p.v) AND b.c2 = greatest(p.y, p.v) AND b.read_id = r.read_id
    LEFT JOIN csupport c ON c.ctgid = p.x//2 AND c.read_id = r.read_id GROUP BY p.u, p.v, p.x, p.y""")
def path_support(s, d):
    """Relational division: 3 if every needed read is on every edge and contig of the path, 2 edges only, 1 contigs only."""
    c = _Case(s, d)
    # Edges and contigs are elements of a path alike: one list of what each read supports, one join.
    on_edge = c.support.select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), "read_id")
    on_contig = contig_read_support(s, d).select(F.col("ctgid").alias("k1"), F.lit(-1).cast("long").alias("k2"), "read_id")
    held = on_edge.unionByName(on_contig).withColumn("held", F.lit(1))
    r = c.support.filter(F.col("hits") > CONFIG.read_hits).select(F.col("c1").alias("u"), F.col("c2").alias("v"), "read_id")
    part = lambda kind, k1, k2: F.struct(F.lit(kind).alias("kind"), k1.alias("k1"), k2.alias("k2"))
    parts = F.array(
        part("a", F.least("u", "x"), F.greatest("u", "x")), part("b", F.least("y", "v"), F.greatest("y", "v")), part("c", F.shiftright("x", 1), F.lit(-1).cast("long")),
    )
    p = _paths4(c.bundles).join(r, ["u", "v"], "left").select("u", "v", "x", "y", "read_id", F.explode(parts).alias("e")).select("u", "v", "x", "y", "read_id", "e.*")
    got = p.join(held, ["k1", "k2", "read_id"], "left")
    count = lambda kind, col: F.count(F.when(F.col("kind") == kind, F.col(col)))
    n = got.groupBy("u", "v", "x", "y").agg(count("a", "read_id").alias("needed"), *[count(k, "held").alias(k) for k in "abc"])
    edges, contigs = (F.col("a") == F.col("needed")) & (F.col("b") == F.col("needed")), F.col("c") == F.col("needed")
    return n.select("u", "v", "x", "y", "needed", F.when(edges & contigs, 3).when(edges, 2).when(contigs, 1).otherwise(0).alias("score"))


@query()
def supported_paths(s, d):
    """Every path beside an edge whose parts all carry the reads that the edge needs, grown along supported parts only."""
    c = _Case(s, d)
    es = c.support.select(F.col("c1").alias("source"), F.col("c2").alias("target"), "read_id", "hits")
    cs = contig_read_support(s, d).select((2 * F.col("ctgid")).alias("source"), (2 * F.col("ctgid") + 1).alias("target"), "read_id", "hits")
    e = G.settled(_sized(c), "sized")
    asked = e.filter("NOT dummy AND bd >= 2000")
    blocked = c.nodes.filter("repeat").select(F.col("node_id").alias("node"))
    p = U.supported_paths(e, asked, G.settled(es.unionByName(cs), "part-reads"), blocked, CONFIG)
    return p.select(F.col("source").alias("u"), F.col("target").alias("v"), F.array_join("path", "-").alias("path"), "plen", "pvar", "weight")


VIEWS["part_reads_"] = "SELECT c1 AS s, c2 AS t, read_id, hits FROM esupport UNION ALL SELECT 2*ctgid, 2*ctgid + 1, read_id, hits FROM csupport"
SQL["supported_paths"] = with_views("SELECT 1 FROM arcs_ JOIN asked_ ON true JOIN part_reads_ ON true JOIN nodes ON true").replace("WITH ", "WITH RECURSIVE ", 1).rsplit("\n", 1)[0] + """,
    need_ AS (SELECT u, v, bd, bd_std, coalesce((SELECT list(read_id) FROM part_reads_ WHERE s = u AND t = v AND hits > 2), []) AS need FROM asked_),
    carry_ AS (SELECT s, t, list(read_id) AS reads, map(list(read_id), list(hits)) AS of FROM part_reads_ GROUP BY s, t),
    open_ AS (SELECT a, b, dummy, d, sd, coalesce(reads, []) AS reads, of, repeat FROM arcs_ JOIN nodes ON node_id = b LEFT JOIN carry_ ON s = least(a, b) AND t = greatest(a, b)),
    walk(u, v, bd, sd0, need, last, path, plen, var, weight, dummy) AS (
        SELECT u, v, bd, bd_std, need, u, [u], CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BOOLEAN) FROM need_
        UNION ALL
        SELECT u, v, bd, sd0, need, b, list_append(path, b), plen + d, var + sd*sd, weight + CAST(coalesce(list_sum(list_transform(need, lambda r: of[r])), 0) AS BIGINT), open_.dummy
        FROM walk JOIN open_ ON a = last
        WHERE last <> v AND (walk.dummy IS NULL OR walk.dummy <> open_.dummy) AND NOT list_contains(path, b) AND len(path) <= 80 AND (NOT repeat OR b = v) AND list_has_all(reads, need)
        AND NOT (plen > bd AND abs(plen - bd) > 4*greatest(sd0, CAST(floor(sqrt(var)) AS BIGINT))) AND NOT (len(path) = 1 AND b = v AND NOT open_.dummy))
    SELECT u, v, array_to_string(path, '-') AS path, plen, CAST(floor(sqrt(var)) AS BIGINT) AS pvar, weight FROM walk
    WHERE last = v AND len(path) >= 4 AND abs(plen - bd) <= 4*greatest(sd0, CAST(floor(sqrt(var)) AS BIGINT))"""


@query("""SELECT DISTINCT least(a.c1//2, a.c2//2) AS a, greatest(a.c1//2, a.c2//2) AS b, greatest(b.c1//2, b.c2//2) AS c FROM bundles a JOIN bundles b ON greatest(a.c1//2, a.c2//2) = least(b.c1//2, b.c2//2)
    JOIN bundles e ON least(e.c1//2, e.c2//2) = least(a.c1//2, a.c2//2) AND greatest(e.c1//2, e.c2//2) = greatest(b.c1//2, b.c2//2)""")
def triangles(s, d):
    x, y = F.shiftright("c1", 1), F.shiftright("c2", 1)
    p = G.settled(_bundles(s, d).select(F.least(x, y).alias("p"), F.greatest(x, y).alias("q")).distinct(), "pairs")
    ab, bc, ac = p.toDF("a", "b"), p.toDF("b", "c"), p.toDF("a", "c")
    return ab.join(bc, "b").join(ac, ["a", "c"]).select("a", "b", "c")


# ---- lines and validation ----------------------------------------------------------------------------------------------------


@query("SELECT * FROM lines")
def scaffold_lines(s, d):
    return G.lines(_cover_edges(A.contigs(s, d), _neighbours(_bundles(s, d))))


@query("SELECT line_id, idx, node, CAST(pos AS BIGINT) AS pos FROM pos")
def line_positions(s, d):
    return _Case(s, d).pos


@query("SELECT line_id, idx, node, next, is_contig, plus FROM steps")
def line_orientation(s, d):
    return _Case(s, d).steps.select("line_id", "idx", "node", "next", "is_contig", "plus")


@query("SELECT source, target, CAST(abs(ps - pt) AS BIGINT) AS dist FROM inline_")
def line_distance(s, d):
    c = _Case(s, d)
    return V.reduced_in_line(c.reduced, c.pos).select("source", "target", F.abs(F.col("ps") - F.col("pt")).alias("dist"))


@query("SELECT line_id, source, target, plen, pvar, CAST(ps AS BIGINT) AS ps, CAST(pt AS BIGINT) AS pt FROM inline_")
def reduced_in_line(s, d):
    c = _Case(s, d)
    return V.reduced_in_line(c.reduced, c.pos).select("line_id", "source", "target", "plen", "pvar", "ps", "pt")


@query("SELECT line_id, CAST(plen AS BIGINT) AS plen, CAST(clen AS BIGINT) AS clen, pvar FROM plens")
def path_length(s, d):
    return V.path_length(_Case(s, d).steps)


@query("SELECT line_id, row_number() OVER (ORDER BY plen DESC, line_id) - 1 AS ord FROM plens")
def line_order(s, d):
    return readers.dense_index(path_length(s, d).orderBy(F.desc("plen"), "line_id").select("line_id"), "ord")


@query("SELECT line_id, idx, kind, CAST(pos AS BIGINT) AS pos, CAST(d AS BIGINT) AS d FROM frags")
def line_fragments(s, d):
    return _Case(s, d).fragments.select("line_id", "idx", "kind", "pos", "d")


@query("SELECT line_id, source, target, CAST(pos AS BIGINT) AS pos, CAST(d AS BIGINT) AS d FROM pfrags")
def path_fragments(s, d):
    return _Case(s, d).path_fragments


@query('SELECT line_id, CAST(beg AS BIGINT) AS beg, CAST(fin AS BIGINT) AS "end", CAST(depth AS BIGINT) AS depth FROM depths')
def interval_coverage(s, d):
    return _Case(s, d).depth


@query("SELECT line_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM low")
def lqi_intervals(s, d):
    return V.low_intervals(_Case(s, d).depth)


@query("SELECT line_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, u, v FROM ovl")
def lqi_edge_overlap(s, d):
    c = _Case(s, d)
    return V.suspicious_overlaps(V.low_intervals(c.depth), c.fragments).select("line_id", "start", "stop", "u", "v")


@query("SELECT c1, c2, bw FROM checked")
def validated_edges(s, d):
    c = _Case(s, d)
    over = V.suspicious_overlaps(V.low_intervals(c.depth), c.fragments)
    return V.validated(c.cover, over, c.support, replace(CONFIG, nlm=30)).select("c1", "c2", "bw")


@query("SELECT CAST(sum(fin - beg) AS BIGINT) AS examined, CAST(sum(CASE WHEN depth > 0 THEN fin - beg ELSE 0 END) AS BIGINT) AS covered, CAST(max(depth) AS BIGINT) AS most FROM depths")
def validation_stats(s, d):
    n = F.col("end") - F.col("beg")
    return interval_coverage(s, d).agg(F.sum(n).alias("examined"), F.sum(F.when(F.col("depth") > 0, n).otherwise(0)).alias("covered"), F.max("depth").cast("long").alias("most"))


@query("SELECT CAST(count(*) AS BIGINT) AS edges, CAST(sum(bw) AS BIGINT) AS weight, CAST(sum(rw) AS BIGINT) AS raw_weight, CAST(sum(CASE WHEN bd >= 2000 THEN bw ELSE 0 END) AS BIGINT) AS long_weight FROM bundles")
def run_stats(s, d):
    return _bundles(s, d).agg(F.count("*").alias("edges"), F.sum("bw").alias("weight"), F.sum("rw").alias("raw_weight"), F.sum(F.when(F.col("bd") >= 2000, F.col("bw")).otherwise(0)).alias("long_weight"))


@query("SELECT source, target, CAST(low + size - high + closing AS BIGINT) AS dist FROM over_")
def circular_distance(s, d):
    """The distance of reduced edges over the ends of circular lines."""
    c = _Case(s, d)
    return V.circular_distance(V.reduced_in_line(c.around, c.pos), c.sizes, c.closed).select("source", "target", F.col("around").alias("dist"))


@query("SELECT line_id, source, target, CAST(pos AS BIGINT) AS pos, CAST(d AS BIGINT) AS d FROM cfrags")
def circular_fragments(s, d):
    return _Case(s, d).around_fragments(CONFIG)


@query("""SELECT (SELECT count(*) FROM around_ WHERE plen >= 5000) AS n_tried, count(*) AS n_added, CAST(coalesce(sum(plen), 0) AS BIGINT) AS path_length,
    (SELECT CAST(sum(plen) AS BIGINT) FROM plens WHERE plen >= 5000) AS line_length, round(coalesce(sum(plen), 0)/(SELECT sum(plen) FROM plens WHERE plen >= 5000), 9) AS coverage
    FROM around_ WHERE plen >= 5000 AND (source, target) IN (SELECT (source, target) FROM lfrags)""")
def physical_coverage(s, d):
    c = _Case(s, d)
    return V.physical_coverage(c.around, c.around_fragments(LONG), V.path_length(c.steps), LONG)


@query("""SELECT CAST(count(*) FILTER (bd > 300) AS BIGINT) AS graph_edges, CAST(coalesce(sum(bd) FILTER (bd > 300), 0) AS BIGINT) AS graph_bases,
    CAST(count(*) FILTER (bd >= 300 AND bw % 2 = 0) AS BIGINT) AS sequence_edges, CAST(coalesce(sum(bd) FILTER (bd >= 300 AND bw % 2 = 0), 0) AS BIGINT) AS sequence_bases FROM bundles""")
def edge_sequence_totals(s, d):
    """Edges and bases that each polisher may touch."""
    return P.sequence_totals(polishable_edges(s, d))


@query()
def matching_totals(s, d):
    """Candidate and matched edges and weights, and the matched share of the weight."""
    c = _Case(s, d)
    cand = G.matching_candidates(c.endpoints, c.contigs).select("source", "target", "bw")
    return K.matching_totals(cand, G.settled(K.max_weight_cover(cand), "matched"))


@query("""SELECT 'SCF' || line_id AS scf, CAST(beg AS BIGINT) AS beg, CAST(beg + size AS BIGINT) AS "end", idx + 1 AS part, CASE WHEN is_contig THEN 'W' ELSE 'N' END AS type,
    CASE WHEN is_contig THEN name ELSE CAST(size AS VARCHAR) END AS c6, CASE WHEN is_contig THEN '1' ELSE 'scaffold' END AS c7, CASE WHEN is_contig THEN CAST(length AS VARCHAR) ELSE 'yes' END AS c8,
    CASE WHEN is_contig THEN CASE WHEN plus THEN '+' ELSE '-' END ELSE 'paired-end' END AS c9
    FROM (SELECT *, 1 + coalesce(sum(size) OVER (PARTITION BY line_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS beg FROM (SELECT *, CASE WHEN is_contig THEN length ELSE greatest(d, 20) END AS size FROM steps))""")
def agp_rows(s, d):
    c = _Case(s, d)
    return V.agp(c.steps, c.contigs)


# ---- outputs ----------------------------------------------------------------------------------------------------------------


def _parts(s, d):
    i = F.col("id")
    q = A.sequences(s, d).select(F.floor(i / 4).alias("line_id"), (i % 4 * 2).cast("int").alias("k"), i, "seq")
    ctg = q.select("line_id", F.col("k").alias("idx"), F.lit("CTG").alias("kind"), "seq", F.lit(0).alias("overlap"))
    gap = q.filter(i % 4 < 3).select("line_id", (F.col("k") + 1).alias("idx"), F.when(i % 2 == 0, "GAPS").otherwise("GAPO").alias("kind"), F.when(i % 2 == 0, F.left("seq", F.lit(20))).alias("seq"), F.when(i % 2 == 0, 0).otherwise(-F.least(i % 7, F.length("seq"))).cast("int").alias("overlap"))
    return ctg.unionByName(gap)


VIEWS["outp"] = "SELECT id//4 AS line_id, id % 4 AS k, id, CASE WHEN id % 4 < 3 AND id % 2 = 1 THEN substring(seq, 1, length(seq) - least(id % 7, length(seq))) ELSE seq END || CASE WHEN id % 4 < 3 AND id % 2 = 0 THEN substring(seq, 1, 20) ELSE '' END AS s FROM seqs"


@query("SELECT line_id, string_agg(s, '' ORDER BY k) AS seq FROM outp GROUP BY line_id")
def scaffold_seq(s, d):
    return writers.scaffold_sequences(_parts(s, d))


VIEWS["bedp"] = """SELECT id//4 AS line_id, id % 4 * 2 AS idx, 'CTG' AS kind, length(seq) AS n FROM seqs
    UNION ALL SELECT id//4, id % 4 * 2 + 1, CASE WHEN id % 2 = 0 THEN 'GAPS' ELSE 'GAPO' END, CASE WHEN id % 2 = 0 THEN least(20, length(seq)) ELSE -least(id % 7, length(seq)) END FROM seqs WHERE id % 4 < 3"""


@query('SELECT line_id, CAST(idx AS INT) AS idx, kind, CAST(least(b, b + n) AS INT) AS beg, CAST(greatest(b, b + n) AS INT) AS "end" FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY line_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM bedp)')
def scaffold_bed(s, d):
    return writers.bed(_parts(s, d))


@query("SELECT id, regexp_replace(seq, '(.{1,60})', '\\1' || chr(10), 'g') AS fasta FROM seqs")
def fasta_wrap(s, d):
    return A.sequences(s, d).select("id", dna.wrapped(F.col("seq")).alias("fasta"))


# ---- sequence functions ----------------------------------------------------------------------------------------------------------


@query("SELECT id, translate(reverse(seq), 'ACGT', 'TGCA') AS rc FROM seqs")
def revcomp(s, d):
    return A.sequences(s, d).select("id", dna.revcomp(F.col("seq")).alias("rc"))


@query("SELECT doc_id AS id, regexp_replace(translate(upper(regexp_replace(lower(text), '[^a-z]', '', 'g')), 'MRWVHDSYBK', 'AAAAAACCCG'), '[^ACGT]', 'A', 'g') AS seq FROM documents")
def iupac_collapse(s, d):
    return A.table(s, d, "documents").select(F.col("doc_id").alias("id"), dna.collapsed(F.regexp_replace(F.lower("text"), "[^a-z]", "")).alias("seq"))


@query("""SELECT id, n, array_to_string(list_transform(generate_series(0, 2*b - 1), lambda i: substring('0123456789ABCDEF', 4*CAST(substring(g, CAST(2*i + 1 AS INT), 1) AS INT) + CAST(substring(g, CAST(2*i + 2 AS INT), 1) AS INT) + 1, 1)), '') AS bits
    FROM (SELECT id, CAST(length(seq) AS INT) AS n, (length(seq) + 3)//4 AS b, rpad(translate(seq, 'ACTG', '0123'), CAST(4*((length(seq) + 3)//4) AS INT), '0') AS g FROM seqs)""")
def dna_pack(s, d):
    """Two bits a base, four bases a byte."""
    p = A.sequences(s, d).select("id", packed.pack(F.col("seq")).alias("p"))
    return p.select("id", "p.n", F.hex("p.bits").alias("bits"))


@query(f"""SELECT id, seq, translate(reverse(substring(seq, CAST(id % 7 + 1 AS INT), 500)), '{dna.IUPAC}', '{dna.COMPLEMENT}') AS other
    FROM (SELECT doc_id AS id, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') AS seq FROM documents)""")
def dna_unpack(s, d):
    """The strings back, ambiguity codes and case included, and a part of the other strand cut and turned in the packed form."""
    p = A.table(s, d, "documents").select(F.col("doc_id").alias("id"), packed.pack(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")).alias("p"))
    part = packed.reverse_complement(packed.substring(F.col("p"), F.col("id") % 7, F.lit(500)))
    return p.select("id", packed.unpacked(F.col("p")).alias("seq"), packed.unpacked(part).alias("other"))


@query("SELECT translate(kmer, 'ACTG', '0123') AS code, count(*) AS n FROM kmers5 GROUP BY kmer")
def kmers(s, d):
    return S.kmer_rows(A.sequences(s, d), 5).groupBy("plain").agg(F.count("*").alias("n")).select(dna.digits(F.col("plain"), 5).alias("code"), "n")


@query("SELECT code, fwd, count(*) AS n FROM canon GROUP BY code, fwd")
def canonical_kmers(s, d):
    return S.kmer_rows(A.sequences(s, d), 5).groupBy("code", "fwd").agg(F.count("*").alias("n")).withColumn("code", dna.digits(F.col("code"), 5))


@query("SELECT id, win, code, pos, fwd, (win + 1)*5 AS stop FROM mins")
def minimizers(s, d):
    return S.minimizers(A.sequences(s, d))


@query("SELECT times, count(*) AS n FROM (SELECT count(*) AS times FROM mins GROUP BY code) GROUP BY times HAVING times < least(100, (SELECT max(t) FROM (SELECT count(*) AS t FROM mins GROUP BY code)))")
def minimizer_hist(s, d):
    return S.histogram(S.minimizer_codes(A.sequences(s, d)))


def _minimizers(s, d):
    """Of even sequences, and of odd ones: the index."""
    m = G.settled(S.minimizer_codes(A.sequences(s, d)), "minimizers")
    return m.filter("id % 2 = 0"), m.filter("id % 2 = 1")


@query("SELECT qid, tid, rev, count(*) AS n, CAST(sum(qpos) AS BIGINT) AS sq, CAST(sum(tpos) AS BIGINT) AS st FROM anch GROUP BY qid, tid, rev")
def minimizer_join(s, d):
    return anchors.totals(*_minimizers(s, d))


@query("""SELECT qid, tid, CAST(seg AS BIGINT) AS seg, count(*) AS cnt, min(qpos) AS qs, max(qpos) AS qe, min(tpos) AS ts, max(tpos) AS te FROM (
    SELECT *, sum(n) OVER (PARTITION BY qid, tid ORDER BY tpos, qpos) AS seg FROM (
    SELECT *, CASE WHEN tpos - lag(tpos) OVER w > 100 OR abs(qpos - lag(qpos) OVER w) > 100 THEN 1 ELSE 0 END AS n FROM anch WHERE NOT rev WINDOW w AS (PARTITION BY qid, tid ORDER BY tpos, qpos))) GROUP BY qid, tid, seg""")
def chain_segments(s, d):
    return anchors.segments(*_minimizers(s, d), 100)


@query("SELECT id, i AS tile, substring(seq, CAST(i*100 + 1 AS INT), 100) AS part FROM (SELECT id, seq, unnest(generate_series(0, (length(seq) - 1)//100)) AS i FROM seqs WHERE seq <> '')")
def seq_tiles(s, d):
    return S.tiles(A.sequences(s, d), 100)


@query("SELECT id, CASE WHEN id % 3 = 0 THEN translate(reverse(substring(seq, 1, 500)), 'ACGT', 'TGCA') ELSE right(seq, 500) END AS left_end, CASE WHEN id % 3 = 0 THEN translate(reverse(right(seq, 500)), 'ACGT', 'TGCA') ELSE substring(seq, 1, 500) END AS right_end FROM seqs")
def contig_ends(s, d):
    q = F.col("seq")
    back, left, right = F.col("id") % 3 == 0, F.left(q, F.lit(CONFIG.end_bases)), F.right(q, F.lit(CONFIG.end_bases))
    return A.sequences(s, d).select("id", F.when(back, dna.revcomp(left)).otherwise(right).alias("left_end"), F.when(back, dna.revcomp(right)).otherwise(left).alias("right_end"))


@query("""SELECT c1, c2, read_id, CASE WHEN switched THEN translate(reverse(g), 'ACGT', 'TGCA') ELSE g END AS gap
    FROM (SELECT *, substring(seq, CAST(gap_start + 1 AS INT), CAST(greatest(gap_end - gap_start, 0) AS INT)) AS g FROM kept JOIN seqs ON id = read_id)""")
def read_gap_seq(s, d):
    k = _kept(s, d).join(A.sequences(s, d), F.col("read_id") == F.col("id"))
    g = F.substring(F.col("seq"), (F.col("gap_start") + 1).cast("int"), F.greatest(F.col("gap_end") - F.col("gap_start"), F.lit(0)).cast("int"))
    return k.select("c1", "c2", "read_id", F.when(F.col("switched"), dna.revcomp(g)).otherwise(g).alias("gap"))


@query("SELECT l_orderkey % 500 AS s_stop, l_partkey % 500 AS t_start, l_partkey % 500 - l_orderkey % 500 AS dist, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def hit_distance(s, d):
    a, b = F.col("l_orderkey") % 500, F.col("l_partkey") % 500
    x = A.table(s, d, "lineitem").select(a.alias("s_stop"), b.alias("t_start"))
    return x.withColumn("dist", scoring.hit_distance(F.col("s_stop"), F.col("t_start"))).groupBy("s_stop", "t_start", "dist").agg(F.count("*").alias("n"))


@query("""SELECT eid, err, s_start, t_start FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY err, s_start, t_start) AS k FROM (
    SELECT a.eid, abs((b.start - a.stop) - 300) AS err, a.start AS s_start, b.start AS t_start
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY start, stop) AS i FROM hits_ WHERE side = 0) WHERE i <= 6) a
    JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY start, stop) AS i FROM hits_ WHERE side = 1) WHERE i <= 6) b USING (eid))) WHERE k = 1""")
def best_hit_pair(s, d):
    """Of at most six hits at either end of an edge, the pair whose distance is nearest to the expected one."""
    from pyspark.sql import Window

    l = A.table(s, d, "lineitem")  # noqa: E741
    h = l.select((F.col("l_orderkey") % 500).alias("eid"), (F.col("l_linenumber") % 2).alias("side"), (F.col("l_partkey") % 500).alias("start"), (F.col("l_partkey") % 500 + 50 + F.col("l_suppkey") % 50).alias("stop"))
    h = h.withColumn("i", F.row_number().over(Window.partitionBy("eid", "side").orderBy("start", "stop"))).filter("i <= 6")
    a = h.filter("side = 0").select("eid", F.col("start").alias("s_start"), F.col("stop").alias("s_stop"))
    b = h.filter("side = 1").select("eid", F.col("start").alias("t_start"), F.col("stop").alias("t_stop"))
    dist = scoring.hit_distance(F.col("s_stop"), F.col("t_start"))
    best = a.join(b, "eid").groupBy("eid").agg(F.min(F.struct(F.abs(dist - 300).alias("err"), "s_start", "t_start")).alias("x"))
    return best.select("eid", "x.*")


@query("SELECT l_orderkey, l_partkey, CAST(100 - (100*(l_suppkey % 40))//(40 + l_partkey % 60) AS INT) AS identity, CAST(least(100, 100*abs(l_partkey % 90 - 30)//80) AS INT) AS coverage FROM lineitem")
def aln_identity(s, d):
    p = F.col("l_partkey")
    return A.table(s, d, "lineitem").select("l_orderkey", "l_partkey", scoring.identity(F.col("l_suppkey") % 40, 40 + p % 60).cast("int").alias("identity"), scoring.query_coverage(p % 90, F.lit(30), F.lit(80)).alias("coverage"))


@query("""SELECT DISTINCT p_size AS depth, CASE WHEN p_size >= 10 THEN 0.95 WHEN p_size >= 5 THEN 0.90 ELSE 0.80 END::DOUBLE AS graph, CASE WHEN p_size >= 20 THEN 0.985 WHEN p_size >= 15 THEN 0.97 WHEN p_size >= 10 THEN 0.96
    WHEN p_size >= 5 THEN 0.94 WHEN p_size >= 4 THEN 0.93 WHEN p_size >= 3 THEN 0.91 WHEN p_size >= 2 THEN 0.85 ELSE 0.80 END::DOUBLE AS sequence FROM part""")
def identity_ladder(s, d):
    n = F.col("p_size")
    return A.table(s, d, "part").select(n.alias("depth"), scoring.ladder(n, scoring.GRAPH_LADDER).alias("graph"), scoring.ladder(n, scoring.SEQUENCE_LADDER).alias("sequence")).distinct()


@query("SELECT c1, c2, bd AS overlap, bd > 300 AS graph, bd >= 300 AND bw % 2 = 0 AS sequence FROM bundles WHERE bd > 300 OR (bd >= 300 AND bw % 2 = 0)")
def polishable_edges(s, d):
    graph, seq = F.col("bd") > CONFIG.polish_overlap, (F.col("bd") >= CONFIG.polish_overlap) & (F.col("bw") % 2 == 0)
    return _bundles(s, d).filter(graph | seq).select("c1", "c2", F.col("bd").alias("overlap"), graph.alias("graph"), seq.alias("sequence"))


@query("SELECT l_orderkey AS x, l_partkey AS y, CAST(sum(((l_orderkey >> i) & 1) * (1::BIGINT << (2*i)) + ((l_partkey >> i) & 1) * (1::BIGINT << (2*i + 1))) AS BIGINT) AS key FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) CROSS JOIN (SELECT unnest(generate_series(0, 30)) AS i) GROUP BY ALL")
def morton_pair(s, d):
    return A.table(s, d, "lineitem").select(F.col("l_orderkey").alias("x"), F.col("l_partkey").alias("y")).distinct().withColumn("key", morton.pair_key(F.col("x"), F.col("y")))


@query("SELECT event_id*7919 AS key, CAST(sum(((event_id*7919 >> (2*i)) & 1) * (1::BIGINT << i)) AS BIGINT) AS x, CAST(sum(((event_id*7919 >> (2*i + 1)) & 1) * (1::BIGINT << i)) AS BIGINT) AS y FROM events CROSS JOIN (SELECT unnest(generate_series(0, 30)) AS i) GROUP BY event_id")
def morton_unpair(s, d):
    return A.table(s, d, "events").select((F.col("event_id") * 7919).alias("key")).withColumn("p", morton.unpaired(F.col("key"))).select("key", "p.x", "p.y")


@query("SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INT) AS edits FROM part")
def edit_distance(s, d):
    return A.table(s, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("edits"))


# ---- kernels: checked by pytest, by rows only here --------------------------------------------------------------------------------


@query("SELECT u, v, x, y, true AS ok FROM p4")
def path_valid(s, d):
    """Contig and mate edges must alternate along the node list."""
    p = paths_k(s, d).withColumn("path", F.array("u", "x", "y", "v"))
    kinds = F.zip_with(F.slice("path", 1, 3), F.slice("path", 2, 3), lambda a, b: F.shiftright(a, 1) == F.shiftright(b, 1))
    ok = F.forall(F.zip_with(F.slice(kinds, 1, 2), F.slice(kinds, 2, 2), lambda a, b: a != b), lambda x: x)
    return p.select("u", "v", "x", "y", ok.alias("ok"))


@query()
def biconnected_components(s, d):
    """By rounds over all tasks, whatever the size of a component."""
    return N.biconnected_components(G.settled(_edges(s, d), "edges"))


# Edges at a node are in one block if their other ends are connected without that node; blocks are the closure of this.
SQL["biconnected_components"] = with_views("SELECT 1 FROM edges").replace("WITH ", "WITH RECURSIVE ", 1).rsplit("\n", 1)[0] + """,
    arcs AS (SELECT source AS x, target AS y FROM edges UNION SELECT target, source FROM edges),
    reach(v, a, n) AS (SELECT x, y, y FROM arcs UNION SELECT r.v, r.a, arcs.y FROM reach r JOIN arcs ON arcs.x = r.n WHERE arcs.y <> r.v),
    near AS (SELECT least(v, a) AS s, greatest(v, a) AS t, least(v, n) AS s2, greatest(v, n) AS t2 FROM reach JOIN arcs ON arcs.x = v AND arcs.y = n),
    block(s, t, s2, t2) AS (SELECT * FROM near UNION SELECT b.s, b.t, near.s2, near.t2 FROM block b JOIN near ON near.s = b.s2 AND near.t = b.t2),
    name AS (SELECT s, t, min([s2, t2]) AS m FROM block GROUP BY s, t)
    SELECT source, target, m[1] || '-' || m[2] AS bcc FROM edges JOIN name ON s = least(source, target) AND t = greatest(source, target)"""


@query()
def matching_cover(s, d):
    c = _Case(s, d)
    cand = G.matching_candidates(c.endpoints, c.contigs).select("source", "target", "bw")
    matched = G.settled(K.max_weight_cover(cand), "matched")
    kept, _ = K.acyclic_cover(matched, G.contig_edges(c.contigs))
    return kept.select("source", "target", "bw")


@query("""SELECT source, target, bw, true AS covered, true AS optimal FROM endpoints JOIN contigs a ON a.ctgid = s_ctgid JOIN contigs b ON b.ctgid = t_ctgid
    WHERE NOT dummy AND bw >= 5 AND least(s_ctg_len, t_ctg_len) >= 2000 AND greatest(a.coverage, b.coverage) <= 1.5*(SELECT avg(coverage) FROM contigs)""")
def matching_duals(s, d):
    """Every candidate is covered by the duals and these add up to the matching's weight, which proves the matching of matching_cover optimal."""
    c = _Case(s, d)
    cand = G.settled(G.matching_candidates(c.endpoints, c.contigs).select("source", "target", "bw"), "candidates")
    return K.matching_proof(cand, *(G.settled(t, n) for t, n in zip(K.matching_with_duals(cand), ("matched", "duals", "blossoms"))))


@query()
def greedy_matching(s, d):
    cand = G.matching_candidates(_endpoints(s, d), A.contigs(s, d))
    return K.greedy_matching(cand)


@query()
def transitive_reduction(s, d):
    c = _Case(s, d)
    e = _sized(c)
    es = c.support.select(F.col("c1").alias("source"), F.col("c2").alias("target"), "read_id", "hits")
    cs = contig_read_support(s, d).select((2 * F.col("ctgid")).alias("source"), (2 * F.col("ctgid") + 1).alias("target"), "read_id", "hits")
    bcc = G.settled(K.biconnected_components(e), "bcc")
    blocked = c.nodes.filter("repeat OR short").select(F.col("node_id").alias("node"))
    return K.transitive_reduction(e, bcc, es.unionByName(cs), blocked, G.reducible(c.endpoints).select("source", "target"), CONFIG)


@query()
def alternative_paths(s, d):
    c = _Case(s, d)
    e = _sized(c)
    asked = e.filter("NOT dummy AND bd >= 2000").select("source", "target", "bd", "bd_std")
    forbidden = c.contigs.filter("ctgid % 25 >= 20").select(F.explode(F.array("header", "tail")).alias("node"))
    return K.alternative_paths(e, asked, forbidden, CONFIG)


def _sequence_pairs(s, d):
    q = A.sequences(s, d)
    a = q.select("id", F.substring("seq", 21, CONFIG.end_bases).alias("query"))
    b = q.select(F.col("id").alias("tid"), F.col("seq").alias("target"))
    return a.join(b, F.col("tid") == F.col("id") - F.col("id") % 2).select("id", "query", "target")


@query()
def semi_global(s, d):
    return K.semi_global(_sequence_pairs(s, d)).select("id", "edits", "tstart", "tend")


@query()
def aln_windows(s, d):
    return K.aligned_windows(_sequence_pairs(s, d))


def _members(s, d):
    """Noisy copies of a sequence: rank 0 is the lead, the others lack or change some bases."""
    q = A.sequences(s, d)
    r = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("rank")
    noisy = F.when(F.col("rank") == 0, F.col("seq")).when(F.col("rank") == 1, F.regexp_replace("seq", "ACGTA", "ACTA")).when(F.col("rank") == 2, F.regexp_replace("seq", "GGC", "GTC")).otherwise(F.regexp_replace("seq", "TTA", "TA"))
    return q.select("id", "seq", r).select("id", "rank", noisy.alias("seq"))


@query()
def window_consensus(s, d):
    return K.window_consensus(_members(s, d), CONFIG)


def _gap_ends(s, d):
    return A.sequences(s, d).select(F.col("id").alias("c1"), (F.col("id") + 1).alias("c2"), F.substring("seq", 1, 40).alias("left"), F.right("seq", F.lit(40)).alias("right"), (F.length("seq") - 79).cast("long").alias("bd"), F.lit(10).cast("long").alias("bd_std"))


def _gaps(s, d):
    m = _members(s, d).select(F.col("id").alias("c1"), (F.col("id") + 1).alias("c2"), "rank", "seq")
    return K.gap_fill(m, _gap_ends(s, d), CONFIG)


@query()
def gap_fill(s, d):
    return _gaps(s, d)


@query()
def gap_report(s, d):
    """The gap log's columns."""
    return writers.gap_log(_gaps(s, d), _gap_ends(s, d))


@query()
def graph_polish(s, d):
    q = A.sequences(s, d)
    piece = F.regexp_replace(F.substring("seq", 51, 100), "ACG", "AGG")
    return K.graph_polish(q.select("id", F.col("seq").alias("gap"), F.lit(3).alias("depth"), F.array(piece).alias("pieces")))


@query()
def anchor_chains(s, d):
    return anchors.chains(*_minimizers(s, d), CONFIG)


@query()
def lis_length(s, d):
    e = A.table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", (F.col("o_totalprice") * 100).cast("long").alias("v")))), lambda x: x["v"]).alias("values"))
    return K.lis_lengths(e)


@query()
def greedy_cover_hits(s, d):
    return K.greedy_cover(anchor_chains(s, d), CONFIG.novelty)


@query()
def sequence_polish(s, d):
    """Even sequences polish the odd ones that share minimizers with them."""
    q = A.sequences(s, d)
    return P.sequence_polish(q.filter("id % 2 = 0"), q.filter("id % 2 = 1").withColumn("depth", F.lit(1)), CONFIG)
