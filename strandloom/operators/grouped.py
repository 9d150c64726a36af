"""Graph and sequence kernels run for each group on executors.

Groups are connected or biconnected components, edges or sequence pairs. A component goes to one task as a whole, which the
kernels need; what can be decided by the neighbourhood alone is taken off in DataFrames first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ScaffoldConfig
from ..kernels import align, gaps, graphs, paths
from . import biconnected
from .graph import connected_components, dropped, settled
from .supported import supporting_parts

#: Heavy edges are taken off before the matching as long as a round takes at least this share of what is left.
LEAST_SHARE = 0.05
#: Edges of a connected component whose biconnected components one task finds.
KERNEL_EDGES = 200_000


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by their keys over all shuffle partitions: kernels cost time by what they do, not by bytes, so small partitions aren't joined."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def _with_component(edges: DataFrame) -> DataFrame:
    comp = connected_components(edges)
    return edges.join(comp, edges["source"] == comp["node"]).drop("node")


def biconnected_components(edges: DataFrame, most: int = KERNEL_EDGES) -> DataFrame:
    """edges(source, target) -> (source, target, bcc): a component is named by its least edge.

    Connected components of at most `most` edges go to one task each; larger ones are worked out by rounds over all tasks.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["source", "target"]).reset_index(drop=True)
        rows["label"] = graphs.biconnected(list(zip(rows["source"], rows["target"])))
        rows["name"] = rows["source"].astype(str) + "-" + rows["target"].astype(str)
        rows["bcc"] = rows.groupby("label")["name"].transform("first")
        return rows[["source", "target", "bcc"]]

    e = settled(_with_component(edges.select("source", "target")), "component-edges")
    giants = settled(e.groupBy("component").count().filter(F.col("count") > most).select("component"), "giants")
    small = spread(e.join(giants, "component", "left_anti"), "component").groupBy("component").applyInPandas(run, "source long, target long, bcc string")
    if giants.isEmpty():
        return small
    return small.unionByName(biconnected.biconnected_components(e.join(giants, "component", "left_semi").select("source", "target")))


def heavy_edges(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """candidates(source, target, bw) -> (edges that some matching of maximum weight holds, with duals y_source and y_target; what is left without their neighbours).

    An edge that weighs as much as the heaviest other edges at both its ends together can replace these in any matching. Only
    the heaviest edge of both ends, ties by ends, is asked, so the edges of a round don't touch; their neighbours go. A hub is one row after the
    map-side aggregation. The duals are twice the heaviest other edge at the source, and what the weight leaves of it for the target.
    """
    left, taken = settled(candidates.select("source", "target", "bw"), "candidates"), []
    rank = F.struct("bw", "source", "target")
    while True:
        sides = left.select(F.explode(F.array("source", "target")).alias("n"), rank.alias("r"))
        first = sides.groupBy("n").agg(F.max("r").alias("top"))
        ends = settled(sides.join(first, "n").groupBy("n").agg(F.max("top").alias("top"), F.max(F.when(F.col("r") != F.col("top"), F.col("r.bw"))).alias("next")), "ends")
        s, t = (ends.select(F.col("n").alias(c), F.col("top").alias(f"top_{c}"), F.coalesce("next", F.lit(0)).alias(f"next_{c}")) for c in ("source", "target"))
        both = left.join(s, "source").join(t, "target").filter((rank == F.col("top_source")) & (rank == F.col("top_target")))
        won = both.filter("bw >= next_source + next_target")
        won = settled(won.select("source", "target", "bw", (2 * F.col("next_source")).alias("y_source"), (2 * (F.col("bw") - F.col("next_source"))).alias("y_target")), "heavy")
        taken.append(won)
        used = won.select(F.explode(F.array("source", "target")).alias("n"))
        rest = settled(left.join(used, left["source"] == used["n"], "left_anti").join(used, F.col("target") == used["n"], "left_anti"), "candidates")
        n, old = won.count(), left.count()
        dropped(ends, left)
        left = rest
        if not n or n < LEAST_SHARE * old:
            break
    every = taken[0]
    for t in taken[1:]:
        every = every.unionByName(t)
    return every, left


def matching_with_duals(candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """candidates(source, target, bw) -> (a matching of maximum weight, duals(node, y), blossoms(blossom, node, z)): heavy edges by DataFrames, then each component that
    is left by the exact kernel. Nodes without a row have y = 0."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["source", "target"]).reset_index(drop=True)
        edges = list(zip(rows["source"].tolist(), rows["target"].tolist(), rows["bw"].tolist()))
        picked, duals, blossoms = graphs.matching_with_duals(edges)
        out = [("edge", None, *edges[i]) for i in picked] + [("node", None, v, None, y) for v, y in duals.items() if y]
        out += [("blossom", f"{min(duals)}-{i}", v, None, z) for i, (inside, z) in enumerate(blossoms) for v in inside]
        kinds = {"kind": "string", "name": "string", "source": "Int64", "target": "Int64", "value": "Int64"}
        return pd.DataFrame(out, columns=list(kinds)).astype(kinds)

    heavy, left = heavy_edges(candidates)
    heavy_y = heavy.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("y_source").alias("y")), F.struct(F.col("target").alias("node"), F.col("y_target").alias("y")))).alias("x")).select("x.*")
    rest = left.limit(0).select(F.lit("").alias("kind"), F.lit("").alias("name"), "source", "target", F.col("bw").alias("value"))
    if not left.isEmpty():
        rest = settled(spread(_with_component(left), "component").groupBy("component").applyInPandas(run, "kind string, name string, source long, target long, value long"), "matchings")
    matched = heavy.select("source", "target", "bw").unionByName(rest.filter("kind = 'edge'").select("source", "target", F.col("value").alias("bw")))
    duals = heavy_y.unionByName(rest.filter("kind = 'node'").select(F.col("source").alias("node"), F.col("value").alias("y")))
    return matched, duals, rest.filter("kind = 'blossom'").select(F.col("name").alias("blossom"), F.col("source").alias("node"), F.col("value").alias("z"))


def max_weight_cover(candidates: DataFrame) -> DataFrame:
    """candidates(source, target, bw) -> a matching of maximum weight."""
    return matching_with_duals(candidates)[0]


def matching_proof(candidates: DataFrame, matched: DataFrame, duals: DataFrame, blossoms: DataFrame) -> DataFrame:
    """candidates with `covered` and `optimal`, true in every row if and only if the duals prove the matching's weight to be the maximum.

    covered: the duals of both ends and of the blossoms around both come to twice the edge's weight at least. optimal: matched edges are candidates without
    a common node, no dual is negative, and the duals' total (blossoms count for half their nodes but one) is twice the matched weight. By linear programming
    duality no matching can then weigh more.
    """
    e = candidates.select("source", "target", "bw")
    y = lambda side: duals.select(F.col("node").alias(side), F.col("y").alias(f"y_{side}"))
    z = lambda side: blossoms.select("blossom", F.col("node").alias(side), "z")
    around = e.join(z("source"), "source").join(z("target").drop("z"), ["blossom", "target"]).groupBy("source", "target").agg(F.sum("z").alias("around"))
    held = e.join(y("source"), "source", "left").join(y("target"), "target", "left").join(around, ["source", "target"], "left")
    held = held.withColumn("covered", F.coalesce("y_source", F.lit(0)) + F.coalesce("y_target", F.lit(0)) + F.coalesce("around", F.lit(0)) >= 2 * F.col("bw"))
    ends = matched.select(F.explode(F.array("source", "target")).alias("n"))
    parts = [
        matched.join(e, ["source", "target", "bw"], "left_semi").agg(F.coalesce(F.sum("bw"), F.lit(0)).alias("weight"), F.count("*").alias("known")),
        matched.agg(F.count("*").alias("edges")),
        ends.agg(F.count("*").alias("ends"), F.count_distinct("n").alias("nodes")),
        duals.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("sum_y"), F.coalesce(F.min("y"), F.lit(0)).alias("min_y")),
        blossoms.groupBy("blossom").agg(F.max("z").alias("z"), F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("z") * (F.col("n") - 1) / 2), F.lit(0)).cast("long").alias("sum_z"), F.coalesce(F.min("z"), F.lit(0)).alias("min_z")),
    ]
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(p)  # one row each
    optimal = one.select(F.expr("known = edges AND ends = nodes AND min_y >= 0 AND min_z >= 0 AND sum_y + sum_z = 2 * weight").alias("optimal"))
    return held.select("source", "target", "bw", "covered").crossJoin(F.broadcast(optimal))


def matching_totals(candidates: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: candidate and matched edges, their weights, and the matched share of the weight."""
    of = lambda df, name: df.agg(F.count("*").alias(f"{name}_edges"), F.coalesce(F.sum("bw"), F.lit(0)).cast("long").alias(f"{name}_weight"))
    one = of(candidates, "candidate").crossJoin(F.broadcast(of(matched, "matched")))  # one row each
    return one.withColumn("share", F.round(F.col("matched_weight") / F.when(F.col("candidate_weight") > 0, F.col("candidate_weight")), 9))


def greedy_matching(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Locally dominant edges, round by round: the result of taking edges by weight, ties by ends."""
    left, taken = settled(edges.select("source", "target", "bw"), "edges"), None
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        before = left
        rank = F.struct((-F.col("bw")).alias("w"), "source", "target")
        top = left.select(F.explode(F.array("source", "target")).alias("n"), rank.alias("r")).groupBy("n").agg(F.min("r").alias("r"))
        both = left.withColumn("r", rank).join(top.select(F.col("n").alias("source"), F.col("r").alias("rs")), "source").join(top.select(F.col("n").alias("target"), F.col("r").alias("rt")), "target")
        won = settled(both.filter((F.col("r") == F.col("rs")) & (F.col("r") == F.col("rt"))).select("source", "target", "bw"), "matched")
        taken = won if taken is None else taken.unionByName(won)
        used = won.select(F.explode(F.array("source", "target")).alias("n"))
        left = left.join(used, left["source"] == used["n"], "left_anti").join(used, F.col("target") == used["n"], "left_anti")
        old, left = before, settled(left, "edges")
        dropped(old)
    else:
        raise RuntimeError("greedy matching did not settle")
    return taken if taken is not None else edges.select("source", "target", "bw")


def acyclic_cover(matched: DataFrame, contig_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mate edges that stay, circular edges that went): every cycle of contig and matched edges loses its lightest mate edge.

    The line that is left of a cycle is circular: the ends of the edge that went are its two ends. A cover has degree two at most, so a component is a cycle if it has as many edges as nodes.
    """
    m = matched.select("source", "target", "bw", F.lit(False).alias("dummy"))
    every = m.unionByName(contig_edges.select("source", "target", F.lit(0).cast("long").alias("bw"), F.lit(True).alias("dummy")))
    e = settled(_with_component(every), "cover")
    n_nodes = e.select("component", F.explode(F.array("source", "target")).alias("n")).distinct().groupBy("component").agg(F.count("*").alias("nodes"))
    rings = e.groupBy("component").agg(F.count("*").alias("n_edges")).join(n_nodes, "component").filter("n_edges >= nodes").select("component")
    lightest = e.filter("NOT dummy").join(rings, "component").groupBy("component").agg(F.min(F.struct("bw", "source", "target")).alias("x")).select("x.source", "x.target", "x.bw")
    cut = settled(lightest, "cuts")
    return matched.join(cut.select("source", "target"), ["source", "target"], "left_anti"), cut


def transitive_reduction(edges: DataFrame, bcc: DataFrame, reads: DataFrame, blocked: DataFrame, wanted: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """Rows of kind `reduced` (plen, pvar, weight) and `gained` (weight) for the edges that the reduction changes.

    edges(source, target, dummy, bd, bd_std, bw) with contig lengths as bd of contig edges; reads(source, target, read_id, hits), one row an edge and read;
    blocked(node); wanted(source, target).

    An asked edge is searched on the edges of its component that carry all reads it needs, so what one reduction changes for another is between asked edges that are such parts of
    one another: these clusters go to a task each, with their parts alone. Weights that other edges gain are summed. Components with an asked edge that needs no
    reads, and may go anywhere, are searched as a whole.
    """
    key = ["source", "target"]
    part = {"source": "s", "target": "t"}
    asked = settled(wanted.select(*key).distinct().join(bcc.select(*key, "bcc"), key), "asked-edges")
    parts = settled(supporting_parts(asked, reads, config), "parts")
    free = settled(asked.join(parts.select(*key).distinct(), key, "left_anti").select("bcc").distinct(), "free-components")
    parts = parts.join(asked, key).join(bcc.select(*key, F.col("bcc").alias("other")).withColumnsRenamed(part), ["s", "t"]).filter("bcc = other").join(free, "bcc", "left_anti")
    # Equal hashes of two edges would only join their clusters.
    parts = settled(parts.select(*key, "s", "t", "hits", F.xxhash64(*key).alias("a"), F.xxhash64("s", "t").alias("b")), "parts")
    links = parts.join(asked.select(*key).withColumnsRenamed(part), ["s", "t"], "left_semi").filter("a <> b").select(F.col("a").alias("source"), F.col("b").alias("target"))
    links = settled(links.distinct(), "asked-links")
    cluster = connected_components(links) if not links.isEmpty() else links.select(F.col("source").alias("node"), F.col("source").alias("component"))
    rows = parts.join(cluster, F.col("a") == F.col("node"), "left").withColumn("cluster", F.coalesce("component", "a"))
    rows = rows.join(edges.select(*key, "dummy", "bd", "bd_std", "bw").withColumnsRenamed(part), ["s", "t"])
    stop = blocked.select("node", F.lit(True).alias("b")).distinct()
    for k in part.values():
        rows = rows.join(stop.withColumnsRenamed({"node": k, "b": f"block_{k}"}), k, "left")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        es = sorted(set(zip(*(rows[c].tolist() for c in ("s", "t", "dummy", "bd", "bd_std", "bw")))))
        at: dict[tuple[int, int], list[int]] = {}
        for i, e in enumerate(es):
            at.setdefault(e[:2], []).append(i)
        ways: dict[int, dict[int, int]] = {}
        for own, x, h in zip(zip(rows["source"].tolist(), rows["target"].tolist()), zip(rows["s"].tolist(), rows["t"].tolist()), rows["hits"].tolist()):
            for i in at[own]:
                if not es[i][2]:
                    ways.setdefault(i, {}).update(dict.fromkeys(at[x], h))
        no = {n for k in ("s", "t") for n, b in zip(rows[k].tolist(), rows[f"block_{k}"].tolist()) if b == True}  # noqa: E712
        changed, reduced = paths.reduce_supported({i: [x[0], x[1], bool(x[2]), *map(int, x[3:])] for i, x in enumerate(es)}, ways, no, config)
        out = [(*es[i][:2], "reduced", a, b, w) for i, a, b, w in reduced] + [(*es[i][:2], "gained", 0, 0, w - es[i][5]) for i, w in sorted(changed.items())]
        return pd.DataFrame(out, columns=["source", "target", "kind", "plen", "pvar", "weight"])

    cols = ["cluster", *key, "s", "t", "hits", "dummy", "bd", "bd_std", "bw", "block_s", "block_t"]
    found = settled(spread(rows.select(*cols), "cluster").groupBy("cluster").applyInPandas(run, "source long, target long, kind string, plen long, pvar long, weight long"), "reduced")
    gained = found.filter("kind = 'gained'").groupBy(*key).agg(F.sum("weight").alias("gain")).join(edges.select(*key, "bw"), key)
    gained = gained.select(*key, F.lit("gained").alias("kind"), *(F.lit(0).cast("long").alias(c) for c in ("plen", "pvar")), (F.col("bw") + F.col("gain")).cast("long").alias("weight"))
    found = found.filter("kind = 'reduced'").unionByName(gained)
    if free.isEmpty():
        return found
    return found.unionByName(_reduced_whole(edges, bcc.join(free, "bcc", "left_semi"), reads, blocked, wanted, config))


def _reduced_whole(edges: DataFrame, bcc: DataFrame, reads: DataFrame, blocked: DataFrame, wanted: DataFrame, config: ScaffoldConfig) -> DataFrame:
    """transitive_reduction() with each biconnected component in one task."""
    key = ["source", "target"]
    # Only components with an edge that is asked for are searched, so only their reads are gathered.
    asked = bcc.join(wanted.select(*key), key, "left_semi").select("bcc").distinct()
    bcc = settled(bcc.join(asked, "bcc", "left_semi"), "bcc")
    r = reads.join(bcc.select(*key), key, "left_semi").groupBy(*key).agg(F.collect_list("read_id").alias("reads"), F.collect_list("hits").alias("hits"))
    stop = blocked.select("node", F.lit(True).alias("b"))
    e = edges.join(bcc, key).join(r, key, "left").join(wanted.select(*key, F.lit(True).alias("want")), key, "left")
    for k in key:
        e = e.join(stop.withColumnsRenamed({"node": k, "b": f"block_{k}"}), k, "left")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["source", "target"]).reset_index(drop=True)
        es = {i: [x.source, x.target, bool(x.dummy), int(x.bd), int(x.bd_std), int(x.bw)] for i, x in enumerate(rows.itertuples())}
        want = [i for i, x in enumerate(rows["want"]) if x is True or x == True]  # noqa: E712
        got = {i: dict(zip(a, h)) for i, (a, h) in enumerate(zip(rows["reads"], rows["hits"])) if a is not None}
        no = {n for n, b in zip(rows["source"], rows["block_source"]) if b == True} | {n for n, b in zip(rows["target"], rows["block_target"]) if b == True}  # noqa: E712
        changed, reduced = paths.reduce_component(es, want, got, no, config)
        out = [(es[i][0], es[i][1], "reduced", a, b, w) for i, a, b, w in reduced] + [(es[i][0], es[i][1], "gained", 0, 0, w) for i, w in sorted(changed.items())]
        return pd.DataFrame(out, columns=["source", "target", "kind", "plen", "pvar", "weight"])

    cols = [*key, "dummy", "bd", "bd_std", "bw", "bcc", "reads", "hits", "want", "block_source", "block_target"]
    return spread(e.select(*cols), "bcc").groupBy("bcc").applyInPandas(run, "source long, target long, kind string, plen long, pvar long, weight long")


def alternative_paths(edges: DataFrame, asked: DataFrame, forbidden: DataFrame, config: ScaffoldConfig = DEFAULT, most_iterations: int = 5_000_000) -> DataFrame:
    """asked(source, target, bd, bd_std) -> (source, target, path, plen, pvar): a path of other contigs for each edge that has one.

    Components of the graph are searched on executors; contigs of lines (forbidden) are entered at the target only.
    """
    e = settled(_with_component(edges.select("source", "target", "dummy", "bd", "bd_std", "bw")), "graph")
    where = e.select(F.col("source").alias("n"), "component").unionByName(e.select(F.col("target").alias("n"), "component")).distinct()
    a = asked.join(where, asked["source"] == where["n"]).select("source", "target", F.lit(True).alias("dummy"), "bd", "bd_std", F.lit(-1).cast("long").alias("bw"), "component")
    f = where.join(forbidden.select(F.col("node").alias("fn")), where["n"] == F.col("fn"), "left_semi").select(F.col("n").alias("source"), F.lit(0).cast("long").alias("target"), F.lit(True).alias("dummy"), F.lit(0).cast("long").alias("bd"), F.lit(0).cast("long").alias("bd_std"), F.lit(-2).cast("long").alias("bw"), "component")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bw", "source", "target"]).reset_index(drop=True)
        g = paths.Graph({i: [x.source, x.target, bool(x.dummy), int(x.bd), int(x.bd_std), int(x.bw)] for i, x in enumerate(rows[rows["bw"] >= 0].itertuples())})
        no = set(rows.loc[rows["bw"] == -2, "source"])
        own = {tuple(sorted(x[:2])): i for i, x in g.edges.items() if not x[2]}
        out = []
        for x in rows[rows["bw"] == -1].itertuples():
            found = paths.search(g, x.source, x.target, int(x.bd), int(x.bd_std), lambda n: n not in no, lambda _: True, most_iterations, config.few_paths, config.max_path_nodes, config.tolerance, skip=own.get(tuple(sorted((x.source, x.target)))))
            if found:
                nodes, way = found[-1]
                out.append((x.source, x.target, nodes, *paths.measure(g, way)))
        return pd.DataFrame(out, columns=["source", "target", "path", "plen", "pvar"])

    return spread(e.unionByName(a).unionByName(f), "component").groupBy("component").applyInPandas(run, "source long, target long, path array<long>, plen long, pvar long")


def semi_global(pairs: DataFrame) -> DataFrame:
    """pairs(query, target) with edits, tstart, tend of the best placement of the query."""

    @F.pandas_udf("edits int, tstart int, tend int")
    def run(q: pd.Series, t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align.semi_global(a, b) for a, b in zip(q, t)], columns=["edits", "tstart", "tend"])

    return pairs.withColumn("a", run("query", "target")).select(*pairs.columns, "a.*")


def aligned_windows(pairs: DataFrame, size: int = DEFAULT.trim_window) -> DataFrame:
    """pairs(query, target) -> a row for each target window with the query's span and identity in millionths."""

    @F.pandas_udf("array<struct<win:int,qstart:int,qlen:int,tstart:int,tlen:int,identity:int,whole:boolean>>")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([[(w.window, w.qstart, w.qlen, w.tstart, w.tlen, int(w.identity * 1_000_000), w.whole) for w in align.windows(a, b, size)] for a, b in zip(q, t)])

    keys = [c for c in pairs.columns if c not in ("query", "target")]
    return pairs.select(*keys, F.explode(run("query", "target")).alias("w")).select(*keys, "w.*")


GAP = "c1 long, c2 long, overlap int, gap_seq string, avg_cns int, iden_s int, iden_t int, cov_s int, cov_t int, low_identity int, proper_gap int, cns_len int"


#: Bases of leads whose tiles are worked on together.
TOGETHER = 4_000_000


def _consensuses(batches: Iterator[pd.DataFrame], config: ScaffoldConfig) -> Iterator[tuple[pd.DataFrame, list[tuple[str, list[int]]]]]:
    """Of batches with `seqs` (the lead first): parts of TOGETHER bases and the consensus and depth of their rows."""
    for rows in batches:
        seqs = [list(x) for x in rows["seqs"]]
        part = pd.Series([len(x[0]) for x in seqs], dtype="int64").cumsum() // TOGETHER
        for _, at in part.groupby(part).groups.items():
            yield rows.iloc[at], gaps.gap_consensus_many([(seqs[i][0], seqs[i][1:]) for i in at], config.tile, config.window_identity, config.min_window_query)


def _by_rank(members):
    """The sequences of a group's structs (rank, seq) by rank; nulls are left out."""
    return F.transform(F.sort_array(F.collect_list(members)), lambda x: x["seq"]).alias("seqs")


def gap_fill(members: DataFrame, ends: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """members(c1, c2, rank, seq): at most `consensus_reads` read parts of an edge, rank 0 the lead; ends(c1, c2, left, right, bd, bd_std)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, found in _consensuses(batches, config):
            out = []
            for e, (text, depth) in zip(rows.itertuples(), found):
                got = gaps.joined(text, depth, e.left, e.right, int(e.bd), int(e.bd_std), e.seqs[0], config.min_hit_identity, config.low_identity)
                out.append({"c1": e.c1, "c2": e.c2, **got, "cns_len": len(text)})
            yield pd.DataFrame(out)

    at = ["left", "right", "bd", "bd_std"]
    m = members.select("c1", "c2", F.struct("rank", "seq").alias("m"))
    both = m.unionByName(ends.select("c1", "c2", F.struct(*at).alias("e")), allowMissingColumns=True)
    packed = spread(both, "c1", "c2").groupBy("c1", "c2").agg(_by_rank(F.col("m")), F.first("e", ignorenulls=True).alias("e"))
    return packed.filter("size(seqs) > 0 AND e IS NOT NULL").select("c1", "c2", "seqs", "e.*").mapInPandas(run, GAP)


def window_consensus(members: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """members(id, rank, seq), rank 0 the lead -> (id, seq, mean_depth)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, found in _consensuses(batches, config):
            yield pd.DataFrame({"id": rows["id"].tolist(), "seq": [t for t, _ in found], "mean_depth": [sum(d) // max(1, len(d)) for _, d in found]})

    packed = spread(members, "id").groupBy("id").agg(_by_rank(F.struct("rank", "seq")))
    return packed.mapInPandas(run, "id long, seq string, mean_depth long")


def graph_polish(rows: DataFrame) -> DataFrame:
    """rows(id, gap, depth, pieces): a gap sequence and the oriented contigs of its alternative path -> (id, seq, n_replaced)."""

    @F.pandas_udf("seq string, n_replaced int")
    def run(gap: pd.Series, depth: pd.Series, pieces: pd.Series) -> pd.DataFrame:
        least = [0.95 if d >= 10 else 0.90 if d >= 5 else 0.80 for d in depth]
        return pd.DataFrame([gaps.polished(g, list(p), i) for g, p, i in zip(gap, pieces, least)], columns=["seq", "n_replaced"])

    return rows.withColumn("r", run("gap", "depth", "pieces")).select("id", "r.*")


def lis_lengths(rows: DataFrame) -> DataFrame:
    """rows(id, values) -> (id, n, lis): length of a longest strictly increasing subsequence."""

    @F.pandas_udf("int")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([len(align.lis(list(x))) for x in v])

    return rows.select("id", F.size("values").alias("n"), run("values").alias("lis"))


def greedy_cover(hits: DataFrame, novelty: int = DEFAULT.novelty) -> DataFrame:
    """hits(tid, qid, ts, te, cnt, mlen) -> the accepted ones of each target."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "te", "qid"]).reset_index(drop=True)
        return rows.loc[align.greedy_cover(list(zip(rows["ts"], rows["te"], rows["cnt"], rows["mlen"])), novelty)]

    return spread(hits.select("tid", "qid", "ts", "te", "cnt", "mlen"), "tid").groupBy("tid").applyInPandas(run, "tid long, qid long, ts int, te int, cnt int, mlen int")
