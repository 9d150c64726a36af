"""The scaffold graph as node and edge tables: construction, predicates, components, lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ScaffoldConfig
from ..functions.morton import pair_key
from ..session import dropped, rounds, settled


def nodes(contigs: DataFrame, repeats: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """Two nodes for each contig: header 2i and tail 2i + 1."""
    c = contigs.join(repeats.select("ctgid", "repeat"), "ctgid", "left")
    side = F.explode(F.array(F.struct(F.col("header").alias("node_id"), F.lit(True).alias("is_head")), F.struct(F.col("tail").alias("node_id"), F.lit(False).alias("is_head")))).alias("s")
    flags = [F.coalesce("repeat", F.lit(False)).alias("repeat"), (F.col("length") < config.mcs).alias("short"), F.col("length").alias("ctg_len")]
    return c.select("ctgid", *flags, side).select("s.node_id", "ctgid", "s.is_head", "repeat", "short", "ctg_len")


def contig_edges(contigs: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return contigs.select(F.col("header").alias("source"), F.col("tail").alias("target"), F.lit(True).alias("dummy"), zero.alias("bd"), zero.alias("bd_std"), zero.alias("bw"), zero.alias("rw"))


def mate_edges(bundles: DataFrame) -> DataFrame:
    return bundles.select(F.col("c1").alias("source"), F.col("c2").alias("target"), F.lit(False).alias("dummy"), "bd", "bd_std", "bw", "rw")


def edges(contigs: DataFrame, bundles: DataFrame) -> DataFrame:
    """All edges with their interleaved key."""
    e = contig_edges(contigs).unionByName(mate_edges(bundles))
    return e.withColumn("edge_key", pair_key(F.col("source"), F.col("target")))


def endpoints(edges_: DataFrame, nodes_: DataFrame) -> DataFrame:
    """Edges with ctgid, repeat, short and length of both ends."""
    out = edges_
    for at, mark in (("source", "s"), ("target", "t")):
        side = nodes_.select(F.col("node_id").alias(at), *[F.col(c).alias(f"{mark}_{c}") for c in ("ctgid", "repeat", "short", "ctg_len")])
        out = out.join(side, at)
    return out


def reducible(ends: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    return ends.filter(~F.col("dummy") & ~F.col("s_repeat") & ~F.col("t_repeat") & ~F.col("s_short") & ~F.col("t_short") & (F.col("bd") >= config.reducible))


def matching_candidates(ends: DataFrame, contigs: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """Mate edges with enough links between long contigs of usual coverage."""
    mean = contigs.agg(F.avg("coverage").alias("mean_cov"))
    cov = contigs.select(F.col("ctgid"), "coverage")
    e = ends.join(cov.withColumnsRenamed({"ctgid": "s_ctgid", "coverage": "s_cov"}), "s_ctgid").join(cov.withColumnsRenamed({"ctgid": "t_ctgid", "coverage": "t_cov"}), "t_ctgid")
    most = config.rct * F.col("mean_cov")
    e = e.crossJoin(F.broadcast(mean))  # one row
    return e.filter(~F.col("dummy") & (F.col("bw") >= config.min_bundle) & (F.least("s_ctg_len", "t_ctg_len") >= config.mcr) & (F.greatest("s_cov", "t_cov") <= most))


def degrees(edges_: DataFrame) -> DataFrame:
    return edges_.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def connected_components(edges_: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component): the least node reachable, for every node with an edge.

    Labels flow to neighbours and then jump along the labels' own labels, so a long path takes about log2 rounds.
    """
    arcs = settled(edges_.select("source", "target").unionByName(edges_.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct(), "arcs")
    held = label = settled(arcs.groupBy(F.col("source").alias("node")).agg(F.min("target").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    with rounds(arcs.sparkSession):
        for _ in range(most_rounds):
            near = arcs.join(label, arcs["target"] == label["node"]).groupBy("source").agg(F.min("component").alias("m"))
            low = label.join(near, label["node"] == near["source"], "left").select("node", "component", F.least("component", "m").alias("low"))
            # A node that found a smaller label tells the one its old label names, too.
            told = low.filter("low < component").groupBy(F.col("component").alias("node")).agg(F.min("low").alias("t"))
            best = low.join(told, "node", "left").select("node", "component", F.least("low", F.coalesce("t", "low")).alias("low"))
            jump = best.select(F.col("node").alias("n"), F.col("low").alias("far"))
            new = settled(best.join(jump, best["low"] == jump["n"], "left").select("node", F.least("low", F.coalesce("far", "low")).alias("new"), "component"), "labels")
            dropped(held)
            held, label = new, new.select("node", F.col("new").alias("component"))
            if new.filter("new < component").isEmpty():
                dropped(arcs)
                return label
    raise RuntimeError("components did not settle")


def alternating_paths(edges_: DataFrame, asked: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """(source, target, path, plen, pvar): every simple path of contig and mate edges in turn, beside each asked edge, whose length agrees with its own.

    edges_(source, target, dummy, bd, bd_std), asked(source, target, bd, bd_std). Paths grow by one edge a round, all at once; one that is too long
    already grows no further, and none has more than `max_path_nodes` + 1 nodes. A round's paths are written, so a lost executor costs a round.
    """
    arc = lambda a, b: edges_.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col("dummy").alias("kind"), F.col("bd").cast("long").alias("d"), F.col("bd_std").cast("long").alias("sd"))
    arcs = settled(arc("source", "target").unionByName(arc("target", "source")), "arcs")
    pvar = F.floor(F.sqrt("var")).cast("long")
    near = F.abs(F.col("plen") - F.col("bd")) <= config.tolerance * F.greatest("bd_std", pvar)
    zero = F.lit(0).cast("long")
    front = settled(asked.select("source", "target", "bd", "bd_std", F.col("source").alias("last"), F.array("source").alias("path"), zero.alias("plen"), zero.alias("var"), F.lit(None).cast("boolean").alias("dummy")), "paths")
    found = None
    for _ in range(config.max_path_nodes):
        step = front.join(arcs, F.col("last") == F.col("a")).filter(~F.array_contains("path", F.col("b")) & (F.col("dummy").isNull() | (F.col("dummy") != F.col("kind"))))
        step = step.filter(~((F.size("path") == 1) & (F.col("b") == F.col("target")) & ~F.col("kind")))
        grown = step.select("source", "target", "bd", "bd_std", F.col("b").alias("last"), F.array_append("path", F.col("b")).alias("path"), (F.col("plen") + F.col("d")).alias("plen"), (F.col("var") + F.col("sd") * F.col("sd")).alias("var"), F.col("kind").alias("dummy"))
        there = F.col("last") == F.col("target")
        new = settled(grown.filter(F.when(there, near & (F.size("path") >= 4)).otherwise((F.col("plen") <= F.col("bd")) | near)), "paths")
        done = new.filter(there)
        found = done if found is None else found.unionByName(done)
        front = new.filter(~there)
        if front.isEmpty():
            break
    return found.select("source", "target", "path", "plen", pvar.alias("pvar"))


def lines(cover: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(line_id, idx, node): the nodes of every path of a cover with more than two nodes, from its smaller end.

    List ranking by pointer doubling over directed edges: each arc u->v learns how many arcs follow it and the end it leads to;
    the direction that leads to the larger end is the line's. A cover has at most two edges at a node and no cycle.
    """
    e = cover.select("source", "target")
    arcs = e.select(F.col("source").alias("u"), F.col("target").alias("v")).unionByName(e.select(F.col("target").alias("u"), F.col("source").alias("v")))
    nxt = arcs.select(F.col("u").alias("x"), F.col("v").alias("y"))
    state = arcs.join(nxt, (F.col("v") == F.col("x")) & (F.col("u") != F.col("y")), "left").select(
        "u", "v", F.when(F.col("y").isNotNull(), F.col("x")).alias("nu"), F.col("y").alias("nv"), F.when(F.col("y").isNotNull(), 1).otherwise(0).cast("long").alias("after"), F.col("v").alias("end"),
    )
    state = settled(state, "arcs")
    with rounds(cover.sparkSession):
        for _ in range(most_rounds):
            if state.filter("nv IS NOT NULL").isEmpty():
                break
            far = state.select(F.col("u").alias("fu"), F.col("v").alias("fv"), F.col("nu").alias("fnu"), F.col("nv").alias("fnv"), F.col("after").alias("fafter"), F.col("end").alias("fend"))
            j = state.join(far, (F.col("nu") == F.col("fu")) & (F.col("nv") == F.col("fv")), "left")
            old, state = state, settled(j.select("u", "v", F.col("fnu").alias("nu"), F.col("fnv").alias("nv"), (F.col("after") + F.coalesce("fafter", F.lit(0))).alias("after"), F.coalesce("fend", "end").alias("end")), "arcs")
            dropped(old)
        else:
            raise RuntimeError("a cover must not hold cycles")
    # The end behind an arc is the end that its reverse leads to.
    back = state.select(F.col("v").alias("bu"), F.col("u").alias("bv"), F.col("end").alias("start"), F.col("after").alias("before"))
    both = state.join(back, (F.col("u") == F.col("bu")) & (F.col("v") == F.col("bv"))).filter("start < end AND before + after > 0")
    own = both.select("start", (F.col("before") + 1).alias("idx"), F.col("v").alias("node"))
    first = both.filter("before = 0").select("start", F.lit(0).cast("long").alias("idx"), F.col("u").alias("node"))
    every = own.unionByName(first)
    ids = every.groupBy("start").agg(F.min("node").alias("line_id"))
    return every.join(ids, "start").select("line_id", "idx", "node")
