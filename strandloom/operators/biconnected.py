"""Biconnected components as DataFrame rounds, whatever the size of a component: no task holds one.

Tarjan and Vishkin's method. A spanning forest is grown by Boruvka's rounds; list ranking over its Euler tour gives each node the interval of its subtree.
The least and greatest node numbers that a subtree reaches by one further edge come from range minima over the tour, by doubling. Tree edges
(named by their child) that lie on a common cycle are linked by two local rules, and the components of these links are the blocks. All
joins are on nodes, arcs or places of the tour, so a hub or a giant component is never one key; the number of rounds grows with the
logarithm of the size (its square for the forest).

Defined results: a bridge is a component of its own; parallel edges, also in opposite directions, are in one component; a self-loop is one of its own; edges with a null
end belong to none (null); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, rounds, settled
from ..sources.readers import dense_index
from .graph import connected_components
from .joins import looked_up

#: The root's place in the tour: before all others.
_FIRST = -(1 << 62)


def spanning_forest(edges: DataFrame, most_rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """edges(a, b), a < b, distinct -> (its forest(a, b), labels(node, root)): in each round every component takes its least edge to another one."""
    level = settled(edges.select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.struct("a", "b").alias("e")), "level")
    labels = settled(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), "roots")
    forest = None
    for _ in range(most_rounds):
        if level.isEmpty():
            break
        one, other = F.struct(F.col("ca").alias("c"), F.struct("e", F.col("cb").alias("o")).alias("m")), F.struct(F.col("cb").alias("c"), F.struct("e", F.col("ca").alias("o")).alias("m"))
        pick = settled(level.select(F.explode(F.array(one, other)).alias("x")).groupBy("x.c").agg(F.min("x.m").alias("m")).select("c", "m.e", F.col("m.o").alias("parent")), "picks")
        new = pick.select("e.a", "e.b").distinct()
        forest = new if forest is None else forest.unionByName(new)
        # Edges have a total order, so the picks close no cycle but where two components pick the same edge: the lesser is the root.
        back = pick.select(F.col("c").alias("x"), F.col("parent").alias("px"))
        up = pick.join(back, F.col("parent") == F.col("x")).select("c", F.when((F.col("px") == F.col("c")) & (F.col("c") < F.col("parent")), F.col("c")).otherwise(F.col("parent")).alias("up"))
        up = settled(up, "parents")
        while True:
            further = up.select(F.col("c").alias("x"), F.col("up").alias("far"))
            twice = up.join(further, F.col("up") == F.col("x")).select("c", F.col("up").alias("was"), F.col("far").alias("up"))
            old, up = up, settled(twice, "parents")
            dropped(old)
            if up.filter("up <> was").isEmpty():
                break
        top = up.select("c", "up")
        old_labels, old_level = labels, level
        labels = settled(labels.join(top, F.col("root") == F.col("c"), "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        ends = level.join(top.select(F.col("c").alias("ca"), F.col("up").alias("ra")), "ca").join(top.select(F.col("c").alias("cb"), F.col("up").alias("rb")), "cb").filter("ra <> rb")
        level = settled(ends.groupBy(F.least("ra", "rb").alias("ca"), F.greatest("ra", "rb").alias("cb")).agg(F.min("e").alias("e")), "level")
        dropped(old_labels, old_level, up)
    else:
        raise RuntimeError("the spanning forest did not settle")
    return forest if forest is not None else edges.select("a", "b"), labels


def euler_tour(forest: DataFrame, labels: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v, root, t): both arcs of every tree edge with their place in the tour of their tree, ascending to 0 at the tour's end."""
    arcs = forest.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(forest.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # Arcs out of a node have consecutive numbers, so the next one at a node needs no window over a hub's arcs.
    out = settled(dense_index(arcs.orderBy("u", "v"), "no"), "out-arcs")
    ends = out.groupBy("u").agg(F.min("no").alias("lo"), F.max("no").alias("hi"))
    turn = out.join(ends, "u").select(F.col("v").alias("u"), F.col("u").alias("v"), F.when(F.col("no") < F.col("hi"), F.col("no") + 1).otherwise(F.col("lo")).alias("next"))
    starts = labels.filter("node = root").join(ends, F.col("node") == F.col("u")).select(F.col("lo").alias("start"))
    follow = out.join(turn, ["u", "v"]).join(starts, F.col("next") == F.col("start"), "left").join(labels, F.col("u") == F.col("node"))
    state = follow.select("no", "u", "v", "root", F.when(F.col("start").isNull(), F.col("next")).alias("next"), F.when(F.col("start").isNull(), 1).otherwise(0).cast("long").alias("after"))
    state = settled(state, "tour")
    for _ in range(most_rounds):
        if state.filter("next IS NOT NULL").isEmpty():
            return state.select("u", "v", "root", (-F.col("after")).alias("t"))
        far = state.select(F.col("no").alias("x"), F.col("next").alias("xn"), F.col("after").alias("xa"))
        j = state.join(far, F.col("next") == F.col("x"), "left").select("no", "u", "v", "root", F.col("xn").alias("next"), (F.col("after") + F.coalesce("xa", F.lit(0))).alias("after"))
        old, state = state, settled(j, "tour")
        dropped(old)
    raise RuntimeError("the tour did not settle")


def subtree_reach(nodes: DataFrame, reach: DataFrame) -> DataFrame:
    """nodes(node, root, first, last), reach(node, lo, hi) -> (node, low, high): the extremes of reach over the nodes of each subtree.

    Range extremes over the tour: level k holds those of 2^k places from each place on, and answers the subtrees of 2^k to 2^(k+1) - 1 places.
    """
    places = nodes.join(reach, "node", "left").select("root", F.explode(F.array(F.struct(F.col("first").alias("t"), F.least("first", "lo").alias("lo"), F.greatest("first", "hi").alias("hi")), F.struct(F.col("last").alias("t"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi")))).alias("x"))
    level = settled(places.select("root", "x.*"), "ranges")
    size = F.col("last") - F.col("first") + 1
    asked = settled(nodes.select("node", "root", "first", "last", F.floor(F.log2(size.cast("double"))).cast("int").alias("k")), "subtrees")
    most = asked.agg(F.max("k")).first()[0] or 0
    out = None
    for k in range(1, most + 1):
        half = 1 << (k - 1)
        right = level.select(F.col("root"), (F.col("t") - half).alias("t"), F.col("lo").alias("rlo"), F.col("hi").alias("rhi"))
        old, level = level, settled(level.join(right, ["root", "t"], "left").select("root", "t", F.least("lo", "rlo").alias("lo"), F.greatest("hi", "rhi").alias("hi")), "ranges")
        dropped(old)
        mine = asked.filter(F.col("k") == k)
        left = level.select("root", F.col("t").alias("first"), "lo", "hi")
        end = level.select("root", (F.col("t") + (1 << k) - 1).alias("last"), F.col("lo").alias("elo"), F.col("hi").alias("ehi"))
        got = mine.join(left, ["root", "first"]).join(end, ["root", "last"]).select("node", F.least("lo", "elo").alias("low"), F.greatest("hi", "ehi").alias("high"))
        got = settled(got, "reached")
        out = got if out is None else out.unionByName(got)
    return out if out is not None else nodes.select("node", F.col("first").alias("low"), F.col("last").alias("high"))


def blocks(edges: DataFrame) -> DataFrame:
    """edges(a, b), a < b, distinct -> (a, b, block): a long that the edges of a biconnected component share."""
    forest, labels = spanning_forest(edges)
    forest = settled(forest, "forest")
    tour = settled(euler_tour(forest, labels), "euler-tour")
    back = tour.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("t").alias("last"))
    # Of the two arcs of a tree edge the earlier one leads down.
    nodes = tour.join(back, ["u", "v"]).filter("t < last").select(F.col("v").alias("node"), F.col("u").alias("parent"), "root", F.col("t").alias("first"), "last")
    nodes = settled(nodes, "tree")
    place = nodes.select("node", "first", "last").unionByName(labels.filter("node = root").select("node", F.lit(_FIRST).alias("first"), F.lit(1).cast("long").alias("last")))
    place = settled(place, "places")
    at = lambda side: place.select(F.col("node").alias(side), F.col("first").alias(f"f{side}"), F.col("last").alias(f"l{side}"))
    rest = settled(edges.join(forest, ["a", "b"], "left_anti").join(at("a"), "a").join(at("b"), "b"), "back-edges")
    both = rest.select(F.col("a").alias("node"), F.col("fb").alias("f")).unionByName(rest.select(F.col("b").alias("node"), F.col("fa").alias("f")))
    reach = both.groupBy("node").agg(F.min("f").alias("lo"), F.max("f").alias("hi"))
    low = subtree_reach(nodes, reach)
    # Two rules: ends of an edge in unrelated subtrees; a subtree that reaches out of its parent's.
    apart = rest.filter("greatest(fa, fb) > CASE WHEN fa < fb THEN la ELSE lb END").select(F.col("a").alias("source"), F.col("b").alias("target"))
    above = nodes.select(F.col("node").alias("parent"), F.col("first").alias("pf"), F.col("last").alias("pl"))
    out_of = nodes.join(low, "node").join(above, "parent").filter("low < pf OR high > pl").select(F.col("parent").alias("source"), F.col("node").alias("target"))
    links = settled(apart.unionByName(out_of), "block-links")
    comp = connected_components(links)
    named = nodes.join(comp.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("node", "parent", F.coalesce("component", "node").alias("block"))
    named = settled(named, "block-names")
    tree = named.select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"), "block")
    later = rest.select("a", "b", F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("node"))
    return tree.unionByName(later.join(named.select("node", "block"), "node").select("a", "b", "block"))


def biconnected_components(edges: DataFrame) -> DataFrame:
    """edges(source, target) -> (source, target, bcc): a component is named by its least edge."""
    pairs = settled(edges.select("source", "target", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")), "pairs")
    with rounds(edges.sparkSession):
        proper = settled(pairs.filter("source <> target").select("a", "b").distinct(), "proper-edges")
        label = settled(blocks(proper), "blocks")
        marked = settled(pairs.join(label, ["a", "b"]).select("source", "target", "block"), "block-edges")
    least = marked.groupBy("block").agg(F.min(F.struct("source", "target")).alias("m"))
    name = lambda s, t: F.concat(s.cast("string"), F.lit("-"), t.cast("string"))
    out = looked_up(marked, least, ["block"]).select("source", "target", name(F.col("m.source"), F.col("m.target")).alias("bcc"))
    rest = pairs.filter("source = target OR source IS NULL OR target IS NULL")
    return out.unionByName(rest.select("source", "target", F.when(F.col("source") == F.col("target"), name(F.col("source"), F.col("target"))).alias("bcc")))
