"""Paths that the reads of an edge support, found together for all edges in rounds.

An edge's needed reads are those that support it with more than `read_hits` hits. Which other edges carry all of them is one relational division, worked
out by counts before any path is grown: (edge, part) pairs with as many common reads as the edge needs, with their hits. A frontier of partial paths is
then joined with the parts that its own edge allows, so a path is never grown by a part that lacks a needed read, and the rows of a round follow the
supported paths, not the graph's degree. Edges without needed reads may use every part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ScaffoldConfig
from ..session import dropped, settled


def supporting_parts(asked: DataFrame, reads: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """asked(source, target), reads(source, target, read_id, hits), one row an edge and read -> (source, target, s, t, hits): the parts s-t that carry all reads
    needed by the asked edge, with the hits of these on the part; asked edges that need none don't appear."""
    needed = reads.filter(F.col("hits") > config.read_hits).join(asked.select("source", "target").distinct(), ["source", "target"], "left_semi").select("source", "target", "read_id")
    needed = settled(needed, "needed-reads")
    many = needed.groupBy("source", "target").agg(F.count("*").alias("needed"))
    on = reads.select(F.col("source").alias("s"), F.col("target").alias("t"), "read_id", "hits")
    met = needed.join(on, "read_id").groupBy("source", "target", "s", "t").agg(F.count("*").alias("n"), F.sum("hits").alias("hits"))
    return met.join(many, ["source", "target"]).filter("n = needed").select("source", "target", "s", "t", "hits")


def supported_paths(edges_: DataFrame, asked: DataFrame, reads: DataFrame, blocked: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """(source, target, path, plen, pvar, weight): every simple path of contig and mate edges in turn beside each asked edge whose length agrees with its own, whose
    parts all carry the reads that the edge needs, and whose inner nodes aren't blocked; weight: hits of the needed reads on the parts.

    edges_(source, target, dummy, bd, bd_std), asked(source, target, bd, bd_std), reads(source, target, read_id, hits), contig edges included,
    blocked(node). A round's paths are written, so a lost executor costs a round; the front of a round is removed when the next one stands.
    """
    zero = F.lit(0).cast("long")
    key = ["source", "target"]
    asked = settled(asked.select(*key, "bd", "bd_std"), "asked")
    parts = settled(supporting_parts(asked, reads, config), "parts")
    stops = blocked.select(F.col("node").alias("stop")).distinct()
    e = edges_.select(F.col("source").alias("s"), F.col("target").alias("t"), F.col("dummy").alias("kind"), F.col("bd").cast("long").alias("d"), F.col("bd_std").cast("long").alias("sd"))
    both = F.explode(F.array(F.struct(F.col("s").alias("a"), F.col("t").alias("b")), F.struct(F.col("t").alias("a"), F.col("s").alias("b")))).alias("x")
    arcs = e.select("s", "t", "kind", "d", "sd", both).select("s", "t", "kind", "d", "sd", "x.a", "x.b")
    arcs = settled(arcs.join(stops, F.col("b") == F.col("stop"), "left").select("s", "t", "kind", "d", "sd", "a", "b", F.col("stop").isNotNull().alias("closed")), "arcs")
    own = settled(parts.join(arcs, ["s", "t"]).filter("NOT closed OR b = target").select(*key, F.col("hits").alias("w"), "kind", "d", "sd", "a", "b"), "own-arcs")
    free = asked.join(reads.filter(F.col("hits") > config.read_hits).select(*key).distinct(), key, "left_anti").select(*key, F.lit(True).alias("free"))
    pvar = F.floor(F.sqrt("var")).cast("long")
    near = F.abs(F.col("plen") - F.col("bd")) <= config.tolerance * F.greatest("bd_std", pvar)
    front = asked.join(free, key, "left").select(*key, "bd", "bd_std", F.coalesce("free", F.lit(False)).alias("free"), F.col("source").alias("last"), F.array("source").alias("path"), zero.alias("plen"), zero.alias("var"), zero.alias("weight"), F.lit(None).cast("boolean").alias("dummy"))
    front, found = settled(front, "front"), None
    for _ in range(config.max_path_nodes):
        wide = front.filter("free").join(arcs, F.col("last") == F.col("a")).filter("NOT closed OR b = target").select(*front.columns, zero.alias("w"), "kind", "d", "sd", "b")
        mine = front.filter("NOT free").join(own.withColumnRenamed("a", "last"), [*key, "last"]).select(*front.columns, "w", "kind", "d", "sd", "b")
        step = mine.unionByName(wide).filter(~F.array_contains("path", F.col("b")) & (F.col("dummy").isNull() | (F.col("dummy") != F.col("kind"))))
        # The asked edge itself is no path beside it.
        step = step.filter(~((F.size("path") == 1) & (F.col("b") == F.col("target")) & ~F.col("kind")))
        grown = step.select(*key, "bd", "bd_std", "free", F.col("b").alias("last"), F.array_append("path", F.col("b")).alias("path"), (F.col("plen") + F.col("d")).alias("plen"), (F.col("var") + F.col("sd") * F.col("sd")).alias("var"), (F.col("weight") + F.col("w")).alias("weight"), F.col("kind").alias("dummy"))
        there = F.col("last") == F.col("target")
        new = settled(grown.filter(F.when(there, near & (F.size("path") >= 4)).otherwise((F.col("plen") <= F.col("bd")) | near)), "front")
        done = settled(new.filter(there), "found-paths")
        if done.isEmpty():
            dropped(done)
        else:
            found = done if found is None else found.unionByName(done)
        old, front = front, settled(new.filter(~there), "front")
        dropped(old, new)
        if front.isEmpty():
            break
    found = found if found is not None else front.limit(0)
    return found.select(*key, "path", "plen", pvar.alias("pvar"), "weight")
