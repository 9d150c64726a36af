"""Scaffold lines: positions, fragments, coverage, low-quality intervals, validated edges, AGP rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ScaffoldConfig
from .scan import neighbour, running_sum, shifted


def steps(lines: DataFrame, contigs: DataFrame, mates: DataFrame) -> DataFrame:
    """One row for each pair of neighbours of a line: line_id, idx, node, next, is_contig, ctgid, plus, d, bd_std, bw."""
    s = shifted(lines, "line_id", "idx", "node", {"next": 1}).filter("next IS NOT NULL")
    s = s.withColumns({"is_contig": F.shiftright("node", 1) == F.shiftright("next", 1), "ctgid": F.shiftright("node", 1), "u": F.least("node", "next"), "v": F.greatest("node", "next"), "plus": F.col("next") % 2 == 0})
    s = s.join(contigs.select("ctgid", "name", "length"), "ctgid", "left")
    m = mates.select(F.col("c1").alias("u"), F.col("c2").alias("v"), "bd", "bd_std", "bw")
    s = s.join(m, ["u", "v"], "left")
    d = F.when(F.col("is_contig"), F.col("length")).otherwise(F.col("bd")).cast("long")
    return s.select("line_id", "idx", "node", "next", "is_contig", "ctgid", "name", "length", "plus", d.alias("d"), F.when(~F.col("is_contig"), F.col("bd_std")).alias("bd_std"), F.when(~F.col("is_contig"), F.col("bw")).alias("bw"), "u", "v")


def positions(steps_: DataFrame) -> DataFrame:
    """(line_id, idx, node, pos): running sums of contig lengths and distances."""
    begin = F.struct(F.lit(0).cast("long").alias("idx"), F.col("node"), F.lit(0).cast("long").alias("pos"))
    end = F.struct((F.col("idx") + 1).alias("idx"), F.col("next").alias("node"), F.col("upto").alias("pos"))
    both = F.explode(F.when(F.col("idx") == 0, F.array(begin, end)).otherwise(F.array(end))).alias("p")
    return running_sum(steps_, "line_id", "idx", F.col("d"), "upto").select("line_id", both).select("line_id", "p.*")


def line_sizes(pos: DataFrame) -> DataFrame:
    """(line_id, size): the position of the last node."""
    return pos.groupBy("line_id").agg(F.max(F.struct("idx", "pos")).alias("x")).select("line_id", F.col("x.pos").alias("size"))


def path_length(steps_: DataFrame) -> DataFrame:
    """plen, clen, pvar of each line."""
    return steps_.groupBy("line_id").agg(
        F.sum("d").alias("plen"), F.sum(F.when(F.col("is_contig"), F.col("d")).otherwise(0)).alias("clen"),
        F.sqrt(F.sum(F.coalesce(F.col("bd_std") * F.col("bd_std"), F.lit(0)))).cast("long").alias("pvar"),
    )


def fragments(steps_: DataFrame, pos: DataFrame, far: DataFrame) -> DataFrame:
    """(line_id, idx, kind, pos, d): contig, supporting (edge) and suspicious fragments; far: edges with long links."""
    size = line_sizes(pos)
    p = shifted(pos, "line_id", "idx", "pos", {"before": -1, "after": 1, "after2": 2}).withColumnRenamed("pos", "at")
    s = steps_.join(p, ["line_id", "idx"]).join(size, "line_id").join(far.select(F.col("c1").alias("u"), F.col("c2").alias("v"), F.lit(True).alias("far")), ["u", "v"], "left")
    last = F.col("after2").isNull()
    start = F.when(F.col("is_contig") & (F.col("at") <= F.col("before")), F.col("before") + F.when(last, 1).otherwise(0)).otherwise(F.col("at"))
    end = F.when(F.col("is_contig") & (F.col("after") >= F.col("after2")), F.col("after2")).otherwise(F.col("after"))
    kind = F.when(F.col("is_contig"), "contig").when(F.col("far"), "edge").otherwise("suspicious")
    s = s.select("line_id", "idx", kind.alias("kind"), "u", "v", F.least(start, end).alias("pos"), F.abs(start - end).alias("d"), "size", last.alias("last"))
    clipped = (F.col("kind") == "edge") | ((F.col("kind") == "contig") & F.col("last"))
    d = F.when(clipped, F.least(F.col("d"), F.col("size") - F.col("pos"))).otherwise(F.col("d"))
    return s.filter("pos >= 0").select("line_id", "idx", "kind", "u", "v", "pos", d.alias("d"))


def reduced_in_line(reduced: DataFrame, pos: DataFrame) -> DataFrame:
    """Reduced edges (source, target, plen, pvar) with both ends in one line, and their positions there."""
    a = pos.select("line_id", F.col("node").alias("source"), F.col("pos").alias("ps"))
    b = pos.select("line_id", F.col("node").alias("target"), F.col("pos").alias("pt"))
    return reduced.join(a, "source").join(b, ["line_id", "target"])


def circles(steps_: DataFrame, cut: DataFrame) -> DataFrame:
    """cut(source, target, bd): mate edges that closed a cycle -> (line_id, closing): the circular lines and the length of the edge that went."""
    at = steps_.select("line_id", F.explode(F.array("node", "next")).alias("source")).distinct()
    return cut.join(at, "source").groupBy("line_id").agg(F.max("bd").cast("long").alias("closing"))


def circular_distance(inline: DataFrame, sizes: DataFrame, closed: DataFrame) -> DataFrame:
    """inline(line_id, source, target, plen, pvar, ps, pt) of circular lines, with size and around: the distance over the line's ends."""
    low, high = F.least("ps", "pt"), F.greatest("ps", "pt")
    return inline.join(closed, "line_id").join(sizes, "line_id").withColumn("around", low + (F.col("size") - high) + F.col("closing")).drop("closing")


def _agrees(distance, config: ScaffoldConfig):
    return F.abs(F.col("plen") - distance) <= config.tolerance * F.greatest("pvar", "line_var")


def path_fragments(inline: DataFrame, lengths: DataFrame, config: ScaffoldConfig = DEFAULT, sizes: DataFrame | None = None, closed: DataFrame | None = None) -> DataFrame:
    """(line_id, source, target, pos, d) of the reduced edges that agree with their line; the observed distance counts.

    With the lines' sizes and the circular lines (circles()): an edge that disagrees, but agrees over the ends of a circular line, gives two
    fragments, from the line's begin to its first node and from its second node to the line's end.
    """
    x = inline.join(lengths.select("line_id", F.col("pvar").alias("line_var")), "line_id").filter(F.col("plen") >= config.mlp)
    low, high = F.least("ps", "pt"), F.greatest("ps", "pt")
    straight = _agrees(high - low, config)
    plain = x.filter(straight & (low >= 0)).select("line_id", "source", "target", low.alias("pos"), (high - low).alias("d"))
    if closed is None:
        return plain
    over = circular_distance(x.filter(~straight), sizes, closed).filter(_agrees(F.col("around"), config))
    zero = F.lit(0).cast("long")
    two = F.array(F.struct(zero.alias("pos"), low.cast("long").alias("d")), F.struct(high.cast("long").alias("pos"), (F.col("size") - high).cast("long").alias("d")))
    return plain.unionByName(over.select("line_id", "source", "target", F.explode(two).alias("f")).select("line_id", "source", "target", "f.*").filter("pos >= 0"))


def physical_coverage(reduced: DataFrame, found: DataFrame, lengths: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """One row: reduced edges of at least mlp (n_tried), those with fragments (n_added), their length, the length of the lines of at least mlp,
    and the first by the second, the physical coverage."""
    long_ = reduced.filter(F.col("plen") >= config.mlp)
    added = long_.join(found.select("source", "target").distinct(), ["source", "target"], "left_semi")
    tried = long_.agg(F.count("*").alias("n_tried"))
    got = added.agg(F.count("*").alias("n_added"), F.coalesce(F.sum("plen"), F.lit(0)).cast("long").alias("path_length"))
    whole = lengths.filter(F.col("plen") >= config.mlp).agg(F.coalesce(F.sum("plen"), F.lit(0)).cast("long").alias("line_length"))
    one = tried.crossJoin(F.broadcast(got)).crossJoin(F.broadcast(whole))  # one row each
    return one.withColumn("coverage", F.round(F.col("path_length") / F.when(F.col("line_length") > 0, F.col("line_length")), 9))


def depth(frags: DataFrame, sizes: DataFrame) -> DataFrame:
    """(line_id, beg, end, depth) of the constant stretches of coverage; fragments outside their line don't count."""
    f = frags.join(sizes, "line_id").filter((F.col("pos") >= 0) & (F.col("d") >= 0) & (F.col("pos") + F.col("d") <= F.col("size")))
    step = F.explode(F.array(F.struct(F.col("pos").alias("at"), F.lit(1).alias("w")), F.struct((F.col("pos") + F.col("d")).alias("at"), F.lit(-1).alias("w")))).alias("x")
    border = sizes.select("line_id", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("w")), F.struct(F.col("size").alias("at"), F.lit(0).alias("w")))).alias("x"))
    turns = f.select("line_id", step).unionByName(border).groupBy("line_id", "x.at").agg(F.sum("x.w").alias("w"))
    # The depth changes where something begins or ends; a line's first and last place are the outer borders.
    upto = running_sum(turns, "line_id", "at", F.col("w"), "depth").join(sizes, "line_id")
    changes = upto.filter((F.col("w") != 0) | (F.col("at") == 0) | (F.col("at") == F.col("size"))).select("line_id", F.col("at").alias("beg"), "depth")
    return neighbour(changes, "line_id", "beg", "beg", "end", True).filter("end IS NOT NULL").select("line_id", "beg", "end", "depth")


def low_intervals(depths: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """(line_id, start, stop), ends included: stretches without coverage; those less than `lqi_merge` bases apart are one."""
    bare = neighbour(depths.filter("depth < 1").select("line_id", "beg", "end"), "line_id", "beg", "end", "last", False)
    heads = bare.filter(F.col("last").isNull() | (F.col("beg") - (F.col("last") - 1) >= config.lqi_merge))
    # An interval ends where the stretch before the next head ends, the last one of a line with the line's last stretch.
    heads = neighbour(heads.select("line_id", "beg", F.coalesce("last", F.lit(-1)).alias("last")), "line_id", "beg", "last", "until", True)
    final = bare.groupBy("line_id").agg(F.max("end").alias("final"))
    return heads.join(final, "line_id").select("line_id", F.col("beg").alias("start"), (F.coalesce("until", "final") - 1).alias("stop"))


#: Bases of a bin by which intervals meet; an interval lies in one or two of them, or in as many as it is long.
BIN = 65_536


def suspicious_overlaps(low: DataFrame, frags: DataFrame) -> DataFrame:
    """Suspicious edges with a low interval that starts or stops in them.

    The two ends of a low interval are points; a point meets the fragments over its bin, not all of its line. A stop counts where the start doesn't.
    """
    f = frags.filter("kind = 'suspicious'").select("line_id", "u", "v", "pos", "d")
    end = F.col("pos") + F.col("d")
    f = f.withColumn("bin", F.explode(F.sequence(F.expr(f"pos div {BIN}"), F.expr(f"(pos + d) div {BIN}"))))
    both = F.array(F.struct(F.col("start").alias("at"), F.lit(True).alias("first")), F.struct(F.col("stop").alias("at"), F.lit(False).alias("first")))
    points = low.select("line_id", "start", "stop", F.explode(both).alias("p")).select("line_id", "start", "stop", "p.*").withColumn("bin", F.expr(f"at div {BIN}"))
    met = points.join(f, ["line_id", "bin"]).filter(F.col("at").between(F.col("pos"), end) & (F.col("first") | ~F.col("start").between(F.col("pos"), end)))
    return met.select("line_id", "start", "stop", "u", "v", "pos", "d")


def validated(mates: DataFrame, overlaps: DataFrame, support: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """The cover's mate edges without the suspicious ones that too few reads cross."""
    reads = support.groupBy(F.col("c1").alias("u"), F.col("c2").alias("v")).agg(F.count("*").alias("n_reads"))
    gone = overlaps.select("u", "v").distinct().join(reads, ["u", "v"], "left").filter(F.coalesce("n_reads", F.lit(0)) < config.nlm)
    return mates.join(gone.select(F.col("u").alias("c1"), F.col("v").alias("c2")), ["c1", "c2"], "left_anti")


def agp(steps_: DataFrame, contigs: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """AGP rows: contigs (W), gaps (N) and single contigs; a scaffold is named by its least node."""
    size = F.when(F.col("is_contig"), F.col("length")).otherwise(F.greatest(F.col("d"), F.lit(config.min_gap))).cast("long")
    s = running_sum(steps_.withColumn("size", size), "line_id", "idx", F.col("size"), "upto").withColumn("beg", 1 + F.col("upto") - F.col("size"))
    single = contigs.join(steps_.filter("is_contig").select("ctgid"), "ctgid", "left_anti")
    alone = single.select(F.col("header").alias("line_id"), F.lit(0).cast("long").alias("idx"), F.lit(True).alias("is_contig"), "name", "length", F.lit(True).alias("plus"), F.col("length").cast("long").alias("size"), F.lit(1).cast("long").alias("beg"))
    every = s.select(*alone.columns).unionByName(alone)
    w = F.col("is_contig")
    return every.select(
        F.concat(F.lit("SCF"), F.col("line_id")).alias("scf"), "beg", (F.col("beg") + F.col("size")).alias("end"), (F.col("idx") + 1).alias("part"),
        F.when(w, "W").otherwise("N").alias("type"),
        F.when(w, F.col("name")).otherwise(F.col("size").cast("string")).alias("c6"),
        F.when(w, "1").otherwise("scaffold").alias("c7"),
        F.when(w, F.col("length").cast("string")).otherwise("yes").alias("c8"),
        F.when(w, F.when(F.col("plus"), "+").otherwise("-")).otherwise("paired-end").alias("c9"),
    )
