"""Links to edges: distance-weighted bundles, and the reads behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, ScaffoldConfig


def truncated(x):
    """Rounded to nine digits, so that the order of a sum can't flip an integer border, then cut to an integer."""
    return F.round(x, 9).cast("long")


def _histogram(links: DataFrame) -> DataFrame:
    """(c1, c2, dist, lib, std, n, rw, mid): counts by distinct (dist, lib), and whether the upper median of the edge's links by (dist, lib) is there.

    These rows are bounded by the insert sizes, however many links an edge has, and are aggregated map side.
    """
    hist = links.groupBy("c1", "c2", "dist", "lib", "std").agg(F.count("*").alias("n"))
    edge = Window.partitionBy("c1", "c2")
    up_to = edge.orderBy("dist", "lib").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = hist.withColumns({"upto": F.sum("n").over(up_to), "rw": F.sum("n").over(edge)})
    return ranked.withColumn("mid", (F.col("upto") > F.expr("rw div 2")) & (F.col("upto") - F.col("n") <= F.expr("rw div 2"))).drop("upto")


def windows(links: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """(c1, c2, rw, low, high): what a bundle keeps, around the upper median of its links by (dist, lib)."""
    s = config.bundle_sigmas * F.col("std")
    return _histogram(links).filter("mid").select("c1", "c2", "rw", (F.col("dist") - s).alias("low"), (F.col("dist") + s).alias("high"))


def kept_links(links: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """The links that their bundle keeps, with rw."""
    return links.join(windows(links, config), ["c1", "c2"]).filter(F.col("dist").between(F.col("low"), F.col("high"))).drop("low", "high")


def _bundled(kept: DataFrame, n, config: ScaffoldConfig) -> DataFrame:
    one = n / (F.col("std") * F.col("std"))
    sums = kept.groupBy("c1", "c2").agg(F.sum(F.col("dist") * one).alias("p"), F.sum(one).alias("q"), F.sum(n).alias("bw"), F.max("rw").alias("rw"))
    return sums.filter(F.col("bw") >= config.min_bundle).select("c1", "c2", truncated(F.col("p") / F.col("q")).alias("bd"), truncated(1.0 / F.sqrt("q")).alias("bd_std"), "bw", "rw")


def bundles(kept: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """(c1, c2, bd, bd_std, bw, rw): inverse-variance mean distance of the kept links; thin bundles go."""
    return _bundled(kept, F.lit(1).cast("long"), config)


def bundles_of(links: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """bundles(kept_links(links)) from the counts by distance alone: links are read once and not joined with their windows."""
    edge, s = Window.partitionBy("c1", "c2"), config.bundle_sigmas * F.col("std")
    at = lambda x: F.max(F.when(F.col("mid"), x)).over(edge)
    h = _histogram(links).withColumns({"low": at(F.col("dist") - s), "high": at(F.col("dist") + s)})
    return _bundled(h.filter(F.col("dist").between(F.col("low"), F.col("high"))), F.col("n"), config)


def edge_read_support(kept: DataFrame) -> DataFrame:
    """Kept links of each edge and long read."""
    return kept.groupBy("c1", "c2", "read_id").agg(F.count("*").alias("hits"))


def long_links(kept: DataFrame, d: int) -> DataFrame:
    """Kept links of each edge with an insert of at least d: how many, and of how many reads."""
    far = kept.filter(F.col("gap_end") - F.col("gap_start") + 400 >= d)
    return far.groupBy("c1", "c2").agg(F.count("*").alias("n_links"), F.countDistinct("read_id").alias("n_reads"))


def top_reads(support: DataFrame, n: int = DEFAULT.consensus_reads) -> DataFrame:
    """The n + 1 reads with the most hits on each edge; ties by read."""
    best = Window.partitionBy("c1", "c2").orderBy(F.desc("hits"), "read_id")
    return support.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n + 1)


def consensus_links(kept: DataFrame, top: DataFrame, n: int = DEFAULT.consensus_reads) -> DataFrame:
    """One link for each top read of an edge (the first by library and positions), at most n for an edge."""
    first = kept.groupBy("c1", "c2", "read_id").agg(F.min(F.struct("lib", "p1", "p2", "dist", "gap_start", "gap_end", "switched")).alias("x"))
    return top.filter(F.col("rank") <= n).join(first, ["c1", "c2", "read_id"]).select("c1", "c2", "read_id", "rank", "hits", "x.*")


def lead_reads(support: DataFrame) -> DataFrame:
    """The read with the most hits on each edge; ties by read."""
    best = F.min(F.struct((-F.col("hits")).alias("neg"), "read_id")).alias("x")
    return support.groupBy("c1", "c2").agg(best).select("c1", "c2", F.col("x.read_id").alias("read_id"), (-F.col("x.neg")).alias("hits"))


VIEWS = {
    "ranked": """SELECT *, row_number() OVER (PARTITION BY c1, c2 ORDER BY dist, lib) - 1 AS i, count(*) OVER (PARTITION BY c1, c2) AS rw FROM links""",
    "mid": "SELECT c1, c2, dist AS m, std AS ms FROM ranked WHERE i = rw // 2",
    "kept": "SELECT r.* FROM ranked r JOIN mid USING (c1, c2) WHERE dist BETWEEN m - 3*ms AND m + 3*ms",
    "bundles": """SELECT c1, c2, CAST(trunc(round(p/q, 9)) AS BIGINT) AS bd, CAST(trunc(round(1.0/sqrt(q), 9)) AS BIGINT) AS bd_std, bw, rw FROM (
        SELECT c1, c2, sum(dist*(1.0/(std*std))::DOUBLE) AS p, sum((1.0/(std*std))::DOUBLE) AS q, count(*) AS bw, max(rw) AS rw FROM kept GROUP BY c1, c2) WHERE bw >= 5""",
    "esupport": "SELECT c1, c2, read_id, count(*) AS hits FROM kept GROUP BY c1, c2, read_id",
    "csupport": "SELECT ctgid, read_id, sum(w) AS hits FROM ends GROUP BY ctgid, read_id",
    "top": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c1, c2 ORDER BY hits DESC, read_id) AS rank FROM esupport) WHERE rank <= 21",
}
