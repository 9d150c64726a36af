"""Mate pairs to links: orientation, distance, validity, canonical node order, and the counts taken on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ScaffoldConfig


def located(aln: DataFrame, contigs: DataFrame) -> DataFrame:
    """Pairs with the contigs of both mates; a pair with an unknown contig goes.

    The contig table is joined as it is: Spark broadcasts it by its own size estimate, or shuffles both sides.
    """
    c = contigs.select("ctgid", "name", "length")
    one, two = (c.select(F.col("ctgid").alias(f"ctg{i}"), F.col("name").alias(f"name{i}"), F.col("length").alias(f"len{i}")) for i in (1, 2))
    return aln.join(one, "name1").join(two, "name2")


def oriented(pairs: DataFrame) -> DataFrame:
    """o1, o2 of forward-reverse libraries: the second mate is turned."""
    return pairs.withColumns({"o1": F.when(F.col("fwd1"), 0).otherwise(1), "o2": F.lit(1) - F.when(F.col("fwd2"), 0).otherwise(1)})


def distanced(pairs: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """dist of each oriented pair, and plus1, plus2: whether each contig is traversed forward."""
    avg, o1, o2 = F.col("avg"), F.col("o1"), F.col("o2")
    left1, left2 = F.col("len1") - F.col("pos1"), F.col("len2") - F.col("pos2")
    r1, r2 = F.col("pos1") + config.read_length, F.col("pos2") + config.read_length
    dist = F.when((o1 == 0) & (o2 == 0), avg - left1 - r2).when((o1 == 1) & (o2 == 1), avg - left2 - r1).when((o1 == 0) & (o2 == 1), avg - left1 - left2).otherwise(avg - r1 - r2)
    return pairs.withColumns({"dist": dist.cast("long"), "plus1": o1 == 0, "plus2": o2 == 1})


def valid(links: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """Links between two contigs at a distance that their library allows."""
    s = config.link_sigmas * F.col("std")
    return links.filter((F.col("ctg1") != F.col("ctg2")) & (F.col("dist") > -s) & (F.col("dist") < F.col("avg") + s))


def canonical(links: DataFrame) -> DataFrame:
    """c1 <= c2: the nodes that a link joins, with the positions in that order."""
    n1 = 2 * F.col("ctg1") + F.when(F.col("plus1"), 0).otherwise(1)
    n2 = 2 * F.col("ctg2") + F.when(F.col("plus2"), 0).otherwise(1)
    turn = n1 > n2
    return links.withColumns(
        {
            "c1": F.least(n1, n2), "c2": F.greatest(n1, n2), "switched": turn,
            "p1": F.when(turn, F.col("pos2")).otherwise(F.col("pos1")), "p2": F.when(turn, F.col("pos1")).otherwise(F.col("pos2")),
        }
    )


def links_of(aln: DataFrame, contigs: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """All valid links between contigs, in canonical order."""
    cols = ["lib", "std", "read_id", "gap_start", "gap_end", "ctg1", "ctg2", "c1", "c2", "p1", "p2", "dist", "switched"]
    return canonical(valid(distanced(oriented(located(aln, contigs)), config), config)).select(*cols)


def pair_ends(aln: DataFrame, contigs: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """(lib, ctgid, read_id, w): two for a pair inside a contig, one for each end of a valid link."""
    p = distanced(oriented(located(aln, contigs)), config)
    inner = p.filter("ctg1 = ctg2").select("lib", F.col("ctg1").alias("ctgid"), "read_id", F.lit(2).alias("w"))
    ends = valid(p, config).select("lib", F.explode(F.array("ctg1", "ctg2")).alias("ctgid"), "read_id", F.lit(1).alias("w"))
    return inner.unionByName(ends)


def contig_read_counts(ends: DataFrame) -> DataFrame:
    """Reads of each contig in the library of rank 0."""
    return ends.filter("lib = 0").groupBy("ctgid").agg(F.sum("w").alias("num_reads"))


def contig_read_support(ends: DataFrame) -> DataFrame:
    """Hits of each long read on each contig, over all libraries."""
    return ends.groupBy("ctgid", "read_id").agg(F.sum("w").alias("hits"))


VIEWS = {
    "located": """SELECT a.*, x.ctgid AS ctg1, y.ctgid AS ctg2, x.length AS len1, y.length AS len2
        FROM alignments a JOIN contigs x ON name1 = x.name JOIN contigs y ON name2 = y.name""",
    "oriented": "SELECT *, CASE WHEN fwd1 THEN 0 ELSE 1 END AS o1, 1 - CASE WHEN fwd2 THEN 0 ELSE 1 END AS o2 FROM located",
    "distanced": """SELECT *, CAST(CASE WHEN o1 = 0 AND o2 = 0 THEN avg - (len1 - pos1) - (pos2 + 200) WHEN o1 = 1 AND o2 = 1 THEN avg - (len2 - pos2) - (pos1 + 200)
        WHEN o1 = 0 AND o2 = 1 THEN avg - (len1 - pos1) - (len2 - pos2) ELSE avg - (pos1 + 200) - (pos2 + 200) END AS BIGINT) AS dist,
        o1 = 0 AS plus1, o2 = 1 AS plus2 FROM oriented""",
    "valid": "SELECT * FROM distanced WHERE ctg1 <> ctg2 AND dist > -2.5*std AND dist < avg + 2.5*std",
    "links": """SELECT *, least(n1, n2) AS c1, greatest(n1, n2) AS c2, n1 > n2 AS switched,
        CASE WHEN n1 > n2 THEN pos2 ELSE pos1 END AS p1, CASE WHEN n1 > n2 THEN pos1 ELSE pos2 END AS p2
        FROM (SELECT *, 2*ctg1 + CASE WHEN plus1 THEN 0 ELSE 1 END AS n1, 2*ctg2 + CASE WHEN plus2 THEN 0 ELSE 1 END AS n2 FROM valid)""",
    "ends": """SELECT lib, ctg1 AS ctgid, read_id, 2 AS w FROM distanced WHERE ctg1 = ctg2
        UNION ALL SELECT lib, unnest([ctg1, ctg2]), read_id, 1 FROM valid""",
}
