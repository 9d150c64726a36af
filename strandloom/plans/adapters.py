"""Driver tables as scaffolding inputs: a linkage graph from supplier and lineitem, sequences from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import sequence_of
from ..session import dealt, guarded

GAP = 500
READ = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    guarded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _length(i):
    return F.lit(5000) + (i * 37 % 11) * 20


def _rounded(x):
    """round(x) half away from zero, without the decimals that Spark's round makes of each double."""
    a = F.abs(x)
    return F.signum(x) * (F.floor(a) + F.when(a - F.floor(a) >= 0.5, 1).otherwise(0))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs on a circle in id order; each third one is stored reversed."""
    i = F.col("ctgid")
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ctgid"))
    return base.select(
        i, F.concat(F.lit("ctg"), i).alias("name"), _length(i).cast("int").alias("length"),
        (2 * i).alias("header"), (2 * i + 1).alias("tail"), (i % 3 == 0).alias("flip"),
        F.when(i % 17 == 5, 40).otherwise(10 + i % 5).cast("double").alias("coverage"),
    )


def libraries(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES (0, 2000, 200), (1, 8000, 800), (2, 14000, 1400) AS t(lib, avg, std)")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per mate pair: lib, avg, std, read_id, gap_start, gap_end, and contig, position and strand of both mates."""
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n_ctg"))
    l = dealt(table(spark, sf_dir, "lineitem")).crossJoin(F.broadcast(n))  # n is one row  # noqa: E741
    c = F.col("n_ctg")
    o, st = F.col("l_linenumber") % 3, F.lit(1) + F.col("l_partkey") % 3
    p = l.select("*", o.alias("o"), st.alias("st")).filter(F.col("o") + F.col("st") <= 3)
    p = p.select(
        "*", ((F.col("l_suppkey") + F.col("o")) % c).alias("a"), ((F.col("l_suppkey") + F.col("o") + F.col("st")) % c).alias("b"),
        (F.col("l_suppkey") * 8 + F.col("l_orderkey") % 8).alias("read_id"), (F.col("st") - 1).cast("int").alias("lib"),
    )
    p = p.join(F.broadcast(libraries(spark)), "lib")
    between = F.when(F.col("st") >= 2, _length((F.col("a") + 1) % c)).otherwise(0) + F.when(F.col("st") == 3, _length((F.col("a") + 2) % c)).otherwise(0)
    noise = F.floor((F.col("l_quantity") - 25) * F.col("std") / 25) + F.when(_rounded(F.col("l_discount") * 100) == 10, 5 * F.col("std")).otherwise(0)
    p = p.withColumns({"dist": GAP * F.col("st") + between + noise, "q2": (_rounded(F.col("l_extendedprice") * 100) % 200).cast("long"), "la": _length(F.col("a")), "lb": _length(F.col("b"))})
    p = p.withColumn("q1", F.col("la") - (F.col("avg") - F.col("dist") - (F.col("q2") + READ))).filter(F.col("q1").between(0, F.col("la") - READ))

    def placed(i, q, length, fwd):
        flip = i % 3 == 0
        return F.when(flip, length - q - READ).otherwise(q).cast("int"), F.when(flip, F.lit(not fwd)).otherwise(F.lit(fwd))

    p1, f1 = placed(F.col("a"), F.col("q1"), F.col("la"), True)
    p2, f2 = placed(F.col("b"), F.col("q2"), F.col("lb"), False)
    return p.select(
        "lib", "avg", "std", "read_id", F.lit(READ).alias("gap_start"), (F.col("avg") - READ).alias("gap_end"),
        F.concat(F.lit("ctg"), F.col("a")).alias("name1"), p1.alias("pos1"), f1.alias("fwd1"),
        F.concat(F.lit("ctg"), F.col("b")).alias("name2"), p2.alias("pos2"), f2.alias("fwd2"),
    )


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq): every document's whole text as a sequence; one without letters is empty."""
    return dealt(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), sequence_of(F.coalesce("text", F.lit(""))).alias("seq"))


#: The same adapters as DuckDB views, for the oracle; each names the ones it builds on by using them.
VIEWS = {
    "contigs": """SELECT s_suppkey AS ctgid, 'ctg' || s_suppkey AS name, CAST(5000 + (s_suppkey*37 % 11)*20 AS INT) AS length,
        2*s_suppkey AS header, 2*s_suppkey+1 AS tail, s_suppkey % 3 = 0 AS flip,
        CAST(CASE WHEN s_suppkey % 17 = 5 THEN 40 ELSE 10 + s_suppkey % 5 END AS DOUBLE) AS coverage FROM supplier""",
    "libs": "SELECT * FROM (VALUES (0, 2000, 200), (1, 8000, 800), (2, 14000, 1400)) t(lib, avg, std)",
    "pairs0": """SELECT l.*, o, st, n, (l_suppkey+o) % n AS a, (l_suppkey+o+st) % n AS b, l_suppkey*8 + l_orderkey % 8 AS read_id, lib, avg, std
        FROM (SELECT *, l_linenumber % 3 AS o, 1 + l_partkey % 3 AS st FROM lineitem) l CROSS JOIN (SELECT count(*) AS n FROM supplier)
        JOIN libs ON lib = st - 1 WHERE o + st <= 3""",
    "pairs1": """SELECT *, CAST(5000 + (a*37 % 11)*20 AS BIGINT) AS la, CAST(5000 + (b*37 % 11)*20 AS BIGINT) AS lb,
        CAST(round(l_extendedprice*100) AS BIGINT) % 200 AS q2,
        500*st + CASE WHEN st >= 2 THEN 5000 + (((a+1) % n)*37 % 11)*20 ELSE 0 END + CASE WHEN st = 3 THEN 5000 + (((a+2) % n)*37 % 11)*20 ELSE 0 END
        + CAST(floor((l_quantity-25)*std/25) AS BIGINT) + CASE WHEN round(l_discount*100) = 10 THEN 5*std ELSE 0 END AS true_dist FROM pairs0""",
    "alignments": """SELECT lib, avg, std, read_id, 200 AS gap_start, avg - 200 AS gap_end,
        'ctg' || a AS name1, CASE WHEN a % 3 = 0 THEN la - q1 - 200 ELSE q1 END AS pos1, a % 3 <> 0 AS fwd1,
        'ctg' || b AS name2, CASE WHEN b % 3 = 0 THEN lb - q2 - 200 ELSE q2 END AS pos2, b % 3 = 0 AS fwd2
        FROM (SELECT *, la - (avg - true_dist - (q2 + 200)) AS q1 FROM pairs1) WHERE q1 BETWEEN 0 AND la - 200""",
    "seqs": """SELECT doc_id AS id, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents""",
}
