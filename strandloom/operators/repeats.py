"""Repeat marking by contig coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ScaffoldConfig
from ..sources.readers import numbered


def _ranked(df: DataFrame, *order) -> tuple[DataFrame, int]:
    """(df with its rows' `rank` from 0 in an order, its number of rows): range partitions and their offsets, so no task holds a share of all rows."""
    return numbered(df.orderBy(*order), "rank")


def by_longest(contigs: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """repeat: coverage over rcn times the mean coverage of the longest tenth of the contigs with a coverage."""
    ranked, n = _ranked(contigs.filter("coverage IS NOT NULL").select("ctgid", "length", "coverage"), F.desc("length"), "ctgid")
    mean = ranked.filter(F.col("rank") < int(0.1 * n)).agg(F.avg("coverage").alias("mean"))
    return contigs.crossJoin(F.broadcast(mean)).select("ctgid", F.coalesce(F.col("coverage") > F.col("mean") * config.rcn, F.lit(False)).alias("repeat"))  # one row is broadcast


def by_reads(contigs: DataFrame, counts: DataFrame, config: ScaffoldConfig = DEFAULT) -> DataFrame:
    """cov = reads * 200 div length; repeat: over 4.5 times the mean of the covered contigs."""
    cov = contigs.join(counts, "ctgid", "left").select("ctgid", F.expr(f"coalesce(num_reads, 0) * {config.read_length} div length").alias("cov"))
    mean = cov.filter("cov > 0").agg(F.avg("cov").alias("mean"))
    return cov.crossJoin(F.broadcast(mean)).select("ctgid", "cov", F.coalesce(F.col("cov") > 4.5 * F.col("mean"), F.lit(False)).alias("repeat"))


def by_trimmed(contigs: DataFrame) -> DataFrame:
    """repeat: coverage over mean + 2.5 deviations + 0.5, both taken without the lowest and highest twentieth."""
    ranked, n = _ranked(contigs.filter("coverage IS NOT NULL").select("ctgid", "coverage"), "coverage", "ctgid")
    mid = ranked.filter((F.col("rank") >= int(0.05 * n)) & (F.col("rank") < n - int(0.05 * n)))
    stats = mid.agg(F.avg("coverage").alias("mean"), F.greatest(F.stddev_samp("coverage"), F.lit(1.0)).alias("dev"))
    return contigs.crossJoin(F.broadcast(stats)).select("ctgid", F.coalesce(F.col("coverage") > F.col("mean") + 2.5 * F.col("dev") + 0.5, F.lit(False)).alias("repeat"))
