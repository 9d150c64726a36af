"""Read support kept up to date: the batch sums of contig and edge support merge, so a stream of pairs can feed them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged_support(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sums of two support tables (keys..., hits)."""
    keys = [c for c in old.columns if c != "hits"]
    return old.unionByName(new).groupBy(*keys).agg(F.sum("hits").alias("hits"))


def running_support(ends: DataFrame) -> DataFrame:
    """For a streaming table of pair ends: hits of each read on each contig so far (output mode complete or update)."""
    return ends.groupBy("ctgid", "read_id").agg(F.sum("w").alias("hits"))
