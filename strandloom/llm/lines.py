"""Lines of documents, as DataFrame expressions: what the line rules have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS_CLASS, text_key


def normalised(line):
    """Lower case, white space collapsed to one space and trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), f"{WS_CLASS}+", " "))


def lines_of(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each line with a word: k1, k2 (the text's key), keep..., pos, chars, norm, h1, h2 (the line's 128-bit hash)."""
    return (
        docs.select(text_key(F.col("text")).alias("k"), *keep, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("k.k1", "k.k2", *keep, "pos", F.length("line").alias("chars"), normalised("line").alias("norm"))
        .filter("norm <> ''")
        .withColumns({"h1": F.xxhash64("norm"), "h2": F.xxhash64(F.lit(0x2545F491), "norm")})
    )


def without_positions(text, positions):
    """text without its lines at these positions; null positions: unchanged. The positions are hashed once, so a long text with many stays linear."""
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), positions)
    return F.when(F.size(positions) > 0, F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")).otherwise(text)
