"""Joins that a few keys would overload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled

#: looked_up(): a key that more than one in SHARE_OF rows ask for is hot, if there are over HOT_ROWS such rows.
SHARE_OF, HOT_ROWS = 10_000, 200_000
#: likely(): bits of its table (4 MB), and of a row of it, which is what bitmap_construct_agg makes.
LIKELY_BITS, ROW_BITS = 1 << 25, 1 << 15


def looked_up(asked: DataFrame, answers: DataFrame, keys: list[str], how: str = "inner", hot_rows: int = HOT_ROWS, asked_by: DataFrame | None = None) -> DataFrame:
    """asked joined with answers(keys..., unique) where some keys may be asked for by a large part of all rows.

    Hot keys are those asked for by more than hot_rows rows and more than one in SHARE_OF of all such rows, so there are at most SHARE_OF of them: their
    answers are broadcast and the rows that ask for them stay where they are. No other key can fill a task of the shuffle.
    asked_by(keys..., __asked): how often each key is asked for, if that is known.
    """
    counts = asked.groupBy(*keys).agg(F.count("*").alias("__asked")) if asked_by is None else asked_by
    often = settled(counts.filter(F.col("__asked") > hot_rows), "asked-keys")
    total = often.agg(F.sum("__asked")).first()[0]
    if total is None:
        return asked.join(answers, keys, how)
    hot = often.filter(F.col("__asked") > total / SHARE_OF).select(*keys)
    hot_answers = F.broadcast(hot.join(answers, keys, "left" if how == "left" else "inner"))
    cold = asked.join(F.broadcast(hot), keys, "left_anti").join(answers, keys, how)
    return asked.join(hot_answers, keys).unionByName(cold)


def likely(rows: DataFrame, hash_, asked: DataFrame, asked_hash) -> DataFrame:
    """rows with `__likely`, which is false only where no row of asked has the same hash: a mixed long, null nowhere.

    One bit stands for many hashes, so an exact join must follow; but only the rows that it marks need to be shuffled for that. The table of bits that is
    broadcast has LIKELY_BITS, however many rows are asked for.
    """
    bit = lambda h: h.bitwiseAND(F.lit(LIKELY_BITS - 1))
    part, at = lambda h: F.shiftright(bit(h), ROW_BITS.bit_length() - 1), lambda h: h.bitwiseAND(F.lit(ROW_BITS - 1))
    # Dealt by part first: longs are shuffled, not a row of bits for each task and part.
    dealt = asked.select(part(asked_hash).alias("__part"), at(asked_hash).alias("__at")).repartition("__part")
    bits = dealt.groupBy("__part").agg(F.bitmap_construct_agg("__at").alias("__bits"))
    met = rows.withColumn("__h", hash_).join(F.broadcast(bits), part(F.col("__h")) == F.col("__part"), "left")
    byte = F.conv(F.hex(F.substring("__bits", (F.shiftright(at(F.col("__h")), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    set_ = byte.bitwiseAND(F.get(F.array(*[F.lit(1 << i) for i in range(8)]), F.col("__h").bitwiseAND(F.lit(7)).cast("int"))) > 0
    return met.select(*rows.columns, F.coalesce(set_, F.lit(False)).alias("__likely"))
