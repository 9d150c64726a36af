"""Running sums and neighbours along an order, in two levels, so that no task holds a whole group.

Rows are binned by their order (a whole number, distinct within a group): a window sorts one bin of a group, and a second one runs over the group's bins,
a row each. Bins hold BIN rows at most; a group of a billion rows has some fifteen thousand of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 65_536


def _binned(rows: DataFrame, order: str) -> DataFrame:
    return rows.withColumn("__bin", F.expr(f"`{order}` div {BIN}"))


def _with_bins(rows: DataFrame, group: str, bins: DataFrame, name: str) -> DataFrame:
    """rows with the bins' column __far of their own bin."""
    b = bins.select(F.col(group).alias("__g"), F.col("__bin").alias("__b"), "__far")
    return rows.join(b, (F.col(group) == F.col("__g")) & (F.col("__bin") == F.col("__b"))).drop("__g", "__b")


def running_sum(rows: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """rows with `name`: the sum of value over the group's rows up to this one, itself included."""
    near = _binned(rows.withColumn("__v", value), order)
    local = Window.partitionBy(group, "__bin").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = near.groupBy(group, "__bin").agg(F.sum("__v").alias("__s"))
    before = Window.partitionBy(group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "__bin", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__far"))
    out = _with_bins(near.withColumn("__near", F.sum("__v").over(local)), group, sums, name)
    return out.withColumn(name, F.col("__near") + F.col("__far")).drop("__v", "__near", "__far", "__bin")


def neighbour(rows: DataFrame, group: str, order: str, value: str, name: str, ahead: bool) -> DataFrame:
    """rows with `name`: the value of the group's next row (ahead) or the one before, null if there is none; value isn't null."""
    near = _binned(rows, order)
    local, over_bins = Window.partitionBy(group, "__bin").orderBy(order), Window.partitionBy(group).orderBy("__bin")
    if ahead:
        bins = near.groupBy(group, "__bin").agg(F.min_by(value, order).alias("__v")).withColumn("__far", F.lead("__v").over(over_bins))
        found = F.lead(value).over(local)
    else:
        bins = near.groupBy(group, "__bin").agg(F.max_by(value, order).alias("__v")).withColumn("__far", F.lag("__v").over(over_bins))
        found = F.lag(value).over(local)
    out = _with_bins(near.withColumn("__near", found), group, bins, name)
    return out.withColumn(name, F.coalesce("__near", "__far")).drop("__near", "__far", "__bin")


def shifted(rows: DataFrame, group: str, order: str, value: str, names: dict[str, int]) -> DataFrame:
    """(group, order, value, names...): the values at order + shift of each name, for rows of dense order; one shuffle, no window."""
    sent = [F.struct(F.lit(n).alias("n"), (F.col(order) - by).alias("at"), F.col(value).alias("v")) for n, by in {value: 0, **names}.items()]
    told = rows.select(group, F.explode(F.array(*sent)).alias("x")).groupBy(group, F.col("x.at").alias(order))
    of = lambda n: F.max(F.when(F.col("x.n") == n, F.col("x.v"))).alias(n)
    return told.agg(*[of(n) for n in (value, *names)]).filter(F.col(value).isNotNull())
