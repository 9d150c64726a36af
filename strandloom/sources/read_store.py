"""Reads in the order of their first use, packed, in a Parquet store that lookups prune.

The store has two tables. `reads` holds (part, place, read_id, read): dense places in the caller's order, cut into parts of PART reads, a folder each; a part is sorted by place
and written by one task. `ids` holds (shard, read_id, place), a folder for each hash shard of the ids, sorted by id. A lookup of a few ids reads
the shards of these ids, then only the parts that hold their places, and in these the row groups whose bounds match. A lookup of many ids is a join on
(shard, read_id) and (part, place), whose folders are pruned by what the other side asks for.

Defined results: reads without a place aren't stored; ids that aren't stored are left out; an id asked for twice is answered twice; a read_id that occurs twice in
the order keeps its first place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import packed
from ..session import settled
from .readers import numbered

#: Reads of a part, and shards of the ids for each part.
PART = 65_536
#: Ids that one lookup by literals takes.
MOST_IDS = 10_000


def write_store(reads: DataFrame, first_use: DataFrame, path: str, part: int = PART) -> ReadStore:
    """reads(read_id, seq), first_use(read_id, rank) with an orderable rank -> the store below path."""
    spark = reads.sparkSession
    least = first_use.groupBy("read_id").agg(F.min("rank").alias("rank"))
    wanted = least.join(reads.select("read_id"), "read_id", "left_semi").orderBy("rank", "read_id").select("read_id")
    order, total = numbered(wanted, "place")
    order = settled(order, "read-places")
    parts = max(1, -(-total // part))
    placed = order.join(reads.select("read_id", packed.pack(F.col("seq")).alias("read")), "read_id").withColumn("part", F.expr(f"place div {part}"))
    # Dealt by part, so a part is one task's and one file.
    placed.repartition(min(parts, 10_000), "part").sortWithinPartitions("part", "place").write.partitionBy("part").parquet(f"{path}/reads")
    shard = F.pmod(F.xxhash64("read_id"), F.lit(parts)).cast("int").alias("shard")
    ids = order.select("read_id", "place", shard)
    ids.repartition(min(parts, 10_000), "shard").sortWithinPartitions("shard", "read_id").write.partitionBy("shard").parquet(f"{path}/ids")
    spark.createDataFrame([(part, parts)], "part long, parts long").coalesce(1).write.parquet(f"{path}/about")
    return ReadStore(spark, path)


class ReadStore:
    """A store that write_store() wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.part, self.parts = spark.read.parquet(f"{path}/about").first()
        self.ids, self.reads = spark.read.parquet(f"{path}/ids"), spark.read.parquet(f"{path}/reads")

    def _shard(self):
        return F.pmod(F.xxhash64("read_id"), F.lit(self.parts)).cast("int")

    def places(self, ids: list[int]) -> DataFrame:
        """(read_id, place) of a bounded list of ids, from their shards alone."""
        if len(ids) > MOST_IDS:
            raise ValueError(f"over {MOST_IDS} ids; join them as a table by fetch()")
        spark = self.ids.sparkSession
        asked = spark.createDataFrame([(i,) for i in ids] or [(None,)], "read_id long")
        shards = [r[0] for r in asked.select(self._shard().alias("shard")).distinct().collect()]
        return self.ids.filter(F.col("shard").isin(shards) & F.col("read_id").isin(list(ids))).select("read_id", "place")

    def at(self, places: list[int]) -> DataFrame:
        """(read_id, place, seq) at a bounded list of places: only their parts and row groups are read."""
        if len(places) > MOST_IDS:
            raise ValueError(f"over {MOST_IDS} places; join them as a table")
        low, high = (min(places), max(places)) if places else (0, -1)
        rows = self.reads.filter(F.col("part").isin(sorted({p // self.part for p in places})) & F.col("place").between(low, high) & F.col("place").isin(list(places)))
        return rows.select("read_id", "place", packed.unpacked(F.col("read")).alias("seq"))

    def lookup(self, ids: list[int]) -> DataFrame:
        """(read_id, place, seq) of a bounded list of ids."""
        return self.at([r["place"] for r in self.places(ids).collect()])

    def between(self, start: int, stop: int) -> DataFrame:
        """The reads of the places start <= place < stop, in order within a file."""
        rows = self.reads.filter(F.col("part").between(start // self.part, max(start, stop - 1) // self.part) & (F.col("place") >= start) & (F.col("place") < stop))
        return rows.select("read_id", "place", packed.unpacked(F.col("read")).alias("seq"))

    def fetch(self, asked: DataFrame) -> DataFrame:
        """asked(read_id, ...) with place and seq, for any number of rows."""
        found = asked.withColumn("__shard", self._shard()).join(self.ids.select(F.col("shard").alias("__shard"), "read_id", "place"), ["__shard", "read_id"]).drop("__shard")
        found = found.withColumn("__part", F.expr(f"place div {self.part}"))
        rows = self.reads.select(F.col("part").cast("long").alias("__part"), "place", "read")
        return found.join(rows, ["__part", "place"]).select(*asked.columns, "place", packed.unpacked(F.col("read")).alias("seq"))
