"""Text inputs as tables. File readers split records by separator, so a single large file is read by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled


def numbered(df: DataFrame, name: str = "idx", fixed: bool = False) -> tuple[DataFrame, int]:
    """(df with dense numbers from 0 in its order, its number of rows).

    Partition sizes become offsets; one count for each partition reaches the driver. The counting job must see the very partitions that are
    numbered, and adaptive execution cuts those anew for each plan: so the rows are written once with their partition and their place in
    it. `fixed` spares that for plain file scans, whose partitions follow from the files alone.
    """
    at = df.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__m"))
    at = at if fixed else settled(at, "numbered")
    offsets, total = [], 0
    for r in at.groupBy("__p").agg(F.count("*").alias("n")).orderBy("__p").collect():
        offsets.append((r["__p"], total))
        total += r["n"]
    first = df.sparkSession.createDataFrame(offsets or [(0, 0)], "__q int, __first long")  # a row for each partition
    return at.join(F.broadcast(first), F.col("__p") == F.col("__q")).select(*df.columns, (F.col("__first") + F.col("__m")).alias(name)), total


def dense_index(df: DataFrame, name: str = "idx", fixed: bool = False) -> DataFrame:
    """df with dense numbers from 0 in its order."""
    return numbered(df, name, fixed)[0]


def fasta_record(record):
    """Struct (name, seq) of the text of one record without its '>'; null if a sequence line holds a blank.

    The name ends at the first blank, lines are put together up to the first empty one.
    """
    lines = F.split(record, "\n")
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    end = F.array_position(body, "")
    body = F.when(end > 0, F.slice(body, F.lit(1), end.cast("int") - 1)).otherwise(body)
    seq = F.array_join(body, "")
    name = F.element_at(F.split(lines[0], " "), 1)
    return F.when(~seq.contains(" "), F.struct(name.alias("name"), seq.alias("seq")))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of the records of FASTA files. An unterminated last line isn't lost."""
    rows = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", "^>", "")
    return rows.select(fasta_record(record).alias("r")).filter("r IS NOT NULL AND r.name <> ''").select("r.*")


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Contigs with dense ids in file order and their two nodes."""
    c = dense_index(read_fasta(spark, path), "ctgid")
    return c.select("ctgid", "name", F.length("seq").alias("length"), "seq", (2 * F.col("ctgid")).alias("header"), (2 * F.col("ctgid") + 1).alias("tail"))


def read_long_reads(spark: SparkSession, path: str, needed: DataFrame) -> DataFrame:
    """(read_id, seq) of the needed reads; names begin with their number."""
    r = read_fasta(spark, path).select(F.regexp_extract("name", r"^\d+", 0).try_cast("long").alias("read_id"), "seq")
    return r.join(needed.select("read_id").distinct(), "read_id", "left_semi")


def read_name(name):
    """Struct (read_id, insert, start, gap_start, gap_end) of `<read>_FG_<insert>_<start>`."""
    p = F.split(name, "_")
    size, start = p[2].cast("long"), p[3].cast("long")
    return F.struct(p[0].cast("long").alias("read_id"), size.alias("insert"), start.alias("start"), (start + 200).alias("gap_start"), (start + size - 200).alias("gap_end"))


def sam_fields(line):
    """Struct (name, fwd, contig, pos, len) of an alignment line: the CIGAR's leading number is the length."""
    f = F.split(line, "\t")
    return F.struct(f[0].alias("name"), (f[1].cast("int").bitwiseAND(16) == 0).alias("fwd"), f[2].alias("contig"), f[3].cast("int").alias("pos"), F.regexp_extract(f[5], r"^\d+", 0).cast("int").alias("len"))


def sam_pairs(lines: DataFrame) -> DataFrame:
    """lines(idx, line), headers gone -> one row for each pair of consecutive records."""
    r = lines.select(F.expr("idx div 2").alias("pair_id"), (F.col("idx") % 2).alias("mate"), sam_fields(F.col("line")).alias("r"))
    both = r.groupBy("pair_id").agg(F.max(F.when(F.col("mate") == 0, F.col("r"))).alias("a"), F.max(F.when(F.col("mate") == 1, F.col("r"))).alias("b"))
    cols = [F.col(f"{m}.{c}").alias(f"{c}{i}") for i, m in ((1, "a"), (2, "b")) for c in ("name", "contig", "pos", "len", "fwd")]
    return both.filter("a IS NOT NULL AND b IS NOT NULL").select("pair_id", *cols)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The pairs of a SAM file."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("@")).select(F.col("value").alias("line"))
    return sam_pairs(dense_index(lines, fixed=True))


def library_line(line):
    """Struct (path, avg, std) of a library line with one to three columns; avg null: to be inferred."""
    c = F.split(line, "\t")
    avg = F.try_element_at(c, F.lit(2)).cast("int")
    return F.struct(c[0].alias("path"), avg.alias("avg"), F.coalesce(F.try_element_at(c, F.lit(3)).cast("int"), (avg * 0.1).cast("int")).alias("std"))


def ranked_libraries(libs: DataFrame) -> DataFrame:
    """Libraries by insert size, ranks from 0; a library list is a handful of rows."""
    return dense_index(libs.orderBy("avg", "path").coalesce(1), "rank")


def insert_size(pairs: DataFrame, most: int = 10_000) -> DataFrame:
    """avg and std of a library from its first pairs inside a contig."""
    first = pairs.filter("contig1 = contig2").orderBy("pair_id").limit(most)
    return first.agg(F.avg(F.abs(F.col("pos2") - F.col("pos1"))).cast("int").alias("avg")).select("avg", (F.col("avg") * 0.1).cast("int").alias("std"))


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="name string, coverage double")
