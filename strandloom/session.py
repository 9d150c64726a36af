"""Session settings that the plans rely on, and tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def guarded(spark: SparkSession) -> SparkSession:
    """Turns off the partitioning that Spark 4.1 claims for unions of alike children.

    With adaptive execution such a union may be zipped with a side of another partition count: "Can't zip RDDs with unequal numbers of
    partitions", or rows that miss their partners.

    HotSpot never compiles a method of over 8000 bytes: a stage whose generated method would be larger is run operator by operator instead, each of
    which is compiled.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def dealt(table: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores, such as a single file of one row group, which one task reads, is dealt over all cores; any other is left as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local session (one machine, as in tests) gets a temporary folder; on a
    cluster that is an error, since executors would each write to their own disk."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="strandloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df with its lineage cut: written to the shared folder of the session and read back. Later uses don't recompute it, and a lost
    executor loses nothing."""
    spark = guarded(df.sparkSession)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["settled_at"] = path
    return out


#: What a join in a loop of rounds may send through the driver, by Spark's estimate.
ROUND_BROADCAST = 1 << 20


@contextmanager
def rounds(spark: SparkSession) -> Iterator[None]:
    """For loops of joins on settled tables: only tables of up to ROUND_BROADCAST bytes are broadcast by Spark's own choice.

    A loop of a hundred joins would else send up to a hundred times Spark's threshold (10 MB) through the driver. What is read within must
    be settled before, since a plan made within is bound by this from its scans on; what is returned unsettled isn't.
    """
    keys = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k, None) for k in keys}
    bytes_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    try:
        for k in keys:
            # The default, if it isn't set. In a session with a lower threshold, or none (negative), that one holds.
            now = spark.conf.get(k)
            if now and not now.startswith("-") and bytes_of(now) > ROUND_BROADCAST:
                spark.conf.set(k, str(ROUND_BROADCAST))
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def dropped(*tables: DataFrame | None) -> None:
    """Removes settled tables that nothing reads any more, such as those of a round that is over; other tables are left alone."""
    for t in tables:
        path = None if t is None else t.__dict__.pop("settled_at", None)
        if path:
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
