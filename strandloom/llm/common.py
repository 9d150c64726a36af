"""Helpers shared by the corpus operators: table access, shared scratch tables, worker set-up."""

from __future__ import annotations

import gc
import os
import threading
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import likely, looked_up  # noqa: F401
from ..session import dealt, dropped, guarded  # noqa: F401
from ..session import settled as written  # noqa: F401

REPO_ROOT = str(Path(__file__).resolve().parents[2])

#: Java's class of the white space that separates words in the contracts: space and \t to \r.
WS_CLASS = r"[\x20\x09-\x0D]"
NON_WS_CLASS = r"[^\x20\x09-\x0D]"

#: Rows of an Arrow batch.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def kept_columns(columns: list[str], *new: str | None) -> list[str]:
    """The input's columns that stay beside new ones: one that has the name of a new column is replaced by it."""
    return [c for c in columns if c not in new]


def with_workers(spark: SparkSession) -> None:
    """Settings for Python stages: small Arrow batches, since rows are whole texts and are held on both sides, and workers that can
    import this package when the session was started from another folder."""
    guarded(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if REPO_ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO_ROOT, have) if x)


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_key(col):
    """128 bits that stand for a whole text; equal texts share them, and a null text has its own."""
    return F.struct(
        F.xxhash64(col).alias("k1"),
        F.xxhash64(F.lit(0x5DEECE66D), col, F.length(col)).alias("k2"),
    )


_KEPT: dict = {}
_TIMER: list[threading.Timer] = []


def while_busy(key, make, seconds: float = 5.0):
    """make()'s value, kept in this worker for its next tasks; dropped when nobody has asked for that long.

    Workers are reused by later stages, which need the memory of a large memo for themselves.
    """
    if key not in _KEPT:
        _KEPT[key] = make()
    for t in _TIMER:
        t.cancel()
    _TIMER[:] = [threading.Timer(seconds, _KEPT.clear)]
    _TIMER[0].daemon = True
    _TIMER[0].start()
    return _KEPT[key]


@contextmanager
def no_cycles():
    """Without the collector of reference cycles: memos of many tuples have none, and looking for them takes a tenth of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def sliced(batch, rows: int = 256):
    """An Arrow batch in slices, so that what Python holds of it at once is small."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
