"""Token counts by a compiled finite-state transducer.

The tokenizer is compiled, as texts need it, into a deterministic transducer over characters. A state is what the future
can depend on: the last characters as far back as a piece may still be under way, and for each place where one may have
begun the last token before it and how many tokens fewer the encoding has there. A transition carries the number
of tokens that a further character adds (it may be negative, when tokens merge), so the sum along a run is the token
count of the text read so far. States are finite in number; those not in use may be dropped and compiled again.

Giant texts are counted in chunks by many tasks. A chunk's state map needs no outer state between its first and last
sure token border, where the transducer is back in its start state: it is (head, count, tail). Maps compose
associatively - the tail of one and the head of the next are run through the transducer - so a text's count is the
prefix scan's last value.

Defined results: null and empty texts have no tokens and no bytes; repeated rows are counted one by one; extra columns
pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_columns, no_cycles, text_key, while_busy, with_workers
from .pieces import _WORD, Memo, Pieces, Transducer, words_of
from .sentencepieces import model_bytes

GIANT, CHUNK = 60_000, 20_000
LIMIT = 4096


class Counter:
    """Counts tokens: a transducer, a memo of words, and the state maps of chunks."""

    def __init__(self, model: bytes):
        self.pieces = Pieces(model)
        self.run = Transducer(self.pieces).run
        self.memo = Memo(self.run, self.pieces.breaks)

    def count(self, text: str | None) -> int:
        return sum(map(self.memo.__getitem__, words_of(self.pieces, text))) if text else 0

    def chunk_map(self, part: str) -> tuple[str, int | None, str]:
        """(head, tokens between the first and the last sure border, tail); without a border (part, None, '')."""
        sure = self.pieces.breaks
        first = next((i for i in range(1, len(part)) if sure(part, i)), None)
        if first is None:
            return part, None, ""
        last = next(i for i in range(len(part) - 1, 0, -1) if sure(part, i))
        return part[:first], sum(self.memo["\x01" + w] for w in _WORD.findall(part[first:last])), part[last:]

    def composed(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring chunks."""
        if a[1] is None and b[1] is None:
            return a[0] + b[0], None, ""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.run(a[2] + b[0]) + b[1], b[2]

    def total(self, m: tuple) -> int:
        return self.run(m[0]) + (m[1] or 0) + self.run(m[2])

    def scanned(self, maps: list[tuple]) -> tuple:
        """All maps composed, neighbours first: as deep as the logarithm of their number."""
        while len(maps) > 1:
            maps = [self.composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]


def machine(model: bytes) -> Counter:
    """One counter for each worker and model, so that the memo outlives a task."""
    return while_busy(("counter", hash(model)), lambda: Counter(model))


def _giant_counts(docs: DataFrame, sent, giant: int, chunk: int) -> DataFrame:
    """(k1, k2, n_tokens) of the distinct texts with more than `giant` characters."""
    key = text_key(F.col("text"))
    texts = docs.filter(F.length("text") > giant).select(key["k1"].alias("k1"), key["k2"].alias("k2"), "text").dropDuplicates(["k1", "k2"])
    at = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int"))
    chunks = texts.select("k1", "k2", F.explode(F.transform(at, lambda i: F.struct(i.alias("no"), F.substring("text", i * chunk + 1, F.lit(chunk)).alias("part")))).alias("x"))
    chunks = chunks.select("k1", "k2", "x.no", "x.part").repartition("k1", "k2", "no")

    def maps(batches):
        m = machine(sent.value)
        mark = m.pieces.prefix
        for b in batches:
            out = []
            for r in b.to_pylist():
                part = r["part"].replace(" ", "▁")
                head, n, tail = m.chunk_map(mark + part if r["no"] == 0 else part)
                out.append({"k1": r["k1"], "k2": r["k2"], "no": r["no"], "head": head, "n": n, "tail": tail})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("no", pa.int32()), ("head", pa.string()), ("n", pa.int64()), ("tail", pa.string())]))

    mapped = chunks.mapInArrow(maps, "k1 long, k2 long, no int, head string, n long, tail string")

    def scan(rows):
        import pandas as pd

        rows = rows.sort_values("no")
        m = machine(sent.value)
        whole = m.scanned([(h, None if n is None or n != n else int(n), t) for h, n, t in zip(rows["head"], rows["n"], rows["tail"])])
        return pd.DataFrame({"k1": rows["k1"].iloc[:1], "k2": rows["k2"].iloc[:1], "n_tokens": [m.total(whole)]})

    return mapped.groupBy("k1", "k2").applyInPandas(scan, "k1 long, k2 long, n_tokens long")


def counted(docs: DataFrame, model: str | None = None, giant: int = GIANT, chunk: int = CHUNK, keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`, all by default) with n_tokens."""
    spark = docs.sparkSession
    with_workers(spark)
    keep = kept_columns(docs.columns if keep is None else keep, "n_tokens")
    sent = spark.sparkContext.broadcast(model_bytes(model))
    key = text_key(F.col("text"))
    docs = docs.select(*dict.fromkeys([*keep, "text"]))
    long_ = F.coalesce(F.length("text") > giant, F.lit(False))

    def run(batches):
        for b in batches:
            count = machine(sent.value).count  # still busy
            with no_cycles():
                n = np.fromiter(map(count, b.column("text").to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.select(keep).columns, pa.array(n)], [*keep, "n_tokens"])

    short = docs.filter(~long_).mapInArrow(run, T.StructType([*(docs.schema[k] for k in keep), T.StructField("n_tokens", T.LongType())]))
    long = docs.filter(long_).select(*keep, key["k1"].alias("__k1"), key["k2"].alias("__k2"))
    n = _giant_counts(docs.select("text"), sent, giant, chunk)
    n = n.select(F.col("k1").alias("__g1"), F.col("k2").alias("__g2"), F.col("n_tokens").alias("__n"))
    return short.unionByName(long.join(n, (F.col("__k1") == F.col("__g1")) & (F.col("__k2") == F.col("__g2"))).select(*keep, F.col("__n").alias("n_tokens")))


def digest(docs: DataFrame) -> DataFrame:
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return counted(sized, keep=["doc_id", "n_bytes"]).withColumn("over_limit", F.col("n_tokens") > LIMIT)
