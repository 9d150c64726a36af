"""Benchmark decontamination: a broadcast set of normalised benchmark windows is looked up over every document's words.

Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. A window is `window` consecutive words
of a benchmark item; an item with fewer words, but not none, is one window. A document word inside any occurrence of a
window is hit.

The windows are sent to the workers in blocks of at most `block_bytes` bytes as they are held there (a number of bytes for each word of an item, and for
each distinct word), so what is broadcast at once is
bounded whatever the benchmark's size; documents are scanned once for each block and the blocks' intervals are united
by document row. One block, the usual case, needs no shuffle at all.

Defined results: a null or wordless text has no words and no hits; repeated rows are judged one by one; windows of an
item without item_id count as hits, but list no item; an empty benchmark hits nothing; extra columns pass through, one with the name of a new column is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_columns, with_workers, written

WINDOW = 13
#: A broadcast block takes at most this many bytes of a worker; an item that is larger is a block of its own.
BLOCK_BYTES = 256_000_000
#: Bytes that a block holds for each word of its items (code, window hash, place, items, share of the first look's table), and for each distinct word beside its
#: characters (table and objects).
WORD_BYTES, TERM_BYTES = 44, 200
#: A document is contaminated if hits * MIN_SHARE_OF >= words.
MIN_SHARE_OF = 20

#: bytes -> bytes: A-Z lower-cased, what is no word character becomes a space.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class WindowSet:
    """The windows of a block of benchmark items as arrays: the items' words as codes one after the other, and for each length the distinct windows' hashes in
    order, each with a place where it begins and the list of items that hold it. A table over the hashes' upper bits, sized by the block, gives the first
    look; a hit is compared word by word, once for a window however many items share it, and its items are added once for a document."""

    def __init__(self, items: Iterable[tuple[object, str | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.items: list = []
        words, begins, sizes = [], [], []
        for item, text in items:
            code = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            if code:
                begins.append(len(words))
                sizes.append(len(code))
                self.items.append(item)
                words += code
        self.words = np.array(words, np.uint32)
        at, n_words = np.array(begins, np.int64), np.array(sizes, np.int64)
        width = np.minimum(n_words, window)
        self.hashes, self.places, self.first, self.owners, self.look, self.bits = {}, {}, {}, {}, {}, {}
        for n in sorted(set(width.tolist())):
            mine = np.flatnonzero(width == n)
            count = n_words[mine] - n + 1
            owner = np.repeat(mine, count)
            place = np.repeat(at[mine] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            h = self._hashed([self.words[place + k] for k in range(n)])
            order = np.lexsort((owner, h))
            h, place, owner = h[order], place[order], owner[order].astype(np.int32)
            # Neighbours of one hash are one window if their words are the same; other windows of that hash follow as entries of their own.
            same = np.concatenate(([False], h[1:] == h[:-1]))
            for k in range(n):
                same[1:] &= self.words[place[1:] + k] == self.words[place[:-1] + k]
            first = np.flatnonzero(~same)
            self.hashes[n], self.places[n], self.owners[n] = h[first], place[first], owner
            self.first[n] = np.append(first, len(h))
            self.bits[n] = min(26, max(16, int(4 * len(first)).bit_length()))
            self.look[n] = np.zeros(1 << self.bits[n], bool)
            self.look[n][self._slots(h[first], self.bits[n])] = True
        self.lengths = sorted(self.hashes)

    @staticmethod
    def _hashed(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        with np.errstate(over="ignore"):
            for c in columns:
                h = (h + c.astype(np.uint64)) * _BASE
                h ^= h >> np.uint64(29)
        return h

    @staticmethod
    def _slots(h: np.ndarray, bits: int) -> np.ndarray:
        return (h >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word intervals [start, end) of verified windows, and the items they belong to."""
        get = self.ids.get
        code = np.fromiter((get(w, 0) for w in words), np.uint32, len(words))
        unknown = np.flatnonzero(code == 0)
        spans, items = [], set()
        for n in self.lengths:
            m = len(code) - n + 1
            if m <= 0:
                continue
            free = self._free_starts(unknown, len(code), n)
            if not len(free):
                continue
            h = self._hashed([code[free + k] for k in range(n)])
            seen = np.flatnonzero(self.look[n][self._slots(h, self.bits[n])])
            if not len(seen):
                continue
            known, place, found = self.hashes[n], self.places[n], set()
            low, high = np.searchsorted(known, h[seen]), np.searchsorted(known, h[seen], "right")
            for k, a, b in zip(seen.tolist(), low.tolist(), high.tolist()):
                if a == b:
                    continue
                i = int(free[k])
                held = code[i : i + n]
                hit = [j for j in range(a, b) if (self.words[place[j] : place[j] + n] == held).all()]
                if hit:
                    spans.append((i, i + n))
                    found.update(hit)
            for j in found:
                items.update(self.items[o] for o in np.unique(self.owners[n][self.first[n][j] : self.first[n][j + 1]]).tolist())
        return spans, items

    @staticmethod
    def _free_starts(unknown: np.ndarray, size: int, n: int) -> np.ndarray:
        """Starts of the runs of n words that are all in the benchmark's vocabulary."""
        edges = np.concatenate(([-1], unknown, [size]))
        room = np.diff(edges) - n  # a run of r words has r - n + 1 starts; here r = diff - 1
        big = np.flatnonzero(room > 0)
        if not len(big):
            return big
        first, count = edges[big] + 1, room[big]
        return np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark in blocks of bounded size, streamed partition by partition."""
    block, terms, size = [], set(), 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), F.col("text")).toLocalIterator():
        words = words_of(text)
        new = set(words) - terms
        more = WORD_BYTES * len(words) + sum(TERM_BYTES + len(w) for w in new)
        if block and size + more > block_bytes:
            yield block
            block, terms, size = [], set(), 0
            new = set(words)
            more = WORD_BYTES * len(words) + sum(TERM_BYTES + len(w) for w in new)
        block.append((item, text))
        terms |= new
        size += more
    yield block


def _sent(docs: DataFrame, block: list, window: int):
    return docs.sparkSession.sparkContext.broadcast(WindowSet(block, window))


def _scan(docs: DataFrame, at: str, sent) -> DataFrame:
    """docs with column `at`: words, hit intervals and hit items of one block that was sent."""

    def run(batches):
        find = sent.value.find
        for batch in batches:
            n, spans, items = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                s, i = find(words)
                n.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in merged(s)])
                items.append(sorted(x for x in i if x is not None))
            hits = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(items, pa.list_(pa.string()))], ["n_words", "spans", "items"])
            yield pa.RecordBatch.from_arrays([*batch.columns, hits], [*batch.schema.names, at])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(at, _HITS)]))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int | None = None, at: str = "hits", keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (its columns `keep`, all by default) with struct column `at`: n_words, spans (word intervals), items.

    block_words: the block's bound as a number of words, each of them distinct at worst.
    """
    with_workers(docs.sparkSession)
    keep = kept_columns(keep or docs.columns, at)
    docs = docs.select(*dict.fromkeys([*keep, "text"]))
    blocks = iter(_blocks(benchmark, block_bytes if block_words is None else block_words * (WORD_BYTES + TERM_BYTES)))
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _scan(docs, at, _sent(docs, first, window)).select(*keep, at)
    # More than one block: rows get a number that holds over recomputation, and the intervals are united by it.
    docs = written(docs.withColumn("__row", F.monotonically_increasing_id()), "decontam-rows")
    parts = []
    for block in chain([first, second], blocks):
        sent = _sent(docs, block, window)
        parts.append(written(_scan(docs.select("__row", "text"), at, sent).select("__row", at), "decontam-hits"))
        sent.destroy()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    one = every.groupBy("__row").agg(
        F.max(f"{at}.n_words").alias("n_words"),
        F.flatten(F.collect_list(f"{at}.spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{at}.items")))).alias("items"),
    )
    return docs.join(one, "__row").select(*keep, F.struct("n_words", merged_spans(F.col("spans")).alias("spans"), "items").alias(at))


def merged_spans(spans):
    """Sorted union of intervals, as an expression."""
    zero = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def put(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        return F.when(
            (F.size(acc) > 0) & (x["start"] <= last["end"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), zero, put)


def n_hit(hits):
    return F.aggregate(hits["spans"], F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])


def contaminated(hits):
    return (n_hit(hits) > 0) & (F.lit(MIN_SHARE_OF) * n_hit(hits) >= hits["n_words"])


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    hits = F.col("hits")
    return find_hits(docs, benchmark, keep=["doc_id"]).select(
        "doc_id",
        hits["n_words"].alias("n_words"),
        n_hit(hits).alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"),
        contaminated(hits).alias("contaminated"),
    )


def removed_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    return find_hits(docs, benchmark, at="__hits").filter(~contaminated(F.col("__hits"))).drop("__hits")


def cut_spans(text: str | None, spans: Iterable[tuple[int, int]]) -> str | None:
    """text without the characters from the first to the last word of each interval."""
    if not text or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    fold = np.frombuffer(raw.translate(_FOLD), np.uint8) != 0x20
    edge = np.diff(np.concatenate(([0], fold.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : start[a]])
        at = end[b - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def removed_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents, their hit spans cut out of the text."""
    found = find_hits(docs, benchmark, at="__hits")
    cut = F.pandas_udf(lambda t, s: _cut_series(t, s), T.StringType())
    return found.withColumn("text", F.when(F.size("__hits.spans") > 0, cut("text", "__hits.spans")).otherwise(F.col("text"))).drop("__hits")


def _cut_series(texts, spans):
    import pandas as pd

    return pd.Series([cut_spans(t, [(x["start"], x["end"]) for x in s] if s is not None else []) for t, s in zip(texts, spans)], dtype=object)


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract's rows, one window comparison at a time; for tests."""
    coded = [(str(i), words_of(t)) for i, t in items]
    out = []
    for doc_id, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, w in coded:
            size = min(window, len(w))
            wins = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
            for i in range(len(words) - size + 1 if size else 0):
                if tuple(words[i : i + size]) in wins:
                    hit |= set(range(i, i + size))
                    found.add(item)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), sha, bool(hit) and MIN_SHARE_OF * len(hit) >= len(words)))
    return out


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT r, i, bw.n AS n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""
