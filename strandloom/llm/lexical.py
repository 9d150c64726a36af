"""Ranked lexical search over compressed postings, in shards of documents.

Index: a task reads its documents and closes a shard whenever enough words or documents are gathered. A shard's documents are sorted by doc_id and
numbered; for each term the shard has one row with its postings, gaps between document numbers and term frequencies as variable-length
integers, and one row without term holds the documents' ids and lengths. Shards are independent, so the index is built without a
shuffle, and no shard grows with a hot source, a frequent term or the table.

Search: only the postings of terms that are asked for are shuffled, by shard. In a shard each query merges its k postings document at a time: a heap holds each
term's next document, the terms whose next document lies in the foremost window of numbers add their part to that window's scores, and move on.
Documents are so finished in ascending doc_id; a result heap of bounded size, keyed by score and then doc_id, takes those above its least. A task
keeps one result heap for each query over all of its shards; the heaps of all tasks are merged at last. Queries come in blocks of bounded
terms, each a broadcast and a pass over the index, so any number of queries can be asked.

Defined results: a null, empty or termless text is no document; a query without terms, or with none that occurs, has no results; every row of documents is a document
and every row of queries a query of its own, repeated ids included; a null doc_id comes after all others in ties; a null id of a query
stays null; empty tables give an empty result; other columns are not looked at. Ids of documents are whole numbers of 64 bits.
"""

from __future__ import annotations

import re
from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, sliced, with_workers, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 50
#: A shard is closed when it holds this many words, or documents.
SHARD_WORDS, SHARD_DOCS = 1 << 21, 1 << 16
#: Terms and queries of a block of queries.
BLOCK_TERMS, BLOCK_QUERIES = 100_000, 2_000
#: Document numbers whose scores are summed up together.
WINDOW = 1 << 13

_TERM = re.compile(TERM.encode())
_INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n_docs", pa.int64()), ("n_words", pa.int64()), ("body", pa.binary())])
_U = np.uint64


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of 64 bits as bytes of seven bits each, the last one below 128; and where each ends."""
    values = values.astype(_U)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= _U(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        more = np.flatnonzero(size > k)
        out[(ends - size)[more] + k] = ((values[more] >> _U(7 * k)) & _U(127)).astype(np.uint8) | ((size[more] > k + 1) * 128).astype(np.uint8)
    return out, ends


def unpacked(body: bytes) -> np.ndarray:
    """packed() undone, as unsigned numbers."""
    b = np.frombuffer(body, np.uint8)
    if not len(b):
        return np.zeros(0, _U)
    ends = np.flatnonzero(b < 128) + 1
    starts = np.concatenate(([0], ends[:-1]))
    place = np.arange(len(b)) - np.repeat(starts, ends - starts)
    return np.add.reduceat((b & 127).astype(_U) << (7 * place).astype(_U), starts)


class _Codes(dict):
    """Numbers for terms in order of appearance."""

    def __missing__(self, term):
        code = self[term] = len(self)
        return code


class _Shard:
    """The documents that a task gathers for its next shard."""

    def __init__(self):
        self.codes, self.words, self.ids, self.n, self.held = _Codes(), [], [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        words = _TERM.findall(text.lower())
        if words:
            self.words.append(np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words)))
            self.ids.append(doc_id)
            self.n.append(len(words))
            self.held += len(words)

    def rows(self, shard: int) -> pa.RecordBatch:
        n_docs, null = len(self.ids), [i is None for i in self.ids]
        order = np.lexsort((np.array([i or 0 for i in self.ids], np.int64), np.array(null)))
        number = np.empty(n_docs, np.int64)
        number[order] = np.arange(n_docs)
        n = np.array(self.n, np.int64)
        keys = np.concatenate(self.words).astype(np.int64) * n_docs + np.repeat(number, n)
        keys.sort()
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        tf = np.diff(np.append(first, len(keys)))
        term, doc = np.divmod(keys[first], n_docs)
        start = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        gap = doc - np.concatenate(([0], doc[:-1]))
        gap[start] = doc[start]
        body, ends = packed(np.stack((gap, tf), 1).ravel())
        df = np.diff(np.append(start, len(term)))
        cuts = np.concatenate(([0], ends[2 * np.append(start[1:], len(term)) - 1]))
        bodies = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(body)])
        terms = pa.array(list(self.codes), pa.binary()).cast(pa.string())
        # Ids as gaps modulo 2^64, so negative ones pass as well; how many are null comes first.
        ids = np.array([self.ids[i] or 0 for i in order], np.int64).view(_U)
        docs = packed(np.concatenate((np.array([sum(null)], _U), np.stack((ids - np.concatenate((np.zeros(1, _U), ids[:-1])), n[order].view(_U)), 1).ravel())))[0]
        m = len(start)
        one = lambda values, head, kind: pa.concat_arrays([pa.array([head], kind), values])
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(m + 1, shard)), one(terms, None, pa.string()), one(pa.array(df), n_docs, pa.int64()),
            pa.array([int(n.sum())] + [None] * m, pa.int64()), one(bodies, docs.tobytes(), pa.binary()),
        ], schema=_INDEX)


def build_index(docs: DataFrame, id_column: str = "doc_id", shard_words: int = SHARD_WORDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """docs -> (shard, term, n_docs, n_words, body); the row without term holds the shard's documents and their number of words."""
    with_workers(docs.sparkSession)

    def run(batches):
        shard, n = _Shard(), 0
        task = TaskContext.get().partitionId() << 32
        for b in batches:
            for part in sliced(b, 64):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    if text:
                        shard.add(doc_id, text)
                    if shard.held >= shard_words or len(shard.ids) >= shard_docs:
                        yield from sliced(shard.rows(task | n), 20_000)
                        shard, n = _Shard(), n + 1
        if shard.ids:
            yield from sliced(shard.rows(task | n), 20_000)

    return docs.select(F.col(id_column).cast("long").alias("id"), "text").mapInArrow(run, "shard long, term string, n_docs long, n_words long, body binary")


class _Best:
    """The k best of a query: higher score, then lower id, null ids last."""

    __slots__ = ("k", "heap")

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def floor(self) -> int:
        """Scores below this can't enter."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def offer(self, score: int, doc_id: int | None) -> None:
        entry = (score, doc_id is not None, -(doc_id or 0))
        if len(self.heap) < self.k:
            heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapreplace(self.heap, entry)


def merge(lists: list[tuple[np.ndarray, np.ndarray, int]], ids: list[int | None], best: _Best) -> None:
    """Document-at-a-time merge of postings (document numbers ascending, parts, weight) into `best`, a window of numbers at a time."""
    heap = [(int(docs[0]), i, 0) for i, (docs, _, _) in enumerate(lists)]
    heap.sort()
    while heap:
        low = heap[0][0]
        scores = np.zeros(WINDOW, np.int64)
        while heap and heap[0][0] < low + WINDOW:
            _, i, at = heappop(heap)
            docs, parts, weight = lists[i]
            to = at + int(np.searchsorted(docs[at:], low + WINDOW))
            scores[docs[at:to] - low] += parts[at:to] * weight
            if to < len(docs):
                heappush(heap, (int(docs[to]), i, to))
        found = np.flatnonzero(scores >= best.floor())
        if len(found) > best.k:
            least = np.partition(scores[found], len(found) - best.k)[len(found) - best.k]
            found = found[scores[found] >= least]
        for x, s in zip(found.tolist(), scores[found].tolist()):
            best.offer(s, ids[low + x])


def _documents(body: bytes) -> tuple[list[int | None], np.ndarray]:
    values = unpacked(body)
    ids = np.cumsum(values[1::2], dtype=_U).view(np.int64).tolist()
    for i in range(len(ids) - int(values[0]), len(ids)):
        ids[i] = None
    return ids, values[2::2].astype(np.int64)


def _block_results(index: DataFrame, terms: dict[str, list[tuple[int, int]]], n_docs: int, n_words: int, k: int) -> DataFrame:
    """(q, score, doc_id) of each task's best for the queries of one block; terms: term -> its queries and weight there."""
    spark = index.sparkSession
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    # The block's terms are bounded by BLOCK_TERMS; documents' rows have no term.
    held = index.join(F.broadcast(asked.withColumn("asked", F.lit(True))), "term", "left").filter("term IS NULL OR asked")
    shipped = spark.sparkContext.broadcast(terms)

    def shard_results(rows, best):
        queries: dict[int, list] = {}
        ids, base = None, None
        for term, body in rows:
            if term is None:
                ids, n = _documents(body)
                base = 20 * (50 + (50 * n * n_docs) // n_words)
                continue
            values = unpacked(body).astype(np.int64)
            docs, tf = np.cumsum(values[0::2]), values[1::2]
            parts = (1_000_000_000 * tf) // (1000 * tf + base[docs])
            for q, weight in shipped.value[term]:
                queries.setdefault(q, []).append((docs, parts, weight))
        for q, lists in queries.items():
            merge(lists, ids, best.setdefault(q, _Best(k)))

    def run(batches):
        shard, rows, best = None, [], {}
        for b in batches:
            for s, term, body in zip(*[b.column(c).to_pylist() for c in ("shard", "term", "body")]):
                if s != shard and rows:
                    shard_results(rows, best)
                    rows = []
                shard = s
                rows.append((term, body))
        if rows:
            shard_results(rows, best)
        flat = [(q, s, -i if there else None) for q, x in best.items() for s, there, i in x.heap]
        for i in range(0, len(flat), 20_000):
            q, s, d = zip(*flat[i : i + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(s, pa.int64()), pa.array(d, pa.int64())], ["q", "score", "doc_id"])

    dealt = held.select("shard", "term", "body").repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("term"))
    return dealt.mapInArrow(run, "q long, score long, doc_id long")


def search(index: DataFrame, queries: DataFrame, k: int = TOP, id_column: str = "item_id", block_terms: int = BLOCK_TERMS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k best documents of each row of queries(id_column, text): (id_column, rank, doc_id, score)."""
    spark = index.sparkSession
    with_workers(spark)
    asked = written(queries.select(F.monotonically_increasing_id().alias("q"), F.col(id_column).alias("__id"), F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0))).alias("terms")), "queries")
    terms = asked.select("q", F.explode("terms").alias("term"))
    size = index.filter("term IS NULL").agg(F.sum("n_docs"), F.sum("n_words")).first()
    n_docs, n_words = size[0] or 0, size[1] or 1
    df = index.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    # Terms of weight 0 add nothing.
    weighted = terms.join(df.select("term", weight.alias("w")).filter("w > 0"), "term")
    sizes = written(weighted.groupBy("q").agg(F.count("*").alias("n")), "query-sizes")
    total = sizes.agg(F.sum("n"), F.count("*"), F.max("n")).first()
    blocks = max(-(-(total[0] or 0) // block_terms), -(-total[1] // block_queries))
    deal = lambda: F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")
    # Blocks of unequal luck are made smaller until the largest is within twice the bounds, or is one query.
    while blocks:
        top = sizes.groupBy(deal().alias("block")).agg(F.sum("n").alias("n"), F.count("*").alias("c")).agg(F.max("n"), F.max("c")).first()
        if top[0] <= max(2 * block_terms, total[2]) and top[1] <= 2 * block_queries:
            break
        blocks *= 2
    out = None
    if blocks:
        weighted = written(weighted.select("q", "term", "w", deal().alias("block")), "query-terms")
    for block in range(blocks):
        mine: dict[str, list[tuple[int, int]]] = {}
        for r in weighted.filter(F.col("block") == block).toLocalIterator():
            mine.setdefault(r["term"], []).append((r["q"], r["w"]))
        if mine:
            part = written(_block_results(index, mine, n_docs, n_words, k), "block-results")
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "q long, score long, doc_id long")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("q", "__id"), "q").select(F.col("__id").alias(id_column), "rank", "doc_id", "score")


def digest(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score of the 50 best documents of each item."""
    return search(written(build_index(docs), "lexical-index"), queries)


def brute_force(docs: list[tuple], items: list[tuple], k: int = TOP) -> list[tuple]:
    """The contract's rows from (doc_id, text) and (item_id, text) by scoring every document; for tests."""
    from collections import Counter
    from math import floor, log

    terms = lambda t: re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(w), len(w)) for i, w in ((i, terms(t)) for i, t in docs) if w]
    n_docs, n_words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked = [(t, floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1)))) for t in set(terms(text)) if df[t]]
        rows = [(-sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // n_words))) for t, w in asked if c[t]), i is None, i or 0) for i, c, n in held]
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(x for x in rows if x[0] < 0)[:k])]
    return out


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL),
i AS (
  SELECT row_number() OVER () AS q, item_id,
         list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark WHERE text IS NOT NULL),
it AS (SELECT q, unnest(t) AS term FROM i),
dn AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM dn),
post AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM it) GROUP BY r, term),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM post, total GROUP BY term),
m AS (SELECT r, doc_id, 50 + (50 * n * docs) // words AS m FROM dn, total),
part AS (
  SELECT post.r, term, w * ((1000000000 * tf) // (1000 * tf + 20 * m)) AS s
  FROM post JOIN w USING (term) JOIN m ON m.r = post.r),
score AS (SELECT q, r, CAST(sum(s) AS BIGINT) AS score FROM it JOIN part USING (term) GROUP BY q, r HAVING sum(s) > 0),
ranked AS (
  SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM score JOIN dn USING (r))
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN i USING (q) WHERE rank <= 50
"""
