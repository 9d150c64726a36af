"""SentencePiece encoding and decoding by a max-plus scan over chunks.

A text is a lattice: nodes are pieces (start, end), an edge joins two pieces that may follow each other (pieces.py), and
its weight is the number of tokens of the piece it leads to. The encoding is the best path from start to end in the
(max, +) algebra; for BPE it is the only one, every other has weight minus infinity.

A giant text is cut into chunks at fixed positions. The state at a cut is the last piece that starts before it, so a
chunk yields a transfer matrix from the states at its first cut to those at its last; the pieces of one text are at most
`longest` characters, so a matrix has a bounded size. Matrices are combined associatively (max-plus products), which
gives the state at every cut, and each chunk is then traced back on its own between its two states. Chunks are rows
of their own in both passes, so one giant text is worked on by many tasks. A short text is one chunk without outer states.

Within a chunk all paths meet where a token border is sure (a space mark after another character, a character outside
the vocabulary). The stretch between the first and the last such border is shared by all states; its words are looked
up in a memo whose entries come from the same lattice.

Defined results: null and empty texts have no tokens (ids is an empty list); a text decodes to itself, but for the mark
character U+2581, which decodes to a space as in the library; repeated rows and extra columns pass through, one with the name of a new column is replaced.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_columns, no_cycles, sliced, text_key, while_busy, with_workers
from .pieces import _WORD, Memo, Pieces, Transducer, words_of

#: Texts of more characters than GIANT are cut into chunks of CHUNK characters.
GIANT, CHUNK = 60_000, 20_000
NONE = -np.inf
Node = tuple[int, int]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def model_bytes(path: str | None = None) -> bytes:
    with open(path or default_model(), "rb") as f:
        return f.read()


class Codec:
    def __init__(self, model: bytes):
        self.pieces = Pieces(model)
        # With a single outer state each position has one live node: then the lattice is walked by its compiled form.
        # A word's ids are kept as bytes of 16 or 32 bits each: small, and put together by one join.
        self.kind = "H" if len(self.pieces.show) <= 1 << 16 else "I"
        ids = Transducer(self.pieces).ids
        self.memo = Memo(lambda w: array(self.kind, ids(w)).tobytes(), self.pieces.breaks)

    def nodes_at(self, text: str, cut: int) -> list[Node]:
        """The states at a cut: pieces and lone characters that start before it and end at it or later."""
        ids, longest = self.pieces.ids, self.pieces.longest
        return [
            (s, e)
            for s in range(max(0, cut - longest), cut)
            for e in range(cut, min(len(text), s + longest) + 1)
            if e - s == 1 or text[s:e] in ids
        ]

    def walk(self, text: str, entry: dict[Node | None, np.ndarray], stop: int) -> tuple[dict[Node, np.ndarray], dict]:
        """All paths from the entry nodes to nodes that end at `stop` or later.

        entry: node -> weights, one for each outer state; None is the text's start. Returns the weights of the end
        nodes, and each node's best predecessor.
        """
        ids, longest, follows, width = self.pieces.ids, self.pieces.longest, self.pieces.follows, self.pieces.width
        open_: dict[int, dict[Node | None, np.ndarray]] = {}
        for node, w in entry.items():
            open_.setdefault(node[1] if node else 0, {})[node] = w
        back: dict[Node, tuple] = {}
        at, size = (min(open_) if open_ else stop), len(text)
        while at < stop:
            here = open_.pop(at, None)
            if here:
                ends = [e for e in range(at + 1, min(size, at + longest) + 1) if e == at + 1 or text[at:e] in ids]
                for node, w in here.items():
                    last = text[node[0] : node[1]] if node else ""
                    for e in ends:
                        piece = text[at:e]
                        if not follows(last, piece):
                            continue
                        new, value = (at, e), w + width(piece)
                        there = open_.setdefault(e, {})
                        old = there.get(new)
                        if old is None:
                            there[new], back[new] = value, (node,)
                        else:
                            there[new], back[new] = np.maximum(old, value), (*back[new], node)
            at += 1
        return {n: w for there in open_.values() for n, w in there.items()}, back

    def trace(self, back: dict, end: Node, goal: Node | None, text: str, entry: dict | None = None) -> list[int]:
        """Token ids of the path to `end`, without the piece `goal` it starts from."""
        seen, stack = set(), [(end, ())]
        while stack:
            node, tail = stack.pop()
            if node == goal:
                out: list[int] = []
                while tail:
                    out += self.pieces.token_ids(text[tail[0][0] : tail[0][1]])
                    tail = tail[1]
                return out
            if node is None or node in seen:
                continue
            seen.add(node)
            stack += [(p, (node, tail)) for p in back.get(node, ())]
        raise ValueError("no path")

    def encode(self, text: str | None) -> np.ndarray:
        get = self.memo.__getitem__
        return np.frombuffer(b"".join(map(get, words_of(self.pieces, text or ""))), self.kind).astype(np.int32)

    def _borders(self, text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """First and last sure border in (lo, hi)."""
        sure = self.pieces.breaks
        first = next((i for i in range(lo + 1, hi) if sure(text, i)), None)
        return None if first is None else (first, next(i for i in range(hi - 1, lo, -1) if sure(text, i)))

    def _inside(self, text: str) -> list[int]:
        """The ids between two sure borders of marked text."""
        get = self.memo.__getitem__
        return np.frombuffer(b"".join(get("\x01" + w) for w in _WORD.findall(text)), self.kind).tolist()

    def transfer(self, text: str, lo: int, hi: int, first: bool, last: bool) -> tuple[list, list, np.ndarray]:
        """States at lo, states at hi and the matrix of tokens that start in [lo, hi). text: the chunk with its surroundings."""
        ins: list[Node | None] = [None] if first else self.nodes_at(text, lo)
        outs = [n for n in self.nodes_at(text, hi) if not last or n[1] == hi]
        eye = np.full((len(ins), len(ins)), NONE)
        np.fill_diagonal(eye, 0.0)
        entry = dict(zip(ins, eye))
        borders = self._borders(text, lo, hi)
        if borders is None:
            ends, _ = self.walk(text, entry, hi)
            return ins, outs, np.stack([ends.get(n, np.full(len(ins), NONE)) for n in outs], 1) if outs else np.zeros((len(ins), 0))
        a, b = borders
        before, _ = self.walk(text, entry, a)
        to_a = np.max([w for n, w in before.items() if n[1] == a], axis=0, initial=NONE) if any(n[1] == a for n in before) else np.full(len(ins), NONE)
        after, _ = self.walk(text[b:], {None: np.zeros(1)}, hi - b)
        row = np.array([after[(s - b, e - b)][0] if (s - b, e - b) in after else NONE for s, e in outs])
        return ins, outs, to_a[:, None] + len(self._inside(text[a:b])) + row[None, :]

    def traced(self, text: str, lo: int, hi: int, begin: Node | None, end: Node) -> list[int]:
        """The ids of the tokens that start in [lo, hi), on the path from state `begin` to state `end`."""
        if begin is not None and begin == end:
            return []
        borders = self._borders(text, lo, hi)
        if borders is None:
            _, back = self.walk(text, {begin: np.zeros(1)}, hi)
            return self.trace(back, end, begin, text)
        a, b = borders
        out: list[int] = []
        if begin is None or begin[1] < a:
            ends, back = self.walk(text, {begin: np.zeros(1)}, a)
            out += self.trace(back, next(n for n in ends if n[1] == a), begin, text)
        out += self._inside(text[a:b])
        _, back = self.walk(text[b:], {None: np.zeros(1)}, hi - b)
        return out + self.trace(back, (end[0] - b, end[1] - b), None, text[b:])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1, initial=NONE)


def states(matrices: list[np.ndarray]) -> list[int]:
    """The index of the best path's state at each matrix's last cut: prefix products from the left, suffix ones from the right."""
    left, right = [], []
    for m in matrices:
        left.append(m if not left else product(left[-1], m))
    for m in reversed(matrices[1:]):
        right.append(m if not right else product(m, right[-1]))
    out = [int(np.argmax(v.max(0) + w.max(1))) for v, w in zip(left, reversed(right))]
    return [*out, int(np.argmax(left[-1].max(0)))]


def cuts_of(size: int, chunk: int, longest: int) -> list[int]:
    cuts = list(range(0, size, chunk))
    if len(cuts) > 1 and size - cuts[-1] <= longest:
        cuts.pop()
    return [*cuts, size]


def codec(model: bytes) -> Codec:
    """One codec for each worker and model, so that the memo outlives a task."""
    return while_busy(("codec", hash(model)), lambda: Codec(model))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32), pa.int32()))


_CHUNKS = "k1 long, k2 long, no int, lo int, hi int, first boolean, last boolean, part string"


def _chunks(giant: DataFrame, sent, chunk: int) -> DataFrame:
    """A row for each chunk of each giant text: its marked text with `longest` characters on both sides."""

    def run(batches):
        pieces = codec(sent.value).pieces
        for batch in batches:
            for row in batch.to_pylist():
                text, out = pieces.marked(row["text"]), []
                cuts = cuts_of(len(text), chunk, pieces.longest)
                for no, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    x, y = max(0, a - pieces.longest - 1), min(len(text), b + pieces.longest)
                    out.append({"k1": row["k1"], "k2": row["k2"], "no": no, "lo": a - x, "hi": b - x, "first": a == 0, "last": b == len(text), "part": text[x:y]})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("no", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_()), ("part", pa.string())]))

    return giant.mapInArrow(run, _CHUNKS).repartition("k1", "k2", "no")


def giant_ids(docs: DataFrame, sent, giant: int, chunk: int) -> DataFrame:
    """(k1, k2, ids) of the distinct texts with more than `giant` characters."""
    key = text_key(F.col("text"))
    texts = docs.filter(F.length("text") > giant).select(key["k1"].alias("k1"), key["k2"].alias("k2"), "text").dropDuplicates(["k1", "k2"])
    chunks = _chunks(texts, sent, chunk)

    def matrices(batches):
        c = codec(sent.value)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ins, outs, m = c.transfer(r["part"], r["lo"], r["hi"], r["first"], r["last"])
                out.append({"k1": r["k1"], "k2": r["k2"], "no": r["no"], "rows": len(ins), "m": m.ravel().tolist(), "outs": [x - r["hi"] for n in outs for x in n]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("no", pa.int32()), ("rows", pa.int32()), ("m", pa.list_(pa.float64())), ("outs", pa.list_(pa.int32()))]))

    moves = chunks.mapInArrow(matrices, "k1 long, k2 long, no int, rows int, m array<double>, outs array<int>")

    def scan(rows):
        import pandas as pd

        rows = rows.sort_values("no")
        ms = [np.array(m, float).reshape(n, -1) for m, n in zip(rows["m"], rows["rows"])]
        outs = [np.array(o).reshape(-1, 2)[i] for o, i in zip(rows["outs"], states(ms))]
        ends = np.array(outs, np.int32).reshape(-1, 2)
        begins = np.concatenate((np.zeros((1, 2), np.int32), ends[:-1]))
        return pd.DataFrame({"k1": rows["k1"], "k2": rows["k2"], "no": rows["no"], "bs": begins[:, 0], "be": begins[:, 1], "es": ends[:, 0], "ee": ends[:, 1]})

    # A text's matrices: at most a few kB for each of its chunks.
    cuts = moves.groupBy("k1", "k2").applyInPandas(scan, "k1 long, k2 long, no int, bs int, be int, es int, ee int")

    def traced(batches):
        c = codec(sent.value)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                lo, hi = r["lo"], r["hi"]
                begin = None if r["first"] else (lo + r["bs"], lo + r["be"])
                out.append({"k1": r["k1"], "k2": r["k2"], "no": r["no"], "ids": c.traced(r["part"], lo, hi, begin, (hi + r["es"], hi + r["ee"]))})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("no", pa.int32()), ("ids", pa.list_(pa.int32()))]))

    parts = chunks.join(cuts, ["k1", "k2", "no"]).select("k1", "k2", "no", "lo", "hi", "first", "bs", "be", "es", "ee", "part").mapInArrow(traced, "k1 long, k2 long, no int, ids array<int>")
    whole = parts.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("x"))
    return whole.select("k1", "k2", F.flatten("x.ids").alias("ids"))


def encoded(docs: DataFrame, model: str | None = None, giant: int = GIANT, chunk: int = CHUNK, keep: list[str] | None = None, back: str | None = None) -> DataFrame:
    """docs (its columns `keep`, all by default) with ids array<int>, and with what they decode to as column `back` if named."""
    spark = docs.sparkSession
    with_workers(spark)
    keep = kept_columns(docs.columns if keep is None else keep, "ids", back)
    sent = spark.sparkContext.broadcast(model_bytes(model))
    docs = docs.select(*dict.fromkeys([*keep, "text"]))
    long_ = F.coalesce(F.length("text") > giant, F.lit(False))

    new = [T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField(back, T.StringType())] if back else [])]

    def run(batches):
        c = codec(sent.value)
        for whole in batches:
            codec(sent.value)  # still busy
            for b in sliced(whole):
                with no_cycles():
                    ids = [c.encode(t) for t in b.column("text").to_pylist()]
                more = [pa.array([c.pieces.decode(x.tolist()) for x in ids], pa.string())] if back else []
                yield pa.RecordBatch.from_arrays([*b.select(keep).columns, _lists(ids), *more], [*keep, *(f.name for f in new)])

    short = docs.filter(~long_).mapInArrow(run, T.StructType([*(docs.schema[k] for k in keep), *new]))
    key = text_key(F.col("text"))
    long = docs.filter(long_).select(*keep, key["k1"].alias("__k1"), key["k2"].alias("__k2"))
    ids = giant_ids(docs.select("text"), sent, giant, chunk)
    ids = ids.select(F.col("k1").alias("__g1"), F.col("k2").alias("__g2"), F.col("ids").alias("__ids"))
    found = long.join(ids, (F.col("__k1") == F.col("__g1")) & (F.col("__k2") == F.col("__g2"))).select(*keep, F.col("__ids").alias("ids"))
    return short.unionByName(decoded(found, model, back) if back else found)


def decoded(df: DataFrame, model: str | None = None, at: str = "decoded") -> DataFrame:
    """df with the text that its ids decode to; null ids decode to null."""
    spark = df.sparkSession
    with_workers(spark)
    sent = spark.sparkContext.broadcast(model_bytes(model))

    keep = kept_columns(df.columns, at)

    def run(batches):
        decode = codec(sent.value).pieces.decode
        for b in (part for whole in batches for part in sliced(whole)):
            out = [None if x is None else decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.select(keep).columns, pa.array(out, pa.string())], [*keep, at])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), T.StructField(at, T.StringType())]))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text again."""
    out = encoded(docs.select("doc_id", "text"), back="decoded")
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), "▁", " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


def stage(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every document."""
    out = encoded(docs, keep=["doc_id", "lang", "source"])
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


def library_ids(texts: list[str], model: str | None = None) -> list[list[int]]:
    """What the library gives; for tests."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model_bytes(model)).encode(texts)
