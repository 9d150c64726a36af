"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by a binary trie self-join.

Fingerprint: A-Z lower-cased, words are runs without white space, shingles of `width` words joined by spaces, repeats
included (fewer words: the whole sequence). A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).

Linking works on distinct fingerprints only. Two of them that differ in at most `budget` bits agree in one of budget+1
bands of the 64 bits. For each band, fingerprints are rotated so that the band comes first and are dealt by it: that is
the trie's upper part, where only equal nodes can still meet. Below, each task walks its trie by node pairs: it splits
both nodes of a pair by their next bit, adds the differing bit to the pair's error and drops pairs beyond the budget. A
pair of nodes whose members are all one component already is dropped as well; only links that join two components of
the task leave it, at most one for each fingerprint. A node pair with more than `hot` fingerprints is split further before it is
dealt, by its next bits, into pairs of subtrees that are within the budget, and these again as long as one is too large and has bits left; so no task grows
with a hot band. A task reads its node pairs in order and holds few at once.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; repeated rows and exact
copies share a fingerprint; a null doc_id never is a component's id if the component has another; an empty table gives
an empty result; extra columns pass through, one with the name of a new column is replaced.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import near
from .common import dropped, kept_columns, likely, looked_up, text_key, with_workers, written
from .components import components

WIDTH = 3
BUDGET = 3
SEED = 42
#: A node pair with more distinct fingerprints than this is split before it is dealt, by at most DEEP bits at once.
HOT, DEEP = 50_000, 8
#: Fingerprints that a task walks at once, if no single node pair has more.
HELD = 200_000
#: Node pairs walked at once, and members compared at once.
_FRONT, _LEAF = 1 << 14, 64
_U = np.uint64


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return h(b" ".join(words), SEED)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -width]))
    hashes = [h(whole[a:b], SEED) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist())]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, at: str = "fp", width: int = WIDTH, keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`, all by default) with the fingerprint's 64 bits as a long."""
    with_workers(docs.sparkSession)
    keep = kept_columns(docs.columns if keep is None else keep, at)
    docs = docs.select(*dict.fromkeys([*keep, "text"]))
    kept = [docs.columns.index(c) for c in keep]

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(fp)], [*keep, at])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), T.StructField(at, T.LongType())]))


class _Sets:
    """Union-find over positions, with path halving."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def top(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def flat(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if (nxt == self.up).all():
                return nxt
            self.up = nxt


def trie_links(groups: list[tuple[np.ndarray, np.ndarray | None, int]], first_bit: int, budget: int) -> list[tuple[int, int]]:
    """Spanning links of fingerprint pairs within the budget.

    groups: (left, right or None, error so far); right None means left with itself. Bits from `first_bit` on (0 the
    highest) are compared, those above are settled. Members of left and right are distinct values.
    """
    values = np.concatenate([np.concatenate((np.sort(a), np.sort(b) if b is not None else a[:0])) for a, b, _ in groups]) if groups else np.zeros(0, _U)
    every, place = np.unique(values, return_inverse=True)
    front, at = [], 0
    for a, b, err in groups:
        mid, end = at + len(a), at + len(a) + (0 if b is None else len(b))
        front.append((at, mid, at, mid, err, first_bit) if b is None else (at, mid, mid, end, err, first_bit))
        at = end
    sets, out = _Sets(len(every)), []
    stack = [np.array(front[i : i + _FRONT], np.int64) for i in range(0, len(front), _FRONT)]
    while stack:
        p = stack.pop()
        a0, a1, b0, b1, err, bit = p.T
        same = a0 == b0
        na, nb = a1 - a0, b1 - b0
        p = p[(na > 0) & (nb > 0) & ~(same & (na < 2)) & (err <= budget)]
        if not len(p):
            continue
        roots = sets.flat()[place]
        turns = np.concatenate(([0], np.cumsum(roots[1:] != roots[:-1])))
        a0, a1, b0, b1, err, bit = p.T
        one = (turns[a0] == turns[a1 - 1]) & (turns[b0] == turns[b1 - 1]) & (roots[a0] == roots[b0])
        p = p[~one]
        if not len(p):
            continue
        a0, a1, b0, b1, err, bit = p.T
        leaf = ((a1 - a0) * (b1 - b0) <= _LEAF) | (bit >= 64)
        for x, y in _compared(values, p[leaf], budget):
            if sets.join(place[x], place[y]):
                out.append((int(values[x]), int(values[y])))
        p = p[~leaf]
        if not len(p):
            continue
        a0, a1, b0, b1, err, bit = p.T
        am, bm = _split(values, a0, a1, bit), _split(values, b0, b1, bit)
        same, nxt = a0 == b0, bit + 1
        kids = np.concatenate([
            np.stack((a0, am, b0, bm, err, nxt), 1),
            np.stack((am, a1, bm, b1, err, nxt), 1),
            np.stack((a0, am, bm, b1, err + 1, nxt), 1),
            np.stack((am, a1, b0, bm, err + 1, nxt), 1)[~same],
        ])
        kids = kids[np.argsort(kids[:, 4] * 128 - kids[:, 5], kind="stable")[::-1]]  # equal nodes come first off the stack
        stack += [kids[i : i + _FRONT] for i in range(0, len(kids), _FRONT)]
    return out


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """For sorted runs [lo, hi) whose members agree above `bit`: where that bit becomes 1."""
    lo, hi = lo.copy(), hi.copy()
    shift = (63 - bit).astype(_U)
    while (go := lo < hi).any():
        mid = (lo + hi) // 2
        one = ((values[np.minimum(mid, len(values) - 1)] >> shift) & _U(1)).astype(bool)
        hi = np.where(go & one, mid, hi)
        lo = np.where(go & ~one, mid + 1, lo)
    return lo


def _compared(values: np.ndarray, pairs: np.ndarray, budget: int):
    """Positions of members within the budget, of small node pairs or of equal paths to the last bit."""
    for i in range(0, len(pairs), _FRONT):
        a0, a1, b0, b1 = pairs[i : i + _FRONT, :4].T
        na, nb = a1 - a0, b1 - b0
        n = na * nb
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        nb_, same = np.repeat(nb, n), np.repeat(a0 == b0, n)
        x, y = np.repeat(a0, n) + k // nb_, np.repeat(b0, n) + k % nb_
        ok = (np.bitwise_count(values[x] ^ values[y]) <= budget) & (~same | (x < y))
        yield from zip(x[ok].tolist(), y[ok].tolist())


def _rotl(x: np.ndarray, k: int) -> np.ndarray:
    return x if not k else (x << _U(k)) | (x >> _U(64 - k))


def _masks(bits: int, budget: int) -> list[int]:
    """Differences of `bits` bits with at most `budget` ones."""
    return [sum(1 << i for i in c) for n in range(min(bits, budget) + 1) for c in combinations(range(bits), n)]


def _split_hot(parts: DataFrame, budget: int, hot: int) -> DataFrame | None:
    """parts(turn, task, side, err, bit, v) with the node pairs of over `hot` members replaced by pairs of their subtrees within the budget; None if there is none."""
    sizes = parts.groupBy("task", "bit").count().filter((F.col("count") > hot) & (F.col("bit") < 64))
    deep = F.least(F.lit(DEEP), F.lit(64) - F.col("bit"), F.greatest(F.lit(4), F.ceil(F.log2(F.col("count") / F.lit(hot))).cast("int") + 1))
    sizes = written(sizes.select("task", deep.cast("int").alias("deep")), "hot-nodes")
    if sizes.isEmpty():
        return None
    marked = parts.join(sizes, "task", "left")
    masks = F.element_at(F.create_map(*[x for d in range(1, DEEP + 1) for x in (F.lit(d), F.array(*map(F.lit, _masks(d, budget))))]), F.col("deep"))
    prefix = F.expr("cast(shiftrightunsigned(shiftleft(v, bit), 64 - deep) AS int)")
    cut = marked.filter("deep IS NOT NULL").withColumn("p", prefix).withColumn("mask", F.explode(masks))
    cut = cut.withColumn("q", F.col("p").bitwiseXOR(F.col("mask"))).filter(F.col("err") + F.bit_count("mask") <= budget)
    # With itself (err 0) a node gives each pair of subtrees once; of two nodes, the one on the left keeps the left.
    alone = F.col("err") == 0
    side = F.when(alone, (F.col("p") > F.col("q")).cast("int")).otherwise(F.col("side"))
    left = F.when(alone, F.least("p", "q")).otherwise(F.when(F.col("side") == 0, F.col("p")).otherwise(F.col("q")))
    right = F.when(alone, F.greatest("p", "q")).otherwise(F.when(F.col("side") == 0, F.col("q")).otherwise(F.col("p")))
    new = cut.select("turn", F.xxhash64("task", "deep", left, right).alias("task"), side.alias("side"), (F.col("err") + F.bit_count("mask")).cast("int").alias("err"), (F.col("bit") + F.col("deep")).cast("int").alias("bit"), "v")
    return marked.filter("deep IS NULL").select(*parts.columns).unionByName(new)


def fingerprint_links(fps: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """fps(fp), distinct -> links(a, b) that span the components of fingerprints within `budget` bits."""
    spark = fps.sparkSession
    with_workers(spark)
    bands = budget + 1
    width = 64 // bands
    turned = F.explode(F.array(*[F.struct(F.lit(i * width).alias("turn"), _turned(F.col("fp"), i * width).alias("v")) for i in range(bands)])).alias("x")
    keyed = fps.select(turned).select("x.turn", "x.v", F.shiftrightunsigned("x.v", 64 - width).alias("band"))
    sizes = keyed.groupBy("turn", "band").count().filter("count > 1")
    keyed = keyed.join(sizes.select("turn", "band"), ["turn", "band"], "left_semi")
    parts = written(keyed.select("turn", F.xxhash64("turn", "band").alias("task"), F.lit(0).alias("side"), F.lit(0).alias("err"), F.lit(width).alias("bit"), "v"), "trie-nodes")
    while (finer := _split_hot(parts, budget, hot)) is not None:
        old, parts = parts, written(finer, "trie-nodes")
        dropped(old)
    parts = parts.repartition("task").sortWithinPartitions("turn", "bit", "task", "side", "v")

    def linked(t):
        task, side, err = t["task"].to_numpy(), t["side"].to_numpy(), t["err"].to_numpy()
        turn, bit, v = t["turn"].to_numpy(), t["bit"].to_numpy(), t["v"].to_numpy().view(np.uint64)
        edge = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1], [True])))
        groups: dict[tuple[int, int], list] = {}
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if hi - lo < 2:
                continue
            mine = groups.setdefault((int(turn[lo]), int(bit[lo])), [])
            if err[lo]:
                cut = lo + int(np.searchsorted(side[lo:hi], 1))
                if lo < cut < hi:
                    mine.append((v[lo:cut], v[cut:hi], int(err[lo])))
            else:
                mine.append((v[lo:hi], None, 0))
        for (turn_, bit_), mine in groups.items():
            links = trie_links(mine, bit_, budget)
            if links:
                ab = _rotl(np.array(links, np.uint64), (64 - turn_) % 64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            # What is held goes as soon as it is enough and a node pair ends.
            if n >= HELD:
                task = b.column("task").to_numpy(zero_copy_only=False)
                cut = int(np.argmax(task != held[-1].column("task")[-1].as_py())) if (task != held[-1].column("task")[-1].as_py()).any() else -1
                if cut >= 0:
                    yield from linked(pa.Table.from_batches([*held, b.slice(0, cut)]))
                    held, n, b = [], 0, b.slice(cut)
            held.append(b)
            n += b.num_rows
        if held:
            yield from linked(pa.Table.from_batches(held))

    return parts.mapInArrow(run, "a long, b long")


def _turned(v, k: int):
    """The 64 bits of v turned left by k."""
    return v if not k else F.shiftleft(v, k).bitwiseOR(F.shiftrightunsigned(v, 64 - k))


def with_component(docs_fp: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """docs_fp with columns doc_id and fp -> the same with component_id, the least doc_id reachable by links."""
    firsts = docs_fp.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    firsts = written(firsts, "fingerprints")
    comp = components(fingerprint_links(firsts.select("fp"), budget, hot))
    named = firsts.join(comp, firsts["fp"] == comp["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "component").select(F.col("fp").alias("__fp"), "component_id")
    return docs_fp.join(named, F.col("fp") == F.col("__fp")).drop("__fp")


def digest(docs: DataFrame) -> DataFrame:
    fps = written(with_fingerprint(docs, keep=["doc_id"]), "doc-fingerprints")
    return with_component(fps).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def with_sketches(docs: DataFrame) -> DataFrame:
    """docs -> (doc_id, k1, k2, fp, sketch): the text's key, its fingerprint of five-word shingles and its sketch (null of a text without words)."""
    with_workers(docs.sparkSession)
    key = text_key(F.col("text"))

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            fp = np.array([fingerprint(t, near.WIDTH) for t in texts], np.uint64).view(np.int64)
            sketches = [None if (s := near.sketch(near.shingles(t))) is None else s.tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k1"), b.column("k2"), pa.array(fp), pa.array(sketches, pa.binary())], ["doc_id", "k1", "k2", "fp", "sketch"])

    rows = docs.select("doc_id", key["k1"].alias("k1"), key["k2"].alias("k2"), "text")
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("k1", "k2", "fp")), T.StructField("sketch", T.BinaryType())]))


def near_groups(docs: DataFrame, budget: int = BUDGET, hot: int = HOT, hot_bucket: int = near.HOT) -> DataFrame:
    """docs(doc_id, text) -> (k1, k2, group): the least doc_id among a text's near copies.

    Texts are linked by the trie, as far as its budget goes (fingerprints of five-word shingles), and beyond it by checked pairs at a Jaccard index of 0.8 (near.py).
    """
    rows = written(with_sketches(docs), "sketches")
    texts = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"))
    texts = written(texts.select(F.monotonically_increasing_id().alias("id"), "*"), "texts")
    heads = written(texts.groupBy("fp").agg(F.min("id").alias("head")), "fingerprints")
    same = texts.join(heads, "fp").filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    bits = fingerprint_links(heads.select("fp"), budget, hot)
    head = lambda side: heads.select(F.col("fp").alias(f"f{side}"), F.col("head").alias(f"h{side}"))
    bits = bits.join(head("a"), F.col("a") == F.col("fa")).join(head("b"), F.col("b") == F.col("fb")).select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    links = written(same.unionByName(bits), "bit-links")
    key = text_key(F.col("text"))
    bodies = docs.filter("text IS NOT NULL").select(key["k1"].alias("k1"), key["k2"].alias("k2"), "text")
    comp = near.joined(bodies, texts.select("id", "k1", "k2"), texts.filter("sketch IS NOT NULL").select("id", "sketch"), links, hot_bucket)
    named = written(texts.join(comp, F.col("id") == F.col("node"), "left").select("k1", "k2", "first_id", F.coalesce("component", "id").alias("component")), "text-groups")
    least = named.groupBy("component").agg(F.min("first_id").alias("group"))
    return looked_up(named, least, ["component"]).select("k1", "k2", "group")


def removed_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id, of several rows with that id the least. Rows without id stay.

    Columns without an order (maps) don't count in the choice among rows of one id.
    """
    held = docs.filter("doc_id IS NOT NULL")
    key = text_key(F.col("text"))
    groups = near_groups(held.select("doc_id", "text"))
    ids = written(held.select("doc_id", key["k1"].alias("k1"), key["k2"].alias("k2")), "ids")
    first = looked_up(ids, groups, ["k1", "k2"]).filter(F.col("doc_id") == F.col("group")).select("doc_id").distinct()
    first = written(first, "first-ids")
    # Only ids that several rows have are grouped with their columns; all other rows stay where they are.
    several = written(ids.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    # Rows whose id is neither removed nor repeated stay where they are; only those that may be are shuffled for the exact joins.
    doubted = written(ids.select("doc_id").join(first, "doc_id", "left_anti").unionByName(several).distinct(), "doubted-ids")
    marked = likely(held, F.xxhash64("doc_id"), doubted, F.xxhash64("doc_id"))
    sure = marked.filter("NOT __likely").select(*docs.columns)
    kept = marked.filter("__likely").select(*docs.columns).join(first, "doc_id", "left_semi")
    ordered = [F.col(f.name) for f in docs.schema if not isinstance(f.dataType, T.MapType)]
    rows = kept.join(several, "doc_id", "left_semi").select("doc_id", F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), F.struct(*ordered).alias("__rank"))
    one = rows.groupBy("doc_id").agg(F.min_by("__row", "__rank").alias("__row")).select("__row.*").select(*docs.columns)
    return sure.unionByName(kept.join(several, "doc_id", "left_anti").select(*docs.columns)).unionByName(one).unionByName(docs.filter("doc_id IS NULL"))


def brute_force(docs: list[tuple], budget: int = BUDGET) -> list[tuple]:
    """The contract's rows by comparing all pairs; for tests."""
    fp = [fingerprint(t) for _, t in docs]
    sets = _Sets(len(docs))
    for i in range(len(docs)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= budget:
                sets.join(i, j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(docs):
        top = sets.top(i)
        least[top] = min(least.get(top, doc_id), doc_id)
    return [(d, f"{fp[i]:016x}", least[sets.top(i)]) for i, (d, _) in enumerate(docs)]


def brute_groups(docs: list[tuple], budget: int = BUDGET) -> dict:
    """doc_id -> group of near_groups() by comparing all pairs of (doc_id, text); for tests."""
    fp, grams, sets = [fingerprint(t, near.WIDTH) for _, t in docs], [set(near.shingles(t).tolist()) for _, t in docs], _Sets(len(docs))
    for i in range(len(docs)):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if (fp[i] ^ fp[j]).bit_count() <= budget or both and 9 * both >= 4 * (len(grams[i]) + len(grams[j])):
                sets.join(i, j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(docs):
        top = sets.top(i)
        least[top] = min(least.get(top, doc_id), doc_id)
    return {d: least[sets.top(i)] for i, (d, _) in enumerate(docs)}
