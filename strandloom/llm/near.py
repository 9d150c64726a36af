"""Near copies among texts: five-word shingles with a Jaccard index of 0.8 or more, beyond what SimHash fingerprints within a few bits can link.

A text's distinct shingle hashes are dealt to BANDS * ROWS bins by one pass; the least of each bin is kept and empty bins borrow from others in an order that is
the same for all texts (one permutation hashing with optimal densification, Shrivastava 2017). A band is ROWS bins; texts with an equal band share a bucket.
Two texts at 0.8 share one with a chance of 1 - 5e-5.

Each bucket's texts are first compared with one pivot, then with a few, but only those that no earlier link has put into one component: a family of thousands of near copies
is one component after a few links a text. What then still is of several components in a bucket is compared by all pairs, in buckets of at most `hot` texts. The texts of larger
ones, such as those of a passage that many texts share, meet by their rarest shingles instead: of two texts at 0.8 each has four fifths of its shingles in common with the other, so
a common one is among the rarest fifth and one more of both, in any order that both follow. No pair of a large bucket is lost so. Sketches reject most pairs; the rest is decided by the shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, likely, with_workers, written
from .components import components

WIDTH, BANDS, ROWS = 5, 25, 5
BINS = BANDS * ROWS
#: Sketches with a smaller share of equal bins aren't compared by shingles: over five standard deviations below 0.8.
LEAST_EQUAL = 0.6
#: Texts of a bucket that are compared by all pairs.
HOT = 50
#: Pivots of a bucket in the rounds before that.
PIVOTS = (1, 4)
_U = np.uint64


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the word shingles, A-Z lower-cased; fewer words make one."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    last = max(1, len(words) - width + 1)
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(whole[a:b], 42) for a, b in zip(starts[:last].tolist(), (ends[min(width, len(words)) - 1 :] - 1).tolist())], np.uint64))


def _borrow_order() -> np.ndarray:
    """For each bin, the others in the order in which it asks them."""
    rng = np.random.default_rng(20170101)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


_ORDER = _borrow_order()


def sketch(hashes: np.ndarray) -> np.ndarray | None:
    """The least hash of each bin, 32 bits; None of no shingles."""
    if not len(hashes):
        return None
    bins = ((hashes >> _U(32)) * _U(BINS) >> _U(32)).astype(np.int64)
    least = np.full(BINS, 1 << 32, np.int64)
    np.minimum.at(least, bins, (hashes & _U(0xFFFFFFFF)).astype(np.int64))
    there = least < 1 << 32
    if not there.all():
        empty = np.flatnonzero(~there)
        first = np.argmax(there[_ORDER[empty]], axis=1)
        least[empty] = least[_ORDER[empty, first]]
    return least.astype(np.uint32)


def _bands(sketches: DataFrame) -> DataFrame:
    """sketches(id, sketch) -> (id, band, v): the value of each band."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            values = [[xxhash.xxh64_intdigest(s[i * 4 * ROWS : (i + 1) * 4 * ROWS], i) for i in range(BANDS)] for s in b.column(1).to_pylist()]
            v = np.array(values, np.uint64).view(np.int64).reshape(len(ids), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(ids))), pa.array(v.ravel())], ["id", "band", "v"])

    return sketches.mapInArrow(run, "id long, band int, v long")


def _mixed(members: DataFrame, comp: DataFrame) -> DataFrame:
    """members(bucket, id) with c, their component so far, in buckets of several components; and the bucket's size."""
    of = members.join(comp, F.col("id") == F.col("node"), "left").select("bucket", "id", F.coalesce("component", "id").alias("c"))
    mixed = of.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).filter("lo < hi").select("bucket", "size")
    return written(of.join(mixed, "bucket"), "mixed-buckets")


def _grams(asked: DataFrame, keys: DataFrame, docs: DataFrame) -> DataFrame:
    """asked(id) -> (id, x): the texts' distinct shingles; keys(id, k1, k2), docs(k1, k2, text), any number of rows a text.

    The keys of the texts that are asked for are written first: texts that likely() rules out aren't shuffled, and where few are asked for, none is.
    """
    held = written(keys.join(asked, "id", "left_semi").select("id", F.col("k1").alias("h1"), F.col("k2").alias("h2")), "asked-texts")
    some = likely(docs, F.col("k1"), held, F.col("h1")).filter("__likely")
    rows = some.join(held, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))).groupBy("id").agg(F.first("text").alias("text"))

    def run(batches):
        for b in batches:
            x = [shingles(t).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.int64()))], ["id", "x"])

    out = written(rows.select("id", "text").mapInArrow(run, "id long, x array<long>"), "shingles")
    dropped(held)
    return out


def _by_rare_shingles(large: DataFrame, keys: DataFrame, docs: DataFrame) -> DataFrame:
    """large(id, c) -> pairs(a, b) of two components that share one of the rarest n div 5 + 1 shingles of both: every pair with a Jaccard index of 0.8 or more.

    Shingles of one text come first in the order and meet nobody, so only shared ones are sorted.
    """
    grams = _grams(large.select("id"), keys, docs)
    each = grams.select("id", F.size("x").alias("n"), F.explode("x").alias("t"))
    often = each.groupBy("t").agg(F.count("*").alias("df")).filter("df > 1")
    shared = each.join(often, "t").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("ts"))
    shared = shared.withColumn("most", (F.floor(F.col("n") / 5) + 1 - F.col("n") + F.size("ts")).cast("int")).filter("most > 0")
    rare = written(shared.join(large, "id").select("id", "c", "n", F.explode(F.slice("ts", F.lit(1), F.col("most"))).alias("x")).select("id", "c", "n", "x.t"), "rare-shingles")
    other = rare.select("t", F.col("id").alias("o"), F.col("c").alias("oc"), F.col("n").alias("on"))
    met = rare.join(other, "t").filter((F.col("id") < F.col("o")) & (F.col("c") != F.col("oc")) & (5 * F.least("n", "on") >= 4 * F.greatest("n", "on")))
    out = written(met.select(F.col("id").alias("a"), F.col("o").alias("b")).distinct(), "rare-pairs")
    dropped(grams, rare)
    return out


def _briefs(sketches: DataFrame) -> DataFrame:
    """sketches(id, sketch) -> (id, brief): the low byte of each bin, a fourth of the sketch. Equal bins have equal bytes, so no pair that agrees in enough bins is lost."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                low = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).astype(np.uint8).reshape(-1, BINS)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in low], pa.binary())], ["id", "brief"])

    return written(sketches.mapInArrow(run, "id long, brief binary"), "briefs")


def _alike(pairs: DataFrame, briefs: DataFrame) -> DataFrame:
    """The pairs(a, b) whose sketches agree in LEAST_EQUAL of the bins, by their briefs."""
    ids, mixed = pairs.select(F.explode(F.array("a", "b")).alias("id")), F.xxhash64("id")
    some = likely(briefs, mixed, ids, mixed).filter("__likely")
    both = pairs.join(some.select(F.col("id").alias("a"), F.col("brief").alias("sa")), "a").join(some.select(F.col("id").alias("b"), F.col("brief").alias("sb")), "b")

    def run(batches):
        for b in batches:
            if b.num_rows:
                one, other = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sa", "sb"))
                keep = pa.array((one == other).sum(1) >= LEAST_EQUAL * BINS)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _checked(pairs: DataFrame, keys: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs(a, b) with a Jaccard index of 0.8 or more; keys(id, k1, k2), docs(k1, k2, text), any number of rows a text."""
    grams = _grams(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), keys, docs)
    both = pairs.join(grams.select(F.col("id").alias("a"), F.col("x").alias("xa")), "a").join(grams.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b")
    # i / (m + n - i) >= 0.8 in whole numbers.
    out = written(both.filter(9 * F.size(F.array_intersect("xa", "xb")) >= 4 * (F.size("xa") + F.size("xb"))).select("a", "b"), "near-links")
    dropped(grams)
    return out


def joined(docs: DataFrame, keys: DataFrame, sketches: DataFrame, links: DataFrame, hot: int = HOT) -> DataFrame:
    """docs(k1, k2, text), keys(id, k1, k2), sketches(id, sketch) of the texts with words, links(a, b) known before -> (node, component) by these and by near copies;
    ids without links are absent."""
    with_workers(docs.sparkSession)
    named = _bands(sketches).select(F.xxhash64("band", "v").alias("bucket"), "id")
    shared = named.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    members = written(named.join(shared, "bucket", "left_semi"), "bucket-members")
    briefs = _briefs(sketches)
    known, comp, seen = links.select("a", "b"), written(components(links), "components"), None
    for n in (*PIVOTS, None):
        of = _mixed(members, comp)
        if n is None:
            some = of.filter(F.col("size") <= hot)
            pivots, late = some.select("bucket", F.col("id").alias("o"), F.col("c").alias("oc")), F.col("id") < F.col("o")
        else:
            # Each of n parts of a bucket sends its least member.
            some, late = of, F.lit(True)
            pivots = of.groupBy("bucket", F.pmod(F.xxhash64("id"), F.lit(n)).alias("part")).agg(F.min(F.struct("id", "c")).alias("p")).select("bucket", F.col("p.id").alias("o"), F.col("p.c").alias("oc"))
        pairs = some.join(pivots, "bucket").filter((F.col("c") != F.col("oc")) & late).select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct()
        if n is None:
            large = written(of.filter(F.col("size") > hot).select("id", "c").distinct(), "large-buckets")
            if not large.isEmpty():
                pairs = pairs.unionByName(_by_rare_shingles(large, keys, docs)).distinct()
            dropped(large)
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        seen = pairs if seen is None else seen.unionByName(pairs)
        alike = written(_alike(pairs, briefs), "alike")
        if not alike.isEmpty():
            known = known.unionByName(_checked(alike, keys, docs))
            old, comp = comp, written(components(known), "components")
            dropped(old)
        dropped(of, alike)
    dropped(members, briefs)
    return comp
