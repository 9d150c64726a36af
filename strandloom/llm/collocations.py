"""Phrase collocation mining: phrases of two and three words that occur together far more often than their parts would by chance.

Texts are split into pieces, and identical pieces become one with a multiplicity, so copied text is counted once with its weight. Every distinct
piece gives a row for each of its word positions: the word, the next and the one after, within the piece. Rows are summed a chunk at a time before
they are shuffled by (language, first two words) into hash buckets; each bucket is counted by DuckDB, which keeps what exceeds its memory on the
task's scratch disk. A bucket so holds all of a pair's occurrences and those of the triples that start with it, and its size follows
from the number of words, not from the machine. Words are shuffled by themselves.

A candidate needs the counts of its parts, which live in other buckets: it sends a request for each part, the requests meet the counts in a shuffle, and the
answers are gathered by candidate. Parts that a large share of all requests ask for are few by that definition; they are answered by a
broadcast of these few counts. Candidates of three words tell the two pairs inside them their own count the same way.

Defined results: a null text has no pieces; a null lang is `und`; repeated rows count as often as they occur; empty and blank pieces have no words;
a text without a separator is one piece, whatever its length; ties are ordered by phrase; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, dropped, looked_up, with_workers, written

SEPARATORS = r"[.,;:!?\x0A-\x0D]"
MIN_COUNT, INSIDE, TOP = 10, 50, 2000
#: Words of pieces that a task sums up at once before the shuffle.
CHUNK_WORDS = 1_000_000
#: Words of distinct pieces for each hash bucket (with their pairs and triples), and the memory of DuckDB in a task.
BUCKET_WORDS, BUCKET_MEMORY = 4_000_000, "192MB"
#: Groups in which a language's best phrases are picked first.
PICKS = 64

#: A row for each word, and for each pair with the word behind it (or nothing), as one string: word or pair, word behind, count (empty: 1), language,
#: between tabs. One short string a row shuffles in two thirds of what four columns take.
_GRAMS = pa.schema([("row", pa.string())])


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, n): the distinct pieces of a language, words joined by one space, with their multiplicity."""
    parts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(ascii_lower(F.col("text")), SEPARATORS)).alias("p"))
    return parts.select("lang", F.trim(F.regexp_replace("p", r"[\x20\x09]+", " ")).alias("piece")).filter("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("n"))


def _summed(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one row of each distinct key, and the sum of its weights."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return order[starts], np.add.reduceat(weight[order], starts)


def _weighted_grams(chunk: pa.Table):
    """Rows of a chunk of pieces: single words, and pairs with the word behind them."""
    chunk = chunk.combine_chunks()
    words = pc.split_pattern(chunk.column("piece"), " ").combine_chunks()
    words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
    coded = words.flatten().dictionary_encode()
    langs = chunk.column("lang").combine_chunks().dictionary_encode()
    langs = langs.chunk(0) if isinstance(langs, pa.ChunkedArray) else langs
    ends = words.offsets.to_numpy()
    size = np.diff(ends)
    first = coded.indices.to_numpy().astype(np.int64)
    lang = np.repeat(langs.indices.to_numpy().astype(np.int64), size)
    weight = np.repeat(chunk.column("n").to_numpy(), size)
    left = np.repeat(ends[1:] - ends[0], size) - np.arange(len(first))  # words from here to the piece's end
    # 0 stands for no word.
    second = np.where(left > 1, np.roll(first, -1) + 1, 0)
    third = np.where(left > 2, np.roll(first, -2) + 1, 0)
    n = len(coded.dictionary) + 1
    vocab = coded.dictionary

    def rows(at, f, head, tail):
        count = pc.if_else(pa.array(f == 1), "", pa.array(f).cast(pa.string()))
        return pa.RecordBatch.from_arrays([pc.binary_join_element_wise(head, tail, count, langs.dictionary.take(pa.array(lang[at])), "\t")], schema=_GRAMS)

    at, f = _summed(lang * n + first, weight)
    yield rows(at, f, vocab.take(pa.array(first[at])), pa.array([""] * len(at), pa.string()))
    two = np.flatnonzero(second)
    if len(two):
        pair = np.unique((lang[two] * n + first[two]) * n + second[two], return_inverse=True)[1]
        at, f = _summed(pair * n + third[two], weight[two])
        at = two[at]
        head = pc.binary_join_element_wise(vocab.take(pa.array(first[at])), vocab.take(pa.array(second[at] - 1)), " ")
        tail = pc.fill_null(vocab.take(pa.array(np.where(third[at] > 0, third[at] - 1, 0), mask=third[at] == 0)), "")
        yield rows(at, f, head, tail)


def weighted_grams(found: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """pieces() -> rows of _GRAMS, summed within chunks only."""
    with_workers(found.sparkSession)

    def run(batches):
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += pc.sum(pc.count_substring(b.column("piece"), " ")).as_py() + b.num_rows
            if n >= chunk_words:
                yield from _weighted_grams(pa.Table.from_batches(held))
                held, n = [], 0
        if held:
            yield from _weighted_grams(pa.Table.from_batches(held))

    return found.select("lang", "piece", "n").mapInArrow(run, "row string")


def counted(grams: DataFrame, buckets: int, min_count: int = MIN_COUNT, memory: str = BUCKET_MEMORY) -> DataFrame:
    """weighted_grams() -> (lang, gram, words, f) of the words, pairs and triples that occur at least min_count times."""

    def run(batches):
        import duckdb

        # Scratch of the running task, as Spark's own spill is: what is lost with it is worked out again with the task.
        with tempfile.TemporaryDirectory(prefix="bucket-") as scratch:
            con = duckdb.connect(config={"memory_limit": memory, "threads": "1", "temp_directory": scratch, "preserve_insertion_order": "false"})
            try:
                con.register("rows_in", pa.RecordBatchReader.from_batches(_GRAMS, (b.cast(_GRAMS) for b in batches)))
                # A language may hold anything, so it comes last; words hold no tabs.
                each = "SELECT p[1] AS head, p[2] AS tail, CASE WHEN p[3] = '' THEN 1 ELSE CAST(p[3] AS BIGINT) END AS f, array_to_string(p[4:], chr(9)) AS lang FROM (SELECT string_split(row, chr(9)) AS p FROM rows_in)"
                con.execute(f"CREATE TABLE t AS SELECT lang, head, tail, CAST(sum(f) AS BIGINT) AS f FROM ({each}) GROUP BY lang, head, tail")
                for sql in (
                    f"SELECT lang, head AS gram, CASE WHEN contains(head, ' ') THEN 2 ELSE 1 END AS words, CAST(sum(f) AS BIGINT) AS f FROM t GROUP BY lang, head HAVING sum(f) >= {min_count}",
                    f"SELECT lang, head || ' ' || tail AS gram, 3 AS words, f FROM t WHERE tail <> '' AND f >= {min_count}",
                ):
                    yield from con.sql(sql).to_arrow_reader(20_000)
            finally:
                con.close()

    return grams.repartition(buckets, F.substring_index("row", "\t", 1)).mapInArrow(run, "lang string, gram string, words int, f long")


def scored(counts: DataFrame, inside: int = INSIDE) -> DataFrame:
    """counted() -> (lang, phrase, a, l, r, score) of the candidates that no longer one covers."""
    w = F.split("gram", " ")
    request = lambda role, *at: F.struct(F.lit(role).alias("role"), F.concat_ws(" ", *[w[i] for i in at]).alias("part"))
    candidates = counts.filter("words > 1").withColumnRenamed("f", "a")
    two = F.array(request("l1", 0), request("r1", 1))
    three = F.array(request("l1", 0), request("r1", 1, 2), request("l2", 0, 1), request("r2", 2))
    asked = candidates.select("lang", "gram", F.explode(F.when(F.col("words") == 2, two).otherwise(three)).alias("x")).select("lang", "gram", "x.role", "x.part")
    answers = looked_up(asked, counts.select("lang", F.col("gram").alias("part"), "f"), ["lang", "part"]).select("lang", "gram", "role", "f")
    own = candidates.select("lang", "gram", F.lit("a").alias("role"), F.col("a").alias("f"))
    longer = candidates.filter("words = 3").select("lang", F.explode(F.array(F.concat_ws(" ", w[0], w[1]), F.concat_ws(" ", w[1], w[2]))).alias("gram"), F.lit("longer").alias("role"), F.col("a").alias("f"))
    of = lambda role: F.max(F.when(F.col("role") == role, F.col("f")))
    told = answers.unionByName(own).unionByName(longer).groupBy("lang", "gram").agg(*[of(x).alias(x) for x in ("a", "l1", "r1", "l2", "r2", "longer")])
    told = told.filter(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    # Whole numbers of up to 38 digits: a * a * 10^6 and l * r are beyond 64 bits.
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    top = (wide("a") * wide("a")).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    told = told.withColumns({"top": top.cast("decimal(38,0)"), "d1": wide("l1") * wide("r1"), "d2": wide("l2") * wide("r2")})
    told = told.withColumns({"s1": F.expr("top div d1"), "s2": F.expr("top div d2")})
    later = F.col("s2").isNotNull() & (F.col("s2") < F.col("s1"))
    pick = lambda one, other: F.when(later, F.col(other)).otherwise(F.col(one))
    return told.select("lang", F.col("gram").alias("phrase"), "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score"))


def best(found: DataFrame, top: int = TOP) -> DataFrame:
    """The `top` phrases of each language with their rank. They are picked in groups first, so no task sorts all of a language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(PICKS))
    first = found.withColumn("g", group).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "g").orderBy(*order))).filter(F.col("rank") <= top)
    return first.drop("g").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, inside: int = INSIDE, top: int = TOP, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """docs(text, lang) -> (lang, rank, phrase, a, l, r, n, score)."""
    spark = docs.sparkSession
    found = written(pieces(docs), "pieces")
    n_words = F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1
    sizes = written(found.groupBy("lang").agg(F.sum(n_words * F.col("n")).alias("n"), F.sum(n_words).alias("once")), "words")
    words = sizes.agg(F.sum("once")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // bucket_words))
    counts = written(counted(weighted_grams(found), buckets, min_count), "gram-counts")
    dropped(found)
    return best(scored(counts, inside), top).join(sizes.select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def digest(docs: DataFrame) -> DataFrame:
    return collocations(docs).select("lang", F.col("rank").cast("long"), "phrase", *[F.col(c).cast("long") for c in ("a", "l", "r", "n", "score")])


def brute_force(docs: list[tuple], min_count: int = MIN_COUNT, top: int = TOP) -> list[tuple]:
    """The contract's rows from (text, lang) by plain counting; for tests."""
    import re
    from collections import Counter

    f: dict[str, Counter] = {}
    for text, lang in docs:
        mine = f.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split(SEPARATORS, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            mine.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, mine in f.items():
        n = sum(c for g, c in mine.items() if len(g) == 1)
        rows = []
        for g, a in mine.items():
            if len(g) < 2 or a < min_count:
                continue
            if len(g) == 2 and any(len(h) == 3 and c >= min_count and g in (h[:2], h[1:]) and 100 * c >= INSIDE * a for h, c in mine.items()):
                continue
            score, k = min((1_000_000 * a * a // (mine[g[:k]] * mine[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), mine[g[:k]], mine[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return out


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w, count(*) AS m FROM p GROUP BY lang, w),
at_ AS (SELECT lang, w, m, unnest(generate_series(1, len(w))) AS i FROM w),
g AS (
  SELECT lang, 1 AS k, w[i] AS g, CAST(sum(m) AS BIGINT) AS f FROM at_ GROUP BY lang, g
  UNION ALL
  SELECT lang, 2, w[i] || ' ' || w[i + 1] AS g, CAST(sum(m) AS BIGINT) FROM at_ WHERE i + 1 <= len(w) GROUP BY lang, g
  UNION ALL
  SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g, CAST(sum(m) AS BIGINT) FROM at_ WHERE i + 2 <= len(w) GROUP BY lang, g),
f AS (SELECT lang || chr(9) || g AS key, f FROM g WHERE f >= 10),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM g WHERE k > 1 AND f >= 10),
cut AS (
  SELECT lang, k, g, a, 1 AS j, w[1] AS lp, array_to_string(w[2:k], ' ') AS rp FROM c
  UNION ALL
  SELECT lang, k, g, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3),
s AS (
  SELECT cut.lang, cut.k, cut.g, a, j, x.f AS l, y.f AS r,
         CAST((1000000::HUGEINT * a::HUGEINT * a::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS BIGINT) AS score
  FROM cut JOIN f x ON x.key = cut.lang || chr(9) || lp JOIN f y ON y.key = cut.lang || chr(9) || rp),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS o FROM s),
inner_ AS (
  SELECT lang, part, max(a) AS longer
  FROM (SELECT lang, a, w[1] || ' ' || w[2] AS part FROM c WHERE k = 3 UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM c WHERE k = 3)
  GROUP BY lang, part),
left_ AS (
  SELECT low.* FROM low LEFT JOIN inner_ ON inner_.lang = low.lang AND part = g
  WHERE o = 1 AND (longer IS NULL OR 100 * longer < 50 * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM left_)
SELECT lang, CAST(rank AS BIGINT) AS rank, g AS phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
