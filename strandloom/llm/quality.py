"""Quality rules in DataFrame functions only: base counts of a text, and lines that too many documents of a host share.

Cross-document line frequency: lines of every length are hashed in normalised form, the distinct documents with a line are counted per host, and a line
found in more than max(`min_docs`, `share` of the host's) documents is boilerplate there. Documents are told apart by their text, in a line's count and in the
host's size: an exact copy is no further document. A document whose words lie mostly in boilerplate lines is depleted: less than `least_left`
percent of its words would stay, or fewer than the base rule asks for. It is rejected, as is one that fails the base rule.

Defined results: a null text has no words, lines or symbols and fails the base rule; a null host counts as the host
without name; repeated rows are judged alike; extra columns pass through (one named as a new column of judged() is replaced); an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_WS_CLASS, text_key, written
from .lines import lines_of, without_positions

MIN_WORDS, MOST_REPEAT = 50, 50
MIN_DOCS, SHARE, LEAST_LEFT = 10, 0.005, 30
#: Columns that judged() adds.
NEW = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "__removed")
#: Tests take bits off the windows' hashes, so that different windows share them.
FEWER_BITS = 1


def words(text):
    return F.regexp_extract_all(text, F.lit(f"{NON_WS_CLASS}+"), F.lit(0))


def base_counts(docs: DataFrame, *keep) -> DataFrame:
    """keep..., n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select(
        *keep,
        words(text).alias("__w"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(NON_WS_CLASS))).alias("__l"),
    )
    names = [n for n in split.columns if n not in ("__w", "n_symbols", "__l")]
    w, n = F.col("__w"), F.col("__n")
    sized = split.select("*", F.size(w).alias("__n"))
    # A window's hash has its position in the low bits: equal windows are neighbours in the sorted array of longs.
    room = F.expr("shiftleft(1L, cast(ceil(log2(__n + 1)) AS int))") * FEWER_BITS
    packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]).bitwiseAND(-F.col("__room")).bitwiseOR(i.cast("long")))
    sorted_ = sized.select("*", room.alias("__room")).select("*", F.when(n >= 4, F.sort_array(packed)).alias("__s"))
    s, low = F.col("__s"), F.col("__room") - 1
    at_ = lambda j: s[j].bitwiseAND(low).cast("int")

    def hashed(j):
        both = s[j - 1].bitwiseXOR(s[j])
        return (both <= low) & (both >= 0)

    def same(p, q):
        return (w[p] == w[q]) & (w[p + 1] == w[q + 1]) & (w[p + 2] == w[q + 2])

    turns = F.sequence(F.lit(1), F.size(s) - 1)
    beside = sorted_.select("*", F.filter(turns, hashed).alias("__j"))
    checked = beside.select("*", F.filter("__j", lambda j: same(at_(j - 1), at_(j))).alias("__p"))
    by_hash = F.flatten(F.transform("__p", lambda j: F.array(at_(j - 1), at_(j))))
    # Where different windows share the hash's upper bits, they may stand between equal ones: such a text is sorted by the words themselves.
    mixed = F.size("__j") != F.size("__p")
    spelt = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.alias("i"))))
    found = checked.select("*", F.when(mixed, spelt["i"]).alias("__e"))
    e = F.col("__e")
    by_words = F.flatten(F.transform(F.filter(turns, lambda j: same(e[j - 1], e[j])), lambda j: F.array(e[j - 1], e[j])))
    at = F.sort_array(F.when(mixed, by_words).otherwise(by_hash)).cast("array<bigint>")
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        F.col("__at"), zero,
        lambda acc, p: F.struct(F.greatest(acc["end"], p + 3).alias("end"), (acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n")),
        lambda acc: acc["n"],
    )
    found = found.select(
        *names, "n_symbols",
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 4, at).alias("__at"),
    )
    repeats = F.when(F.size("__at") > 0, covered).otherwise(F.lit(0)).cast("long")
    # Filters aren't pushed through an explode of its own columns: one on a count would otherwise be rewritten into the
    # expressions above, each of which it would repeat.
    counts = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"))
    return found.select(*names, F.explode(F.array(counts)).alias("__c")).select(*names, "__c.*")


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"))


def _host(host: str):
    return F.coalesce(F.col(host), F.lit(""))


def hashed_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """(host, k1, k2, pos, h1, h2, w) of the lines of each host's distinct texts, written once: all passes read them. w: words of the line."""
    texts = docs.select("text", _host(host).alias("__host"))
    lines = lines_of(texts, "__host").select("__host", "k1", "k2", "pos", "h1", "h2", F.size(F.split("norm", " ")).alias("w"))
    return written(lines, "host-lines")


def frequent_lines(docs: DataFrame, lines: DataFrame, host: str = "source") -> DataFrame:
    """(host, h1, h2) of the lines above the host's limit, from hashed_lines()."""
    texts = docs.select("text", _host(host).alias("__host"))
    # Map side first: a line that is everywhere shuffles once for each task and text, and then as a count.
    held = lines.select("__host", "h1", "h2", "k1", "k2").distinct()
    counts = held.groupBy("__host", "h1", "h2").count().filter(F.col("count") > MIN_DOCS)
    # The host's size in the same unit as a line's documents: distinct texts.
    key = text_key(F.col("text"))
    hosts = texts.select("__host", key["k1"].alias("k1"), key["k2"].alias("k2")).distinct().groupBy("__host").agg(F.count("*").alias("__texts"))
    return counts.join(hosts, "__host").filter(F.col("count") > SHARE * F.col("__texts")).select("__host", "h1", "h2")


def lost_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """(host, k1, k2, removed, lost_words) of the texts with boilerplate lines: positions, and words in them."""
    lines = hashed_lines(docs, host)
    frequent = written(frequent_lines(docs, lines, host), "frequent-lines")
    gone = lines.join(frequent, ["__host", "h1", "h2"], "left_semi").select("__host", "k1", "k2", "pos", "w").distinct()
    return gone.groupBy("__host", "k1", "k2").agg(F.array_sort(F.collect_list("pos")).alias("__removed"), F.sum("w").alias("__lost"))


def judged(docs: DataFrame, *keep: str, host: str = "source") -> DataFrame:
    """keep..., the base counts, base_failed, kept, and __removed: positions of boilerplate lines."""
    key = text_key(F.col("text"))
    # The counts replace kept columns of their names.
    keep = [c for c in keep if not isinstance(c, str) or c not in NEW]
    counts = base_counts(docs, *keep, _host(host).alias("__h"), key["k1"].alias("__k1"), key["k2"].alias("__k2"))
    lost = lost_lines(docs, host)
    on = (F.col("__h") == F.col("__host")) & (F.col("__k1") == F.col("k1")) & (F.col("__k2") == F.col("k2"))
    joined = counts.join(lost, on, "left")
    left = F.col("n_words") - F.coalesce("__lost", F.lit(0))
    depleted = (100 * left < LEAST_LEFT * F.col("n_words")) | (left < MIN_WORDS)
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~depleted).drop("__h", "__k1", "__k2", "__host", "k1", "k2", "__lost")


def digest(docs: DataFrame) -> DataFrame:
    return judged(docs, "doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that are kept, boilerplate lines of their host removed from text and n_chars counted anew.

    Verdicts belong to (host, text). They are written before the join: a filter on them would otherwise be pushed into
    the counting expressions and repeat them, and many copies of one text can be split over tasks.
    """
    key = text_key(F.col("text"))
    keys = {"__h": _host(host), "__k1": key["k1"], "__k2": key["k2"]}
    keyed = docs.select(*docs.columns, *[c.alias(n) for n, c in keys.items()])
    verdicts = judged(docs.select(host, "text"), *[c.alias(n.replace("__", "v_")) for n, c in keys.items()], host=host)
    verdicts = written(verdicts.select("v_h", "v_k1", "v_k2", "kept", "__removed").distinct(), "verdicts")
    kept = verdicts.filter("kept").select(F.col("v_h").alias("__vh"), F.col("v_k1").alias("__v1"), F.col("v_k2").alias("__v2"), F.col("__removed").alias("__vr"))
    on = (F.col("__h") == F.col("__vh")) & (F.col("__k1") == F.col("__v1")) & (F.col("__k2") == F.col("__v2"))
    out = keyed.join(kept, on).withColumn("text", without_positions(F.col("text"), F.col("__vr"))).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(text, chr(10)) AS ls
  FROM documents),
win AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) >= 2),
rw AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM win JOIN rep USING (r, g)) GROUP BY r),
l AS (
  SELECT r, host, text, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM (SELECT r, host, text, unnest(ls) AS line FROM d WHERE text IS NOT NULL)),
dl AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE norm <> '' GROUP BY r),
hosts AS (SELECT host, count(DISTINCT text) + max(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS n FROM d GROUP BY host),
freq AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT text) AS docs FROM l WHERE norm <> '' GROUP BY host, norm) JOIN hosts USING (host)
  WHERE docs > 10 AND docs > 0.005 * n),
lost AS (SELECT r, sum(len(string_split(norm, ' '))) AS lost FROM l JOIN freq USING (host, norm) GROUP BY r),
base AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         coalesce(lost, 0) AS lost
  FROM d LEFT JOIN rw USING (r) LEFT JOIN dl USING (r) LEFT JOIN lost USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * (n_words - lost) >= 30 * n_words AND n_words - lost >= 50 AS kept
FROM b
"""
