"""Secret scans in DataFrame functions only: candidates by pattern, false positives removed by a random forest.

A candidate is what stands after `=` or `:` behind an announcing word (FOR): a run of at least 4 characters of any kind and script, up to white space, a quote, a
comma or a semicolon. Elsewhere it is a run of token characters: of at least 8 with a digit, of at least 16 without one if it changes case twice inside, or of any
kind, from 6 characters on, if it is quoted right after `=` or `:`. It is described by its length, the transitions between its character
classes (one share for each pair of digit, lower, upper and other, and the changes altogether), the variety of its characters, the share of it that dictionary
words cover, the path it was found
under and the words beside it. The forest is fitted on labelled findings; by default these are made by a rule (`made_findings`), a
bounded table: keys, tokens and passwords of common shapes after words that announce them, against hashes of commits and files, ids,
numbers, dates, names, addresses, placeholders and joined words. The dictionary is the `DICTIONARY` most frequent words of all
documents; its size is fixed, so it may be broadcast.

Defined results: null, empty and blank texts have no candidates; each occurrence is a row, numbered in its text; repeated rows
are scanned one by one; a null path is a path without marks; a kept column with the name of a new one is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_columns, text_key, written

_EDGE = r"(?<![A-Za-z0-9+/_-])"
#: Announcing words, as in FOR below: what they open is a candidate of any shape.
_OPENED = r"""(?<=[=:\s"'])(?<=(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)["']?\s{0,2}[=:]\s{0,2}["']?)"""
CANDIDATE = (
    rf"""{_OPENED}[^\s"',;=:][^\s"',;]{{3,}}+"""
    r"""|(?:(?<=[=:]["'])|(?<=[=:] ["']))[^\s"']{6,}+(?=["'])"""
    rf"|{_EDGE}(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{8,}}+={{0,2}}"
    rf"|{_EDGE}(?=[A-Za-z+/_-]*?[a-z][A-Z][A-Za-z+/_-]*?[a-z][A-Z])[A-Za-z+/_-]{{16,}}+={{0,2}}"
)
BEFORE, AFTER = 48, 24
DICTIONARY, WORD = 5000, 3
#: Labelled findings that the forest is fitted on, at most: those with the least hashes.
MOST_FINDINGS = 20_000
TREES, DEPTH, SEED = 24, 7, 11

# Words beside a finding, and marks in a path, that speak for or against a secret.
FOR = r"(?i)(token|secret|passw(or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential|client[_-]?secret)"
AGAINST = r"(?i)(commit|sha-?\d*|md5|checksum|digest|hash|uuid|guid|etag|revision|version|serial|order|invoice|isbn|example|sample|dummy|placeholder|integrity|build|id)\b"
PATH_AGAINST = r"(?i)(test|spec|mock|fixture|example|sample|doc|lock)"
PREFIX = r"^(AKIA|ASIA|gh[pousr]_|github_pat_|sk-|sk_live_|rk_live_|xox[abpr]-|AIza|ya29|glpat-|npm_|eyJ)"

FEATURES = [
    "length", "changes", "variety", "digits", "uppers", "hex", "coverage", "longest_alpha", "assigned", "quoted",
    "word_for", "word_against", "path_against", "known_prefix", "repeats", *[f"turn_{a}{b}" for a in "0123" for b in "0123"],
]


def candidates(docs: DataFrame, *keep: str, path: str = "source") -> DataFrame:
    """keep..., path, no, candidate, before, after: a row for each candidate of each row."""
    found = docs.select(*keep, F.coalesce(F.col(path), F.lit("")).alias("path"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("c"), F.split("text", CANDIDATE).alias("s"))
    near = F.transform(F.col("c"), lambda c, i: F.struct((i + 1).alias("no"), c.alias("candidate"), F.right(F.col("s")[i], F.lit(BEFORE)).alias("before"), F.left(F.col("s")[i + 1], F.lit(AFTER)).alias("after")))
    return found.filter(F.size("c") > 0).select(*keep, "path", F.explode(near).alias("x")).select(*keep, "path", "x.*")


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """(word): the most frequent words of letters, ties by word."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"(?<![a-z0-9])[a-z]{{{WORD},}}+(?![a-z0-9])"), F.lit(0))).alias("word"))
    return words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(size).select("word")


def _runs(candidate):
    return F.regexp_extract_all(F.lower(candidate), F.lit(f"[a-z]{{{WORD},}}"), F.lit(0))


def with_coverage(rows: DataFrame, words: DataFrame) -> DataFrame:
    """rows with coverage: the share of a candidate's characters in runs of letters that are dictionary words."""
    runs = rows.select("candidate").distinct().select("candidate", F.explode(_runs(F.col("candidate"))).alias("word"))
    covered = runs.join(F.broadcast(words), "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("__covered"))
    # Written: the join then reads two plain shuffles, and a candidate that is everywhere can be split over tasks.
    covered = written(covered.withColumnRenamed("candidate", "__candidate"), "coverage")
    out = rows.join(covered, F.col("candidate") == F.col("__candidate"), "left")
    return out.withColumn("coverage", F.coalesce("__covered", F.lit(0)) / F.length("candidate")).drop("__candidate", "__covered")


def featured(rows: DataFrame) -> DataFrame:
    """rows (path, candidate, before, after, coverage) with a column for each feature."""
    c = F.col("candidate")
    n = F.length(c)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "0"), "[a-z]", "1"), "[A-Z]", "2"), "[^012]", "3")
    runs = F.length(F.regexp_replace(classes, r"(.)\1*+", "r"))
    after = F.substring(classes, 2, 1 << 30)
    turns = F.zip_with(F.split(classes, ""), F.split(after, ""), lambda x, y: F.concat(x, y))
    longest = F.array_max(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), lambda x: F.length(x)))
    number = lambda x: x.cast("double")
    rows = rows.withColumn("__turns", turns)
    share = lambda ab: F.size(F.filter("__turns", lambda x: x == ab)) / n
    turn = {f"turn_{a}{b}": share(a + b) for a in "0123" for b in "0123"}
    return rows.withColumns(
        turn
        | {
            "length": number(F.least(n, F.lit(200))),
            "changes": (runs - 1) / n,
            "variety": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64)),
            "digits": F.regexp_count(c, F.lit("[0-9]")) / n,
            "uppers": F.regexp_count(c, F.lit("[A-Z]")) / n,
            "hex": number(F.regexp_like(c, F.lit("^([0-9a-f]+|[0-9A-F]+)$"))),
            "longest_alpha": number(F.coalesce(longest, F.lit(0))),
            "assigned": number(F.regexp_like("before", F.lit(r"[=:]\s*[\"']?$"))),
            "quoted": number(F.regexp_like("before", F.lit("[\"'`]$")) & F.regexp_like("after", F.lit("^[\"'`]"))),
            "word_for": number(F.regexp_like("before", F.lit(FOR))),
            "word_against": number(F.regexp_like("before", F.lit(AGAINST))),
            "path_against": number(F.regexp_like("path", F.lit(PATH_AGAINST))),
            "known_prefix": number(F.regexp_like(c, F.lit(PREFIX))),
            "repeats": number(F.regexp_like(c, F.lit(r"(.)\1{5}|(.{1,4})\2{3}|0123456|1234567|abcdefg"))),
        }
    ).drop("__turns")


def made_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Labelled findings by a rule: (path, candidate, before, after, label, shape), n rows; shapes 0 to 11 are secrets, 12 to 27 aren't."""
    lit, pick = F.lit, lambda at, xs: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs])[at]
    r = spark.range(n).select("id", F.sha1(F.col("id").cast("string")).alias("h"), F.sha2(F.concat(lit("x"), F.col("id").cast("string")), 256).alias("g"), F.pmod("id", lit(28)).cast("int").alias("k"), F.pmod(F.floor(F.col("id") / 28), lit(6)).cast("int").alias("j"))
    mixed = F.regexp_replace(F.base64(F.unhex("g")), "[+/=]", "x")
    alpha = F.translate(mixed, "0123456789", "kQzWvXyBdH")
    digits = F.regexp_replace("h", "[a-f]", "7")
    good = pick(F.col("j"), ["token", "api_key", "secret", "password", "access_key", "auth"])
    bad = pick(F.col("j"), ["commit", "sha1", "md5", "checksum", "uuid", "order id"])
    assigned = F.concat(good, pick(F.col("j"), [' = "', ": '", "=", ' = "', ": ", '="']))
    quoted = F.concat(good, pick(F.col("j"), [' = "', ": '", '="', ": \"", " = '", '="']))
    other = F.concat(pick(F.col("j"), ["title", "name", "color", "label", "path", "lang"]), pick(F.col("j"), [' = "', ": '", '="', ": \"", " = '", '="']))
    close = pick(F.col("j"), ['" and more', "' and more", " and more", '" the', "\nnext", '"'])
    shut = pick(F.col("j"), ['" and', "' and", '" and', '", ', "';", '">'])
    word = pick(F.col("j"), ["internationalization2", "documentation-page-12", "section4paragraph7", "user-guide-chapter-3", "monday2024tuesday2025", "windows10professional"])
    camel = pick(F.col("j"), ["getUserNameFromList", "DocumentationPageView", "theQuickBrownFoxJumps", "InternationalHouseOfTea", "readAllLinesFromFile", "SectionParagraphTitle"])
    plainly = pick(F.col("j"), ["Introduction", "chapter-one", "darkblue", "The-Title", "docs/readme", "en-english"])
    date = F.concat(lit("20"), F.substring(digits, 1, 2), lit("-0"), F.substring(digits, 3, 1), lit("-1"), F.substring(digits, 4, 1))
    uuid = F.concat(F.substring(digits, 1, 8), lit("-"), F.substring("g", 1, 4), lit("-"), F.substring("g", 5, 4), lit("-"), F.substring("g", 9, 12))
    cand = pick(F.col("k"), [
        F.col("h"), F.substring(mixed, 1, 40), F.concat(lit("AKIA"), F.upper(F.substring("h", 1, 16))), F.substring("g", 1, 32), F.concat(lit("ghp_"), F.substring(mixed, 1, 36)), F.col("h"),
        F.upper("h"), F.concat(lit("sk-"), F.substring(mixed, 1, 32)), F.substring(mixed, 1, 10), F.concat(F.substring(alpha, 1, 9), lit("!")), F.substring(alpha, 1, 24), F.substring(mixed, 1, 64),
        F.col("h"), F.substring("g", 1, 32), F.substring(digits, 1, 16), word, lit("xxxxxxxxxxxxxxxx1234"), F.concat(lit("https-cdn-host/assets/img/page"), F.substring(digits, 1, 4)),
        uuid, F.concat(lit("1234567890123456"), F.substring(digits, 1, 3)), date, F.concat(lit("chapter"), F.substring(digits, 1, 2)), F.substring(digits, 1, 9), camel, camel, plainly, word, F.concat(lit("+49-170-"), F.substring(digits, 1, 7)),
    ])
    plain, call, said = lit("of the and that was "), F.concat(lit("some words here "), assigned), F.concat(lit("some words here "), quoted)
    before = pick(F.col("k"), [
        call, call, call, call, call, call, F.upper(call), call, call, said, said, said,
        F.concat(bad, lit(" ")), F.concat(bad, lit(": ")), plain, plain, call, plain, F.concat(lit("the "), bad, lit(" ")), plain, plain, plain, plain, plain, other, other, other, F.concat(lit("call "), plain),
    ])
    after = F.when((F.col("k") >= 9) & (F.col("k") < 12) | F.col("k").isin(24, 25, 26), shut).when(F.col("k") < 9, close).otherwise(lit(" and then"))
    path = F.when((F.col("k") >= 12) & (F.col("j") == 2), lit("tests/fixtures/data.txt")).otherwise(F.concat(lit("src"), F.col("j").cast("string")))
    return r.select(path.alias("path"), cand.alias("candidate"), F.right(before, lit(BEFORE)).alias("before"), F.left(after, lit(AFTER)).alias("after"), (F.col("k") < 12).cast("double").alias("label"), F.col("k").alias("shape"))


def fitted(findings: DataFrame, words: DataFrame):
    """A forest from findings(path, candidate, before, after, label); at most MOST_FINDINGS of them are used."""
    some = findings.select("path", "candidate", "before", "after", "label")
    some = some.orderBy(F.xxhash64("candidate", "before", "path"), "candidate", "before", "after", "path", "label").limit(MOST_FINDINGS)
    rows = featured(with_coverage(some, words))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(ready)


def scanned(docs: DataFrame, findings: DataFrame | None = None, *keep: str, path: str = "source") -> DataFrame:
    """keep..., no, candidate, score, is_secret: every candidate with the forest's judgement."""
    spark = docs.sparkSession
    new = ["no", "candidate", "score", "is_secret"]
    keep = kept_columns(list(keep), *new)
    words = written(dictionary(docs), "dictionary")
    model = fitted(findings if findings is not None else made_findings(spark), words)
    held = docs.select(F.struct(F.lit(0), *keep).alias("__keep"), F.col(path).alias("path"), "text")
    rows = featured(with_coverage(written(candidates(held, "__keep", path="path"), "candidates"), words))
    judged = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    return judged.select(*[F.col("__keep")[k].alias(k) for k in keep], "no", "candidate", F.round(vector_to_array("probability")[1], 6).alias("score"), (F.col("prediction") == 1.0).alias("is_secret"))


def digest(docs: DataFrame) -> DataFrame:
    return scanned(docs, None, "doc_id")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each occurrence in text that is judged a secret replaced by [SECRET]; the same characters judged harmless elsewhere stay."""
    key = text_key(F.col("text"))
    marked = docs.withColumns({"__k1": key["k1"], "__k2": key["k2"]})
    # Copies of a text are judged by the path they are under: one secret verdict is enough.
    secrets = scanned(marked, None, "__k1", "__k2").filter("is_secret").groupBy(F.col("__k1").alias("__g1"), F.col("__k2").alias("__g2")).agg(F.collect_set("no").alias("__s"))
    joined = marked.join(secrets, (F.col("__k1") == F.col("__g1")) & (F.col("__k2") == F.col("__g2")), "left")
    found = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    shown = F.transform(found, lambda c, i: F.when(F.array_contains("__s", i + 1), F.lit("[SECRET]")).otherwise(c))
    around = F.split("text", CANDIDATE, -1)
    text = F.array_join(F.zip_with(around, shown, lambda a, c: F.concat(a, F.coalesce(c, F.lit("")))), "")
    return joined.withColumn("text", F.when(F.size("__s") > 0, text).otherwise(F.col("text"))).select(*docs.columns)
