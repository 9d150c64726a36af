"""Operators against brute force where SQL can't state them, and cases at their edges."""

import random
import re
import time
import unicodedata
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from strandloom.llm import decontaminate, html_text, language_id, quality, secrets, sentencepieces, simhash, token_counts, url_filter

RNG = random.Random(21)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], SCHEMA)


def words(n, letters="abcdefghilmnorstu"):
    return " ".join("".join(RNG.choice(letters) for _ in range(RNG.randint(2, 8))) for _ in range(n))


# ---- clashing names


def test_new_columns_replace_those_of_the_input(spark):
    d = frame(spark, [(1, "some plain words here", "en", "a"), (2, None, None, None)])
    bench = spark.createDataFrame([(1, "plain words")], "item_id long, text string")
    with_ = lambda *names: d.select("*", *[F.lit("old").alias(n) for n in names])
    got = sentencepieces.encoded(with_("ids", "back"), back="back").orderBy("doc_id").collect()
    assert got[0].back == "some plain words here" and len(got[0].ids) > 2 and got[1].ids == []
    assert sentencepieces.decoded(sentencepieces.encoded(with_("decoded"))).filter("doc_id = 1").first().decoded == "some plain words here"
    assert sentencepieces.decoded(spark.createDataFrame([(None,)], "ids array<int>")).first().decoded is None
    assert token_counts.counted(with_("n_tokens")).filter("doc_id = 2").first().n_tokens == 0
    assert {r.score for r in language_id.predicted(with_("score", "lang_pred", "accepted"), []).collect()} == {0.0}
    assert decontaminate.find_hits(with_("hits"), bench).filter("doc_id = 1").first().hits.n_words == 4
    assert simhash.with_fingerprint(with_("fp")).filter("doc_id = 2").first().fp == 0
    pages = spark.createDataFrame([(1, "u", "<p>Some text of a page.")], "page_id long, url string, html string").withColumn("text", F.lit("old"))
    assert html_text.extracted(pages).first().text == "Some text of a page."
    found = secrets.scanned(frame(spark, [(1, 'token = "a8Kd93kfPq02LmXx81bQ"', "en", "s")]).withColumn("score", F.lit(9)).withColumn("length", F.lit("kept")), None, "doc_id", "score", "length").first()
    assert found.asDict().keys() == {"doc_id", "length", "no", "candidate", "score", "is_secret"} and found.length == "kept"


# ---- 1


def test_a_block_holds_what_it_says():
    import tracemalloc

    items = [(i, words(3000, "abcdefghijklmnopqrstuvwxyz")) for i in range(20)]
    tracemalloc.start()
    held = decontaminate.WindowSet(items)
    size = tracemalloc.get_traced_memory()[0] - sum(x.nbytes for x in held.look.values())
    tracemalloc.stop()
    assert size <= 20 * 3000 * decontaminate.WORD_BYTES + sum(decontaminate.TERM_BYTES + len(w) for w in held.ids)


# ---- 2


def test_hot_nodes_are_split_until_they_are_small(spark):
    rng = random.Random(5)
    # All agree in the first 24 bits: one band is hot whatever its first 8 further bits are.
    fps = sorted({0x5A5A5A << 39 | rng.getrandbits(14) for _ in range(500)})
    d = spark.createDataFrame([(x,) for x in fps], "fp long")
    plain, split = ({tuple(sorted(r)) for r in simhash.fingerprint_links(d, 3, hot).collect()} for hot in (50_000, 40))

    def parts(links):
        sets, at = simhash._Sets(len(fps)), {x: i for i, x in enumerate(fps)}
        for a, b in links:
            assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
            sets.join(at[a], at[b])
        return [sets.top(i) for i in range(len(fps))]

    assert parts(plain) == parts(split)


# ---- 5


def test_letters_by_category():
    for c in range(0x250):
        kind = unicodedata.category(chr(c))[0]
        assert bool(language_id.letters(chr(c))) == (kind == "L"), hex(c)
    for text in "½ ² ³", "Ⅷ", "①", "123 _ !", "́", "":
        assert language_id.letters(text) == b""
    assert language_id.letters("Ünï 12 日本_x") == " ünï 日本 x ".encode()


def test_language_by_brute_force(spark):
    alphabets = {g: a for g, a in zip(("aa", "bb", "cc", "dd"), ("abcdefgh", "klmnopqrst", "éüvwxyzab", "ghijkdeab"))}
    vocab = {g: words(200, a).split() for g, a in alphabets.items()}
    rows = [(i, " ".join(RNG.choice(vocab[g]) for _ in range(RNG.choice([3, 20, 90]))), g, "s") for i, g in enumerate(["aa", "bb", "bb", "cc", "dd"] * 30)]
    rows += [(3, rows[3][1], "cc", "s")] * 5 + [(700, "", "aa", "s"), (701, None, "aa", "s"), (702, "½ 12", None, "s")]
    d = frame(spark, rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    taught = [(i, t, g) for i, t, g, _ in rows if g and t is not None and not held(i)]
    counts = {g: sum(x[2] == g for x in taught) for g in alphabets}
    draws = {(r.doc_id, r.text): r.w for r in d.select("doc_id", "text", F.xxhash64(F.lit(7), "doc_id", "text").alias("w")).collect()}
    packed = {}
    for g in sorted(counts, key=lambda g: (-counts[g], g)):
        rows_of = sorted({(draws[i, t], t) for i, t, lang in taught if lang == g})
        content = b"".join(language_id.letters(t) for _, t in rows_of)[:100_000]
        params = zstandard.ZstdCompressionParameters.from_level(11, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        packed[g] = content, zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
    assert min(counts.values()) < 400  # all labelled rows are drawn

    def verdict(text):
        raw = language_id.letters(text)
        if not raw:
            return "und"
        if len(raw) < 300:
            sizes = {g: len(p.compress(c[:400] + raw)) - len(p.compress(c[:400])) for g, (c, p) in packed.items()}
        else:
            sizes = {g: sum(len(p.compress(raw[k : k + 2048])) for k in range(0, len(raw), 2048)) for g, (c, p) in packed.items()}
        return min(sizes, key=sizes.get)

    got = {(r.doc_id): (r.lang_pred, r.held_out) for r in language_id.digest(d).collect()}
    assert got == {i: (verdict(t), held(i)) for i, t, *_ in rows}


def test_every_language_is_learned(spark):
    rows = [(i, words(8, "abcdefghijklmnopqrstuvwxyz"), f"l{i % 400}", "s") for i in range(1600)]
    d = frame(spark, rows).select("doc_id", "lang", "text")
    found = language_id.dictionaries(d, all_bytes=400 * 300)
    assert len(found) == 400 and max(len(c) for _, c in found) <= 300
    many = frame(spark, [(1, "the same text", "en", "s")] * 3000 + [(2, "ein anderer", "de", "s")]).select("doc_id", "lang", "text")
    assert dict(language_id.dictionaries(many)) in ({"en": b" the same text ", "de": b" ein anderer "}, {"de": b" ein anderer "})


# ---- 8


@pytest.mark.parametrize("fewer", [1, 1 << 40, 1 << 50])
def test_repeats_are_exact_when_hashes_agree(spark, monkeypatch, fewer):
    monkeypatch.setattr(quality, "FEWER_BITS", fewer)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (0, 2, 3, 4, 5, 9, 40)] + [" ".join(rng.choice("abcdefghijkl") for _ in range(n)) for n in (200, 900)]
    got = dict(quality.base_counts(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), "doc_id").select("doc_id", "n_repeat_words").collect())
    for i, text in enumerate(texts):
        w = text.split()
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        assert got[i] == len({p for k, g in enumerate(grams) if grams.count(g) > 1 for p in range(k, k + 3)})


def test_a_text_with_too_little_left_is_depleted(spark):
    menu = "home about the shop and all that we sell here"
    rows = [(i, menu + "\n" + words(80), "en", "shop") for i in range(12)] + [(50, menu + "\n" + words(45), "en", "shop"), (51, menu + "\n" + words(55), "en", "shop")]
    kept = dict(quality.digest(frame(spark, rows)).select("doc_id", "kept").collect())
    assert not kept[50] and all(v for i, v in kept.items() if i != 50)
    assert {r.doc_id for r in quality.stage(frame(spark, rows)).collect()} == set(kept) - {50}


# ---- 9


def plain_features(path, c, before, after, dictionary):
    n = len(c)
    classes = "".join("0" if x in "0123456789" else "1" if "a" <= x <= "z" else "2" if "A" <= x <= "Z" else "3" for x in c)
    turns = list(zip(classes, classes[1:]))
    has = lambda pattern, text: float(bool(re.search(pattern, text)))
    alpha = re.findall("[A-Za-z]+", c)
    return {
        "length": min(n, 200), "changes": sum(a != b for a, b in turns) / n, "variety": len(set(c)) / min(n, 64), "digits": classes.count("0") / n, "uppers": classes.count("2") / n,
        "hex": has("^([0-9a-f]+|[0-9A-F]+)$", c), "coverage": sum(len(w) for w in re.findall("[a-z]{3,}", c.lower()) if w in dictionary) / n, "longest_alpha": max(map(len, alpha), default=0),
        "assigned": has(r"[=:]\s*[\"']?$", before), "quoted": float(bool(re.search("[\"'`]$", before)) and bool(re.search("^[\"'`]", after))), "word_for": has(secrets.FOR, before),
        "word_against": has(secrets.AGAINST, before), "path_against": has(secrets.PATH_AGAINST, path), "known_prefix": has(secrets.PREFIX, c),
        "repeats": has(r"(.)\1{5}|(.{1,4})\2{3}|0123456|1234567|abcdefg", c), **{f"turn_{a}{b}": turns.count((a, b)) / n for a in "0123" for b in "0123"},
    }


def leaf(node, x):
    """Class shares of the leaf that a row falls into, walking the exported tree."""
    while "InternalNode" in node.getClass().getName():
        split = node.split()
        node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    stats = np.array(list(node.impurityStats().stats()))
    return stats / stats.sum()


def test_forest_by_brute_force(spark):
    found = secrets.made_findings(spark, 1400)
    dictionary = ["section", "paragraph", "page", "documentation", "user", "windows"]
    vocabulary = spark.createDataFrame([(w,) for w in dictionary], "word string")
    model = secrets.fitted(found, vocabulary)
    rows = found.filter("id IS NOT NULL" if "id" in found.columns else "true").limit(300)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    judged = model.transform(VectorAssembler(inputCols=secrets.FEATURES, outputCol="features").transform(secrets.featured(secrets.with_coverage(rows, vocabulary))))
    got = judged.select("path", "candidate", "before", "after", vector_to_array("features").alias("x"), vector_to_array("probability")[1].alias("p"), "prediction").collect()
    trees = [t._java_obj.rootNode() for t in model.trees]
    for r in got[::5]:
        x = list(plain_features(r.path, r.candidate, r.before, r.after, dictionary)[f] for f in secrets.FEATURES)
        assert np.allclose(x, r.x)
        share = sum(leaf(t, r.x) for t in trees)
        assert abs(share[1] / share.sum() - r.p) < 1e-9 and r.prediction == float(share[1] > share[0])


def test_forest_on_shapes_that_it_never_saw(spark):
    found = secrets.made_findings(spark, 2800)
    vocabulary = spark.createDataFrame([(w,) for w in ("section", "paragraph", "page", "documentation")], "word string")
    unseen = F.col("shape").isin(3, 7, 11, 13, 18, 19, 27)
    model = secrets.fitted(found.filter(~unseen), vocabulary)
    from pyspark.ml.feature import VectorAssembler

    test = VectorAssembler(inputCols=secrets.FEATURES, outputCol="features").transform(secrets.featured(secrets.with_coverage(found.filter(unseen), vocabulary)))
    right = model.transform(test).groupBy("shape").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("r")).collect()
    assert len(right) == 7 and sum(r.r for r in right) / 7 > 0.9, right


def test_candidates_and_redaction_by_occurrence(spark):
    key = "3f786850e387550fdab836ed7e6dc881de23001b"
    texts = {1: f'the token = "{key}" then see commit {key} for it', 2: "password: 'hunter!xyz' and color = 'red'", 3: "k9Xw2LpQ", 4: "AbCdEfGhIjKlMnOpQrSt", 5: "plainlowercasewordsonly"}
    d = frame(spark, [(i, t, "en", "src1") for i, t in texts.items()])
    found = {}
    for r in secrets.candidates(d, "doc_id").collect():
        found.setdefault(r.doc_id, []).append(r.candidate)
    assert found == {1: [key, key], 2: ["hunter!xyz"], 3: ["k9Xw2LpQ"], 4: ["AbCdEfGhIjKlMnOpQrSt"]}
    red = {r.doc_id: r.text for r in secrets.redacted(d).collect()}
    assert red[1] == f'the token = "[SECRET]" then see commit {key} for it' and red[5] == texts[5]


# ---- 10


def test_url_entries_and_large_ids(spark):
    big = spark.createDataFrame([(2 * 10**15, "http://a.example/x"), (9 * 10**18, "http://b.example/"), (-5, None)], "page_id long, url string")
    got = url_filter.captured(big).collect()
    assert all(url_filter.BEGIN <= r.fetched_at < url_filter.BEGIN + 367 * url_filter.DAY for r in got)
    entries = spark.createDataFrame([("url", "a.example/x", "add", 5), ("domain", "example", "add", 50), ("domain", "com", "add", 50)], "kind string, value string, action string, at long")
    caps = spark.createDataFrame([(1, "http://a.example/x?q", 10), (2, "http://a.example/y", 10), (3, "http://a.example/y", 60), (4, "http://a.example/x", 60), (5, "http://a.b.com:1/", 49)], "page_id long, url string, fetched_at long")
    assert {r.page_id: (r.n_rules, r.rule) for r in url_filter.judged(caps, entries).collect()} == {1: (1, "url:a.example/x"), 2: (0, None), 3: (1, "domain:example"), 4: (2, "domain:example"), 5: (0, None)}


def test_url_entries_in_any_form(spark):
    entries = [("url", "HTTP://user@A.Example:80/x/?q#f"), ("domain", "*.b.example"), ("domain", "c.example."), ("domain", ".d.example"), ("domain", "https://E.example/ignored"), ("url", "f.example./Path/"), ("domain", " "), ("domain", "*."), ("url", "")]
    e = spark.createDataFrame([(k, v, "add", 0) for k, v in entries], "kind string, value string, action string, at long")
    urls = ["http://a.example/x", "http://z.b.example/", "http://b.example/", "http://c.example/", "http://c.example./", "http://d.example/", "http://x.e.example/q", "http://f.example/Path", "http://f.example/path", "http://g.example/", "http://./"]
    caps = spark.createDataFrame([(i, u, 1, "own") for i, u in enumerate(urls)], "page_id long, url string, fetched_at long, blocked string").withColumn("rule", F.lit(5))
    assert {r.page_id: r.rule for r in url_filter.judged(caps, e).collect()} == {0: "url:a.example/x", 1: "domain:b.example", 2: "domain:b.example", 3: "domain:c.example", 4: "domain:c.example", 5: "domain:d.example", 6: "domain:e.example", 7: "url:f.example/Path", 8: None, 9: None, 10: None}
    kept = url_filter.kept(caps, e)
    assert kept.columns == caps.columns and sorted((r.page_id, r.blocked, r.rule) for r in kept.collect()) == [(8, "own", 5), (9, "own", 5), (10, "own", 5)]


def test_windows_that_many_items_share():
    stem = [f"w{i}" for i in range(20)]
    items = [(i, " ".join([*stem, f"own{i}", f"more{i}"])) for i in range(3000)] + [("short", "w1 w2")]
    held = decontaminate.WindowSet(items)
    assert len(held.hashes[13]) == 8 + 2 * 3000 and len(held.owners[13]) == 10 * 3000
    began = time.perf_counter()
    spans, found = held.find(("x " + " ".join(stem) + " y ").encode().split() * 200)
    assert time.perf_counter() - began < 1
    assert found == {i for i, _ in items} and decontaminate.merged(spans) == [(22 * k + 1, 22 * k + 21) for k in range(200)]
    assert held.find(b"w1 w2 w3".split()) == ([(0, 2)], {"short"})
