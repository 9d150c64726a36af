"""Corpus operators: contracts against brute force, edge cases, and the whole pipeline against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from strandloom.llm import decontaminate, html_text, language_id, line_dedup, quality, secrets, sentencepieces, simhash, token_counts, url_filter
from strandloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as further columns of the input.
CLASH = ["k1", "k2", "ids", "kept", "rule", "hits", "component", "node", "fp", "no", "score", "line", "pos", "path", "u", "t", "r", "n_words", "removed", "lang_pred"]
RNG = random.Random(3)
VOCAB = ["".join(RNG.choice("abcdefghilmnorstu") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n, rng=RNG, width=9):
    words = [rng.choice(VOCAB) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, n, width))


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, g, s, len(t) if t is not None else None) for i, t, g, s in rows], SCHEMA)
    return df.select("*", *[F.lit(7).alias(c) for c in CLASH]) if extra else df


def edge_rows():
    long_ = prose(12_000)
    near = prose(300).split(" ")
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, "  \n\t ", "en", None), (4, long_, "en", "b"), (5, long_, "en", "c"), (5, long_, "en", "c"), (None, "no id here " * 30, "en", "a"), (7, "x" * 70_000, "en", "a"), (8, "日本語 ﬁ 😀\x00\x01", None, "a"), (9, "A-Z, 0-9!", "de", "b")]
    for k in range(6):
        copy = list(near)
        copy[40 + k] = "changed"
        rows.append((100 + k, " ".join(copy), "en", "abc"[k % 3]))
    return rows + [(200 + i, prose(120), "en", "abcdefghijklm"[i % 13]) for i in range(30)]


BENCH = [(1, " ".join(VOCAB[:30])), (2, "short item"), (3, None), (4, "!!"), (None, "nobody owns this window"), (5, " ".join(VOCAB[:30]))]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, edge_rows()).cache()


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


# ---- 1: decontamination


def test_decontamination(spark):
    rows = [*edge_rows(), (300, prose(20) + " " + " ".join(VOCAB[3:25]).upper() + "! " + prose(20), "en", "a"), (301, "A Short, Item.", "en", "a"), (302, "nobody owns this window, " + prose(400), "en", "b")]
    d, b = frame(spark, rows, extra=True), spark.createDataFrame(BENCH, "item_id long, text string")
    want = sorted(decontaminate.brute_force([(i, t) for i, t, *_ in rows], [x for x in BENCH if x[0] is not None]), key=repr)
    got = plain(decontaminate.digest(d, b))
    # Windows without an item id are hits, but list no item.
    assert [r for r in got if r[0] != 302] == [r for r in want if r[0] != 302]
    assert [r for r in got if r[0] == 302] == [(302, 404, 4, 0, hashlib.sha256(b"").hexdigest(), False)]
    blocks = decontaminate.find_hits(d, b, block_words=5, keep=["doc_id"])
    assert plain(blocks.select("doc_id", decontaminate.n_hit(F.col("hits")))) == [(r[0], r[2]) for r in got]
    kept = decontaminate.removed_documents(d, b)
    assert kept.columns == d.columns and not {300, 301} & {r.doc_id for r in kept.collect()} and kept.count() == len(rows) - 2
    cut = {r.doc_id: r.text for r in decontaminate.removed_spans(d, b).collect()}
    assert cut[301] == "A ." and VOCAB[5].upper() not in cut[300] and cut[1] is None
    assert decontaminate.digest(d, b.limit(0)).filter("n_hit > 0").isEmpty() and decontaminate.digest(d.limit(0), b).isEmpty()


# ---- 2: near-dedup


def test_fingerprint_by_definition():
    for text in ["", None, "One", "a b", "a b c", "A  b\tc\x0bd é É " * 9, prose(100)]:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
        assert simhash.fingerprint(text) == want


def test_near_dedup(spark, docs):
    rows = [x for x in pairs(docs) if x[0] is not None]
    assert plain(simhash.digest(docs.filter("doc_id IS NOT NULL"))) == sorted(simhash.brute_force(rows), key=repr)
    clash = docs.select("*", *[F.lit(7).alias(c) for c in CLASH])
    kept = simhash.removed_copies(clash)
    ids = [r.doc_id for r in kept.collect()]
    groups = simhash.brute_groups(rows)
    assert len({groups[100 + k] for k in range(6)}) == 1
    assert kept.columns == clash.columns and sorted(i for i in ids if i is not None) == sorted(set(groups.values())) and ids.count(None) == 1
    assert simhash.digest(docs.limit(0)).isEmpty()


@pytest.mark.parametrize("hot", [50_000, 4, 1])
def test_trie_links_keep_components(spark, hot):
    rng, fps = random.Random(1), set()
    for _ in range(8):
        base = rng.getrandbits(64)
        for _ in range(30):
            x = base
            for k in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << k
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    sets = simhash._Sets(len(fps))
    for i in range(len(fps)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 3:
                sets.join(i, j)
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp long"), 3, hot)
    comp = dict(components(links).collect())
    assert all(comp.get(x, x) == fps[sets.top(i)] for i, x in enumerate(fps))


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (7, 7)], "a long, b long")
    comp = dict(components(links).collect())
    assert {comp[i] for i in range(101)} == {0} and comp[501] == 500
    assert components(links.limit(0)).isEmpty()


# ---- 3 and 8: lines and quality


def norm(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")


def brute_line_dedup(rows, min_sites=10):
    sites = {}
    for _, text, _, source in rows:
        for line in (text or "").split("\n"):
            if norm(line):
                sites.setdefault(norm(line), set()).update({source} - {None})
    out = []
    for i, text, lang, source in rows:
        lines = (text or "").split("\n")
        gone = [k for k, x in enumerate(lines) if norm(x) and len(sites[norm(x)]) >= min_sites]
        if sum(len(lines[k]) for k in gone) > 0.5 * len(text or ""):
            gone = []
        out.append((i, text if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), lang, source))
    return out


def spread_rows():
    """Boilerplate on 12 sites, a line on exactly 10 and one on 9, and a copied document on all."""
    copied, rows = prose(40), []
    for i in range(13):
        site = f"site{i}"
        lines = [prose(60), "All  Rights\treserved", "on ten" if i < 10 else "", "on nine" if i < 9 else "", prose(60)]
        rows += [(1000 + i, "\n".join(lines), "en", site), (1100 + i, copied, "en", site)]
    return rows


def test_line_dedup(spark):
    rows = spread_rows() + edge_rows()
    d = frame(spark, rows, extra=True)
    got = line_dedup.stage(d)
    want = [(i, t, g, s) for i, t, g, s in brute_line_dedup(rows)]
    assert got.columns == d.columns
    assert plain(got.select("doc_id", "text", "lang", "source")) == sorted(want, key=repr)
    one = got.filter("doc_id = 1000").first()
    assert "on nine" in one.text and "on ten" not in one.text and "Rights" not in one.text and one.n_chars == len(one.text)
    assert got.filter("doc_id = 1100").first().text == next(t for i, t, *_ in rows if i == 1100)
    assert line_dedup.digest(d.limit(0)).isEmpty()


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    hit = {p for i, g in enumerate(grams) if count[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def brute_quality(rows):
    hosts, at = Counter(s or "" for *_, s in rows), {}
    for _, text, _, s in rows:
        for line in (text or "").split("\n"):
            if norm(line) and len(norm(line).split(" ")) <= quality.MAX_LINE_WORDS:
                at.setdefault((s or "", norm(line)), set()).add(text)
    out = []
    for i, text, _, s in rows:
        base = brute_base(text)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        often = [x for x in (text or "").split("\n") if norm(x) and len(t := at.get((s or "", norm(x)), ())) > quality.MIN_DOCS and len(t) > quality.SHARE * hosts[s or ""]]
        lost = sum(len(norm(x).split(" ")) for x in often)
        out.append((i, *base, failed, not failed and not 100 * (base[0] - lost) < quality.LEAST_LEFT * base[0], often))
    return out


def test_quality(spark):
    menu = "\n".join(prose(9) for _ in range(8))
    rows = edge_rows() + [(400 + i, menu + "\n" + prose(10), "en", "shop") for i in range(14)] + [(430 + i, menu + "\n" + prose(200), "en", "shop") for i in range(3)] + [(450, "a b c " * 40, "en", "a"), (451, "x y z\n" * 3 + "# $ " + prose(70), "en", "a")]
    d, want = frame(spark, rows, extra=True), brute_quality(rows)
    assert plain(quality.digest(d)) == sorted((w[:-1] for w in want), key=repr)
    verdict = {w[0]: w[7] for w in want}
    assert not verdict[400] and verdict[430] and not verdict[450]
    got = quality.stage(d)
    expect = [(i, "\n".join(x for x in t.split("\n") if x not in w[-1])) for (i, t, *_), w in zip(rows, want) if w[7]]
    assert got.columns == d.columns and plain(got.select("doc_id", "text")) == sorted(expect, key=repr)
    assert quality.digest(d.limit(0)).isEmpty()


# ---- 4 and 7: tokens


def odd_texts():
    rng = random.Random(8)
    bits = ["a", "th", "er", " ", "  ", "\n", "▁", "é", "日", "\x00", "\x01", "ing", "<s>", "</s>", "<0x0A>", "1", "\t", "ａ", "😀", ".", "==", " " * 20]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [" " * n + "Hello" + " " * n for n in range(40)] + [prose(50)]


def test_codec_and_counts_equal_the_library():
    texts = odd_texts()
    codec, counter = sentencepieces.Codec(sentencepieces.model_bytes()), token_counts.Counter(sentencepieces.model_bytes())
    for text, ids in zip(texts, sentencepieces.library_ids(texts)):
        assert codec.encode(text).tolist() == ids
        assert counter.count(text) == len(ids)
        assert codec.pieces.decode(ids) == text.replace("▁", " ")
        marked = codec.pieces.marked(text)
        if marked:
            maps = [counter.chunk_map(marked[i : i + 7]) for i in range(0, len(marked), 7)]
            assert counter.total(counter.scanned(maps)) == len(ids)


@pytest.mark.parametrize("giant,chunk", [(50, 40), (60_000, 20_000)])
def test_tokens_of_tables(spark, docs, giant, chunk):
    rows = [(i, t, "en", "a") for i, t in enumerate(odd_texts()[:60])] if giant == 50 else edge_rows()
    d = frame(spark, rows)
    want = sentencepieces.library_ids([t or "" for _, t, *_ in rows])
    got = sentencepieces.encoded(d, giant=giant, chunk=chunk, keep=["doc_id"], back="back")
    assert plain(got.select("doc_id", "ids", "back")) == sorted([(r[0], w, (r[1] or "").replace("▁", " ")) for r, w in zip(rows, want)], key=repr)
    n = token_counts.counted(d, giant=giant, chunk=chunk, keep=["doc_id"])
    assert plain(n) == sorted([(r[0], len(w)) for r, w in zip(rows, want)], key=repr)


def test_token_digests(spark):
    rows = edge_rows()
    d = frame(spark, rows, extra=True)
    want = sentencepieces.library_ids([t or "" for _, t, *_ in rows])
    assert plain(token_counts.digest(d)) == sorted([(r[0], len((r[1] or "").encode()), len(w), len(w) > 4096) for r, w in zip(rows, want)], key=repr)
    assert sentencepieces.digest(d).filter("NOT round_trip").isEmpty()
    assert sentencepieces.digest(d.limit(0)).isEmpty() and token_counts.digest(d.limit(0)).isEmpty()


# ---- 5: language


def test_language(spark):
    rng = random.Random(6)
    words = {g: ["".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(300)] for g, a in (("aa", "abcdefgh"), ("bb", "klmnopqrst"), ("cc", "éüvwxyzab"))}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(60)), g, "s") for i, g in enumerate(["aa", "aa", "bb", "cc"] * 40)]
    odd = [(900, None, "aa", "s"), (901, "12 !?", "bb", "s"), (902, "", None, "s"), (None, rows[0][1], "aa", "s"), (903, rows[2][1] * 300, None, "s")]
    got = {r.doc_id: r for r in language_id.digest(frame(spark, rows + odd, extra=True)).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(len(rows)))
    assert sum(got[i].lang_pred == g for i, _, g, _ in rows) >= 0.97 * len(rows)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values())
    unlabelled = frame(spark, [(1, "some text", None, "a")])
    assert language_id.digest(unlabelled).first().lang_pred == "und" and language_id.digest(unlabelled.limit(0)).isEmpty()


def test_language_on_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.digest(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()


# ---- 6: html

PAGE = """<html><body><header><h1>Site</h1></header><div id=menu><a href=1>A</a><a href=2>b</a></div><div class="main-wrap">
<div class="cookie-notice">We use cookies, yes, really, do accept them all please.</div>
<div class=post><h2>Title &amp; more</h2><p>First para, with commas, and &eacute;t&#233; text that is long enough to be scored.<p>Second   para<br>line two, and more
<ul><li>one<li>two</ul><blockquote>quote</blockquote></div><aside><p>Side text, that is long, and should not be here at all, friend.</p></aside>
<form><p>Name, please, and some more text to be long enough</p><input></form><div class="ad">Buy, buy, buy this thing that nobody needs.</div>
<div id="comments"><p>Comment text, that is long, and should not be here at all, friend.</p></div></div><footer>foot</footer><script>if(a<b){x="</p>"}</script></body>"""


def test_html(spark):
    assert html_text.main_text(PAGE).split("\n\n") == ["Title & more", "First para, with commas, and été text that is long enough to be scored.", "Second para line two, and more", "one", "two", "quote"]
    for odd, want in [(None, ""), ("", ""), ("plain", "plain"), ("<p>short", "short"), ("<", "<"), ("<!-- a", ""), ("<script>x", ""), ("<div>" * 5000 + "deep", "deep")]:
        assert html_text.main_text(odd) == want
    rows = [(1, "u1", PAGE), (1, "u1", PAGE), (2, None, None), (3, "u3", "<p>" + "word, " * 20_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = plain(html_text.digest(d))
    assert got == sorted([(i, u, t := html_text.main_text(h), len(t)) for i, u, h in rows], key=repr)
    assert html_text.digest(d.limit(0)).isEmpty()


# ---- 9: secrets


def test_secrets(spark):
    key = hashlib.sha1(b"1").hexdigest()
    texts = [(1, f'some words token = "{key}" and more'), (2, f"see commit {key} for the change"), (3, None), (4, ""), (5, "card 1234567890123456 here"), (6, f'a password: "{key}" b secret = "{key}"')]
    rows = [(i, t, "en", None if i == 6 else "src1") for i, t in texts] + [(100 + i, prose(60), "en", "s") for i in range(5)]
    d = frame(spark, rows, extra=True)
    got = {(r.doc_id, r.no): r.is_secret for r in secrets.digest(d).collect()}
    assert got == {(1, 1): True, (2, 1): False, (5, 1): False, (6, 1): True, (6, 2): True}
    red = {r.doc_id: r.text for r in secrets.redacted(d).collect()}
    assert red[6] == 'a password: "[SECRET]" b secret = "[SECRET]"' and red[2] == texts[1][1] and red[3] is None
    assert secrets.digest(d.limit(0)).isEmpty()


def test_secret_candidates_by_plain_python(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted((r.doc_id, r.candidate) for r in secrets.candidates(d, "doc_id").collect())
    pattern = regex.compile(secrets.CANDIDATE, regex.ASCII)
    assert got == sorted((r.doc_id, m[0]) for r in d.collect() for m in pattern.finditer(r.text or ""))


def test_announcing_words_open_candidates(spark):
    texts = ["password: correcthorsebatterystaple", "password = hunter2", "secret = abcdefghijklmnopqrstuvwxyz", "api_key=QWERTYUIOPASDFGHJKLZ", "token: pässwörtlangundgeheim1234", '"Access-Key" : "kurz"', "my pwd=a1", "color = plainword", "PASSWORD:'x y'"]
    d = frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    found = {r.doc_id: r.candidate for r in secrets.candidates(d, "doc_id").collect()}
    assert found == {0: "correcthorsebatterystaple", 1: "hunter2", 2: "abcdefghijklmnopqrstuvwxyz", 3: "QWERTYUIOPASDFGHJKLZ", 4: "pässwörtlangundgeheim1234", 5: "kurz"}


def test_forest_on_held_out_findings(spark):
    found = secrets.made_findings(spark, 3200).withColumn("k", F.pmod(F.xxhash64("candidate", "before"), F.lit(4)))
    words = spark.createDataFrame([(w,) for w in ("section", "paragraph", "page", "documentation")], "word string")
    model = secrets.fitted(found.filter("k <> 2").drop("k"), words)
    from pyspark.ml.feature import VectorAssembler

    test = secrets.featured(secrets.with_coverage(found.filter("k = 2").drop("k"), words))
    right = model.transform(VectorAssembler(inputCols=secrets.FEATURES, outputCol="features").transform(test)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.97


# ---- 10: url lists


def test_url_filter(spark):
    entries = [("domain", "Bad.example", "add", 10), ("domain", "bad.example", "remove", 20), ("domain", "bad.example", "add", 30), ("domain", "bad.example", "add", 30), ("url", "ok.example/x", "add", 0), ("domain", "tie.example", "add", 5), ("domain", "tie.example", "remove", 5), ("domain", None, "add", 0)]
    e = spark.createDataFrame(entries, "kind string, value string, action string, at long")
    caps = [(1, "http://a.bad.example/p", 9), (2, "http://a.bad.example/p", 10), (3, "https://BAD.example", 20), (4, "http://bad.example:80/", 99), (5, "http://notbad.example/", 15), (6, "http://ok.example/x/?q=1#f", 1), (7, "http://ok.example/xy", 1), (8, None, 1), (9, "http://bad.example/", None), (10, "nonsense", 1), (11, "http://tie.example/", 6), (2, "http://a.bad.example/p", 10)]
    c = spark.createDataFrame(caps, "page_id long, url string, fetched_at long").select("*", *[F.lit(1).alias(x) for x in ("u", "t", "rule", "kind", "value", "spans")])
    got = sorted((r.page_id, r.blocked, r.rule) for r in url_filter.judged(c, e).collect())
    blocked = {2: "domain:bad.example", 4: "domain:bad.example", 6: "url:ok.example/x"}
    assert got == sorted((i, i in blocked, blocked.get(i)) for i, *_ in caps)
    assert url_filter.judged(c, e.limit(0)).filter("blocked").isEmpty() and url_filter.judged(c.limit(0), e).isEmpty()
    assert url_filter.kept(c, e).count() == len(caps) - 4


# ---- the pipeline


def test_pipeline_against_plain_python(spark, tmp_path):
    import corpus_pipeline

    menu = "\n".join(prose(9) for _ in range(8))
    rows = spread_rows() + edge_rows() + [(400 + i, menu + "\n" + prose(10), "en", "shop") for i in range(14)]
    rows += [(500, prose(100) + "\n" + " ".join(VOCAB[:30]) + "\n" + prose(100), "en", "a"), (501, " ".join(VOCAB[:30]) + "\n" + prose(900), "en", "a")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [(i, "\n".join(x for x in t.split("\n") if x not in w[-1]), g, s) for (i, t, g, s), w in zip(rows, brute_quality(rows)) if w[7]]
    left = brute_line_dedup(left)
    group = simhash.brute_groups([(i, t) for i, t, *_ in left if i is not None])
    left = list({r[0]: r for r in left if r[0] is None or group[r[0]] == r[0]}.values())
    dirty = {x[0] for x in decontaminate.brute_force([(r[0], r[1]) for r in left], BENCH) if x[-1]}
    left = [r for r in left if r[0] not in dirty]
    want = sorted([(i, g, s, len(x), x) for (i, _, g, s), x in zip(left, sentencepieces.library_ids([t for _, t, *_ in left]))], key=repr)
    assert 500 in dirty and 501 in {r[0] for r in left}
    assert plain(corpus_pipeline.run(spark, str(tmp_path))) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "tokens"]


def test_stages_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = frame(spark, edge_rows(), extra=True).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path))
        assert out.isEmpty()
        assert name == "tokens" or out.columns == d.columns
