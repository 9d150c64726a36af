"""The corpus operators do the whole job: cases that a cut by length, share or unit would leave out."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F
from strandloom.llm import line_dedup, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(11)


def words(n):
    return " ".join("".join(RNG.choice("abcdefghilmnorstu") for _ in range(RNG.randint(3, 8))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA)


def near_copy(paragraphs, k):
    """The paragraphs with one word changed in one of them."""
    out = [p.split(" ") for p in paragraphs]
    out[k % len(out)][5 + k % 40] = f"edit{k}"
    return "\n".join(" ".join(p) for p in out)


def plain_quality(rows):
    """kept by the rules in plain Python: rows (id, text, host)."""
    words_ = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    norm = lambda line: " ".join(words_(line.lower()))
    texts, docs = {}, {}
    for _, t, host in rows:
        texts.setdefault(host, set()).add(t)
    for host, held in texts.items():
        for t in held:
            for line in {norm(x) for x in (t or "").split("\n")} - {""}:
                docs[host, line] = docs.get((host, line), 0) + 1
    out = {}
    for i, t, host in rows:
        w = words_(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = Counter(grams)
        repeated = {k + j for k, g in enumerate(grams) if many[g] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        lost = sum(len(words_(x)) for x in (t or "").split("\n") if (n := docs.get((host, norm(x)), 0)) > 10 and n > 0.005 * len(texts[host]))
        out[i] = not failed and 100 * (len(w) - lost) >= 30 * len(w) and len(w) - lost >= 50
    return out


def test_quality_against_plain_rules(spark):
    rows = []
    for f, (n, host) in enumerate([(100, "a"), (400, "b"), (9, "c"), (40, None)]):
        family = [words(60) for _ in range(4)]
        rows += [(1000 * f + i, near_copy(family, i), host) for i in range(n)]
    menu, footer = words(25), "all the same footer"
    rows += [(5000 + i, menu + "\n" + words(80 if i % 3 else 10) + "\n" + footer, "d") for i in range(60)]
    rows += [(6000 + i, copied, "e") for copied in [words(60)] for i in range(300)] + [(7000, None, "e"), (7001, "", "e"), (7002, "a b " * 40, "e")]
    verdict = {r.doc_id: r.kept for r in quality.digest(spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)).collect()}
    assert verdict == plain_quality(rows)
    # Near copies are documents of their own: lines that a family of many shares on one host are boilerplate there. Exact copies are one.
    assert not any(verdict[1000 + i] for i in range(400)) and all(verdict[6000 + i] for i in range(300)) and all(verdict[2000 + i] for i in range(9))


def test_long_lines_are_boilerplate(spark):
    licence = words(60)
    rows = [(i, licence + "\n" + words(90), "hot") for i in range(14)] + [(20 + i, licence + "\n" + words(20), "hot") for i in range(3)]
    d = frame(spark, rows)
    verdict = {r.doc_id: r.kept for r in quality.digest(d).collect()}
    left = {r.doc_id: r.text for r in quality.stage(d).collect()}
    assert all(verdict[i] and licence not in left[i] for i in range(14))
    assert not any(verdict[20 + i] for i in range(3)) and not {20, 21, 22} & set(left)


def test_host_limit_counts_texts_on_both_sides(spark):
    rows = [(i, copied, "hot") for copied in [words(60)] for i in range(4000)]
    rows += [(5000 + i, "all the same footer\n" + words(60), "hot") for i in range(15)]
    left = {r.doc_id: r.text for r in quality.stage(frame(spark, rows)).collect()}
    assert len(left) == len(rows) and not any("footer" in left[5000 + i] for i in range(15)) and left[0] == rows[0][1]


def test_line_dedup_against_plain_rules(spark):
    menu, copied = words(60), words(80)
    rows = [(i, menu + "\n" + words(30), f"site{i}") for i in range(12)] + [(100 + i, copied, f"site{i}") for i in range(12)]
    for f, n in ((1000, 100), (2000, 400)):
        family = [words(60) for _ in range(4)]
        rows += [(f + i, near_copy(family, i), f"site{i % 30}" if f == 2000 else f"site{i % 9}") for i in range(n)]
    rows += [(3000, None, "site1"), (3001, menu, None)]
    site, spread = {}, {}
    for _, t, s in rows:
        if t is not None and s is not None:
            site[t] = min(s, site.get(t, s))
    for t, s in site.items():
        for line in t.split("\n"):
            spread.setdefault(line, set()).add(s)
    want = {i: t if t is None else "\n".join(x for x in t.split("\n") if len(spread.get(x, ())) < 10) for i, t, _ in rows}
    d = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA).select("*", F.lit(7).alias("__removed"), F.lit(8).alias("site"), F.lit(9).alias("__gone"))
    out = line_dedup.stage(d)
    assert out.columns == d.columns and {r.doc_id: r.text for r in out.collect()} == want
    assert all(want[100 + i] == copied and menu not in want[i] for i in range(12)) and all(want[1000 + i] == t for i, t, _ in rows if 1000 <= i < 1100 for i in [i - 1000])
    assert {r["__removed"] for r in out.collect()} == {7}
    n = {r.doc_id: r.n_removed for r in line_dedup.digest(d).collect()}
    assert all(n[i] == (0 if t is None else t.count("\n") - want[i].count("\n") + (want[i] == "" and t != "")) for i, t, _ in rows)


def test_op3_counts_every_site_of_a_line(spark, tmp_path):
    from strandloom.llm import queries

    copied = words(20) + "\n" + words(20)
    rows = [(100 + i, copied, f"site{i}") for i in range(10)] + [(200, copied.split("\n")[0] + "\nown", "site0")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_removed, r.text) for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {**{100 + i: (2, "") for i in range(10)}, 200: (1, "own")}


def test_clashing_names_are_replaced(spark):
    d = frame(spark, [(1, words(60), "a")]).select("*", *[F.lit(7).alias(c) for c in quality.NEW])
    assert [r.n_words for r in quality.judged(d, "doc_id", "n_words", "kept").collect()] == [60]
    assert quality.stage(d).columns == d.columns
