"""HTML extraction on pages that are put together from known blocks: what must stay and what must go is known beforehand."""

import random
from html import escape

import pytest
from strandloom.llm.html_text import main_text

WORDS = "market river stone winter letter garden engine paper theory window silver morning number village question answer".split()


def sentence(rng, n=None):
    words = [rng.choice(WORDS) for _ in range(n or rng.randint(12, 40))]
    return ", ".join([" ".join(words[:5]).capitalize(), " ".join(words[5:])]) + "."


def article_blocks(rng):
    """(html, texts) of one part of an article."""
    s, t = sentence(rng), sentence(rng)
    refs = [sentence(rng, 8) for _ in range(4)]
    rows = [[rng.choice(WORDS), str(rng.randint(1, 99))] for _ in range(3)]
    return rng.choice([
        (f"<p>{s}</p>", [s]),
        (f"<p>{escape('a < b & c')} {s}<p>{t}", [f"a < b & c {s}", t]),
        (f"<h2>{s[:30]}</h2><p>{t}</p>", [s[:30].strip(), t]),
        (f"<ul><li>{s}</li><li>{t}</ul>", [s, t]),
        (f"<blockquote><p>{s}</p></blockquote>", [s]),
        (f"<section id='discussion'><h3>Discussion</h3><p>{s}</p></section>", ["Discussion", s]),
        (f"<section id=related-work><p>{s}</p></section>", [s]),
        (f"<p class='notice'>{s}</p>", [s]),
        (f"<h2 id=search>Search</h2><p>{s}</p>", ["Search", s]),
        (f"<div class=social><p>{s}</p><p>{t}</p></div>", [s, t]),
        ("<table class=share><tr><th>Share</th><th>Percent</th></tr>" + "".join(f"<tr><td>{a}<td>{b}</tr>" for a, b in rows) + f"</table><p>{s}</p>", ["Share", "Percent", *[c for r in rows for c in r], s]),
        (f"<p>{s} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {t}</p>", [f"{s} x=2 {t}"]),
        ("<h2>References</h2><ol>" + "".join(f"<li><a href='/{i}'>{r}</a></li>" for i, r in enumerate(refs)) + "</ol>", ["References", *refs]),
        (f"<p>See <a class=related href=x>the other {s}</a> {t}</p>", [f"See the other {s} {t}"]),
    ])


def noise(rng, inside):
    """What goes: outside an article, or (inside) between its blocks."""
    s = sentence(rng)
    menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in rng.sample(WORDS, 5))
    both = [
        f"<div class='ad'>{s}</div>", f"<div id=comments><p>{s}</p><p>{s}</p></div>", f"<aside><p>{s}</p></aside>", f"<form><p>{s}</p><input name=q></form>",
        f"<script>var a = '<p>{s}</p>';</script>", f"<style>p{{color:red}} /* {s} */</style>", f"<!-- <p>{s}</p> -->", f"<nav><ul>{menu}</ul></nav>",
        f"<div class='cookie-consent'><p>{s}</p></div>", f"<ul class=related>{menu}</ul>", "<div class='share'>Share this</div>", f"<div class='social'>{menu}</div>",
        f"<div class=newsletter><p>{s}</p></div>", f"<div class=feedback><p>{s}</p><input name=mail></div>", f"<p hidden>{s}</p>", f"<noscript>{s}</noscript>", f"<footer><p>{s}</p></footer>",
    ]
    outside = [f"<header><p>{s}</p></header>", f"<div id=menu><ul>{menu}</ul></div>", f"<div class='alert'><p>{s}</p></div>", f"<section id=discussion><p>{s}</p></section>", f"<div class='related-posts'><p>{s}</p></div>"]
    return rng.choice(both if inside else both + outside)


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main>{}</main>", "<div id=page><article><div class=body>{}</div></article></div>", "<div role=main>{}</div>"])
def test_blocks_of_made_pages(shell):
    for seed in range(150):
        rng = random.Random(seed)
        parts, want = [f"<h1>Title {seed}</h1>"], [f"Title {seed}"]
        lead = sentence(rng, 60)
        parts.append(f"<p>{lead}</p>")
        want.append(lead)
        for _ in range(rng.randint(3, 9)):
            if rng.random() < 0.4:
                parts.append(noise(rng, True))
            html, texts = article_blocks(rng)
            parts.append(html)
            want += texts
        around = [noise(rng, False) for _ in range(4)]
        page = "<!DOCTYPE html><html><head><title>t</title></head><body>" + "".join(around[:2]) + shell.format("".join(parts)) + "".join(around[2:]) + "</body></html>"
        assert main_text(page).split("\n\n") == want, (seed, page)


def test_menu_before_the_first_paragraph():
    links = "".join(f"<li><a href=/{w}>{w}</a>" for w in WORDS[:6])
    page = f"<main><ul>{links}</ul><h1>Head</h1><div class=toc><ul>{links}</ul></div><p>First paragraph, long enough to be one, it seems.</p><p>Sources:</p><ul>{links}</ul></main>"
    assert main_text(page).split("\n\n") == ["Head", "First paragraph, long enough to be one, it seems.", "Sources:", *WORDS[:6]]


def test_soup_without_an_article():
    rng = random.Random(1)
    texts = [sentence(rng, 50) for _ in range(5)]
    links = "".join(f"<a href=/{w}>{w}</a> " for w in WORDS)
    page = f"<body><div class=top>{links}</div><table><tr><td>{links}</td><td><div>" + "".join(f"<p>{t}" for t in texts) + f"</div></td></tr></table><div>{links}</div>"
    assert main_text(page).split("\n\n") == texts
