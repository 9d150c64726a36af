"""HTML extraction by tree scoring.

A page becomes a tree (implied end tags, raw-text elements and broken markup are dealt with). Elements that are no article
text by their nature (scripts, menus, forms, asides, ...) or by role, class or id (adverts, cookie banners, reader comments, ...)
are dropped. Names that an article uses for its own parts as well (discussion, related work, notice, share, ...) drop an element outside an article or
main element; inside one they are only a doubt, which must be borne out: by many links, by form controls or by a scrap of text without a sentence.
Every paragraph passes points for its length and commas to its ancestors, fewer with each level, and a
container's points are discounted by its link density. The best container is kept, up to the article or main element
it lies in, and so are its siblings with enough points. Bare link lists are dropped outside an article or main element, and inside one if they come
before its first paragraph. The text is put out by
blocks: white space in a block becomes one space, blocks are joined by an empty line. Of containers with equal points the first one is the best.

Defined results: null, empty and textless pages give an empty text; a page of any length is read whole; repeated rows give
the same text; extra columns pass through, one with the name of a new column is replaced.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_columns, with_workers

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes noembed xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary"
    " table tbody td tfoot th thead tr ul caption".split()
)
NO_TEXT = frozenset(
    "script style noscript template textarea title head nav footer aside form button select option datalist iframe object"
    " embed svg canvas audio video menu dialog search noframes noembed applet input annotation annotation-xml".split()
)
CONTROLS = frozenset("input textarea select button form".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Their names never cast doubt on them: what they head or hold decides.
PLAIN = frozenset("h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th caption figure figcaption math".split())
#: An opening tag ends these open elements, if they lie above the nearest element of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
_SCOPE = frozenset("html body table td th caption button object article section main div".split())

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
#: Words in class or id that mark what is no article text.
_JUNK = re.compile(
    r"(?:^|[\s_-])(?:ads?|adsense|advert\w*|adslot|adbox|sponsor\w*|promo\w*|cookies?|consent|gdpr|newsletter|"
    r"subscri\w*|signup|popups?|modal|overlay|sidebar\w*|sidenav|navbar|navigation|nav|menus?|submenu|breadcrumbs?|footer|masthead|"
    r"comments?|commentlist|disqus|replies|respond|widgets?|login|pagination|pager|toolbar|skip|copyright|outbrain|taboola)(?:$|[\s_-])"
)
#: Words that an article's own parts bear, too.
_DOUBT = re.compile(
    r"(?:^|[\s_-])(?:banner|notices?|alerts?|disclaimer|reactions|share|sharing|social|related|recommend\w*|search|discussion|responses|feedback|toc)"
    r"(?:$|[\s_-])"
)
_STOP = re.compile(r"[.!?…](?=[\s\"')\]]|$)|[。！？]")
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|topbar|top-bar)(?:$|[\s_-])")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

LEAST_PARAGRAPH = 25
LEVELS = 6
#: Doubt is borne out by this share of link text, or by a text that is shorter and has no sentence.
DOUBT_LINKS, DOUBT_SCRAP = 1 / 3, 60


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        name = (m[1] or m[5]).lower()
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(name, unescape(value) if "&" in value else value)
    return out


class Page:
    """A page's elements in document order, as parallel lists; pieces are (element, text), text None where a block begins or ends."""

    def __init__(self, html: str):
        self.tag, self.up, self.drop, self.block, self.link = ["#root"], [-1], [False], [0], [False]
        self.inside = [False]  # an article or main element
        self.doubt: list[int] = []
        self.controls = [0]  # form controls right inside
        self.pieces: list[tuple[int, str | None]] = []
        self._parse(html)

    def _open(self, tag: str, raw: str, top: int) -> int:
        i = len(self.tag)
        junk = tag in NO_TEXT
        keep = tag in ("article", "main", "body", "html")
        inside = self.inside[top] or tag in ("article", "main")
        if tag == "header" and not self.inside[top]:
            junk = True
        if raw and not raw.isspace() and not junk:
            at = _attributes(raw)
            role = at.get("role", "").lower()
            inside = inside or role in ("main", "article") or at.get("itemprop", "") == "articleBody"
            name = _CAMEL.sub("-", f"{at.get('class', '')} {at.get('id', '')}").lower()
            junk = (
                role in _ROLES
                or "hidden" in at
                or at.get("aria-hidden", "").lower() == "true"
                or bool(at.get("style") and _HIDDEN.search(at["style"].lower()))
                or (not keep and bool(_JUNK.search(name)))
                or (not keep and not self.inside[top] and bool(_DOUBT.search(name)))
                or (not keep and not self.inside[top] and bool(_HEADER.search(name)))
            )
            if not junk and not keep and self.inside[top] and tag in BLOCK and tag not in PLAIN and _DOUBT.search(name):
                self.doubt.append(i)
        self.tag.append(tag)
        self.up.append(top)
        self.drop.append(junk or self.drop[top])
        self.block.append(i if tag in BLOCK else self.block[top])
        self.link.append(tag == "a" or self.link[top])
        self.inside.append(inside)
        self.controls.append(0)
        self.controls[top] += tag in CONTROLS
        return i

    def _parse(self, html: str) -> None:
        stack, pos, pieces, size = [0], 0, self.pieces, len(html)
        tags = self.tag
        last = html.rfind(">") + 1  # no tag ends beyond it

        def close(depth: int) -> None:
            if any(tags[x] in BLOCK for x in stack[depth:]):
                pieces.append((stack[depth], None))
            del stack[depth:]

        while pos < size:
            m = _TAG.search(html, pos, last) if pos < last else None
            if m is None:
                pieces.append((stack[-1], html[pos:].partition("<!--")[0]))
                break
            if m.start() > pos:
                pieces.append((stack[-1], html[pos : m.start()]))
            pos = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            tag = name.lower()
            raw = m[3] if m[2] else m[6]
            if m[1] or m[4]:
                if tag == "br":
                    pieces.append((stack[-1], " "))
                elif tag == "p" and not any(tags[x] == "p" for x in stack):
                    pieces.append((stack[-1], None))
                else:
                    for k in range(len(stack) - 1, 0, -1):
                        if tags[stack[k]] == tag:
                            close(k)
                            break
                        if tag not in BLOCK and tags[stack[k]] in ("td", "th", "table", "body", "html"):
                            break
                continue
            if tag in VOID:
                self.controls[stack[-1]] += tag in CONTROLS
                pieces.append((stack[-1], None if tag == "hr" else " " if tag == "br" else ""))
                continue
            if tag in BLOCK:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == "p":
                        close(k)
                        break
                    if tags[stack[k]] in _SCOPE:
                        break
                if tag in ENDS:
                    ended, scope = ENDS[tag]
                    for k in range(len(stack) - 1, 0, -1):
                        if tags[stack[k]] in ended:
                            close(k)
                            break
                        if tags[stack[k]] in scope:
                            break
                if tag[0] == "h" and tag[1:].isdigit() and tags[stack[-1]][0] == "h" and tags[stack[-1]][1:].isdigit():
                    close(len(stack) - 1)
                pieces.append((stack[-1], None))
            elif tag == "a":
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == "a":
                        close(k)
                        break
                    if tags[stack[k]] in BLOCK:
                        break
            i = self._open(tag, raw, stack[-1])
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, pos)
                pos = end.end() if end else size
                continue
            if not (raw.endswith("/") and tag in ("svg", "path", "use")):
                stack.append(i)

    def _measured(self) -> None:
        """The text's pieces without dropped ones, and what each element and all inside it hold."""
        up, drop, n = self.up, self.drop, len(self.tag)
        self.own, self.own_link, self.commas, stops = [0] * n, [0] * n, [0] * n, [0] * n
        self.shown = []
        for i, t in self.pieces:
            if drop[i]:
                if t is None:
                    self.shown.append((i, None))
                continue
            if t:
                t = unescape(t) if "&" in t else t
                size = len(t) if not t.isspace() else 0
                b = self.block[i]
                self.own[b] += size
                self.commas[b] += t.count(",") + t.count("，") + t.count("、")
                if self.link[i]:
                    self.own_link[b] += size
                if self.doubt and _STOP.search(t):
                    stops[i] += 1
            self.shown.append((i, t))
        self.length, links, self.n_links, self.stops, self.inputs = self.own[:], self.own_link[:], [0] * n, stops, self.controls[:]
        for i in range(n - 1, 0, -1):
            p = up[i]
            self.length[p] += self.length[i]
            links[p] += links[i]
            self.n_links[p] += self.n_links[i] + (self.tag[i] == "a" and not drop[i])
            self.stops[p] += self.stops[i]
            self.inputs[p] += self.inputs[i]
        self.density = [links[i] / self.length[i] if self.length[i] else 0.0 for i in range(n)]

    def _settle_doubts(self) -> bool:
        """Drops the doubtful elements whose doubt is borne out; whether there was one."""
        found = False
        for i in self.doubt:
            if self.density[i] > DOUBT_LINKS or self.inputs[i] or (self.length[i] < DOUBT_SCRAP and not self.stops[i]):
                self.drop[i] = found = True
        if found:
            for i in range(1, len(self.tag)):
                self.drop[i] = self.drop[i] or self.drop[self.up[i]]
        return found

    def text(self) -> str:
        tag, up, drop, n = self.tag, self.up, self.drop, len(self.tag)
        self._measured()
        if self.doubt and self._settle_doubts():
            self._measured()
        own, own_link, commas, length, n_links, density, pieces = self.own, self.own_link, self.commas, self.length, self.n_links, self.density, self.shown
        score = [0.0] * n
        # The first paragraph of an article or main element: bare link lists before it are menus.
        first = next((i for i in range(n) if self.inside[i] and own[i] >= LEAST_PARAGRAPH and own_link[i] < 0.5 * own[i] and tag[i] not in HEADS), n)
        for i in range(n):
            if own[i] < LEAST_PARAGRAPH or drop[i] or self.block[i] != i:
                continue
            points = (1 + commas[i] + min(own[i] // 100, 3)) * (1 - own_link[i] / own[i])
            at, level = (i, 0) if tag[i] in ("div", "section", "article", "main", "body", "#root", "center") else (self._above(i), 0)
            while at >= 0 and level < LEVELS:
                score[at] += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                at, level = self._above(at), level + 1
        best = max(range(n), key=lambda i: (score[i] * (1 - density[i]), -i))
        if score[best] <= 0:
            best = next((i for i in range(n) if tag[i] in ("article", "main") and length[i] and not drop[i]), 0)
        root = best
        for want in ("article", "main"):
            at = best
            while at > 0 and tag[at] != want:
                at = up[at]
            if at > 0:
                root = at
                break
        keep = [False] * n
        least = max(10.0, 0.2 * score[best] * (1 - density[best]))
        for i in range(n):
            p = up[i]
            keep[i] = i == root or (p >= 0 and keep[p])
            if not keep[i] and i and p == up[root] and not drop[i]:
                long_p = tag[i] == "p" and length[i] > 80 and density[i] < 0.25
                keep[i] = long_p or score[i] * (1 - density[i]) >= least
            bare = n_links[i] >= 3 and density[i] > 0.6 and tag[i] in ("ul", "ol", "dl", "div", "section", "table", "p")
            if keep[i] and i != root and bare and (i < first if self.inside[i] else True):
                keep[i] = False
                drop[i] = True
            if p >= 0 and drop[p]:
                drop[i] = True
        blocks, run = [], []
        for i, t in [*pieces, (0, None)]:
            if t is None:
                if run and (joined := " ".join("".join(run).split())):
                    blocks.append(joined)
                run = []
            elif keep[i] and not drop[i]:
                run.append(t)
        return "\n\n".join(blocks)

    def _above(self, i: int) -> int:
        """The next block element above."""
        return self.block[self.up[i]] if self.up[i] >= 0 else -1


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


def extracted(pages: DataFrame, at: str = "text", keep: list[str] | None = None) -> DataFrame:
    """pages (its columns `keep`, all by default) with the main text of html."""
    with_workers(pages.sparkSession)
    keep = kept_columns(pages.columns if keep is None else keep, at)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.select(keep).columns, pa.array([main_text(h) for h in b.column("html").to_pylist()], pa.string())], [*keep, at])

    return pages.select(*dict.fromkeys([*keep, "html"])).mapInArrow(run, T.StructType([*(pages.schema[k] for k in keep), T.StructField(at, T.StringType())]))


def digest(pages: DataFrame) -> DataFrame:
    return extracted(pages, keep=["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
