"""Main text of web pages by minimum-cut labelling.

A page is read into text blocks with their place in the DOM. A linear classifier turns the
features of a block (length, sentence end, link density, tag, its parent's share of the page's
text, wording of notices, and the tags, classes and ids around it) into the odds that it is
content; the costs of either label become the capacities of its edges to the two terminals.
Blocks next to each other on the page, and blocks near each other in the DOM, are tied by
smoothness edges of like strength, so a block that looks doubtful alone follows its neighbours.
A maximum flow gives the minimum cut: the labelling of least total cost. Scripts, styles, forms
and the like never become blocks.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopledger.plans.shipping import ship

# Fixed values of HTML: elements without content, with raw content, and that lie in lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp noscript template".split())
DROPPED = frozenset("head form button select option optgroup datalist svg math canvas audio video object map dialog".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output"
    " progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: A start tag closes an open element of these, as far up as a container.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "option": ("option",),
}
CONTAINERS = frozenset("ul ol dl table body html article section main div td th aside nav header footer".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
_NAME = re.compile(r"[a-z0-9]+")

#: Words in classes, ids and roles that name what surrounds an article, that may do so, and that name articles.
_AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav"
    " navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs header masthead footer sidebar sidenav"
    " aside cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup"
    " login share sharing social related recommended recommendations trending pagination pager comment comments"
    " commentlist disqus reply replies respond discussion feedback hidden complementary contentinfo".split()
)
_PERHAPS = frozenset(
    "topbar foot bottombar side rail widget widgets overlay toast register search more popular toolbar legal"
    " copyright disclaimer form".split()
)
_WITHIN = frozenset("article post entry story content maincontent main body text prose copy".split())
#: Fixed wording of notices and invitations, in lower case.
_NOTICE = (
    "cookie", "cookies", "all rights reserved", "©", "privacy policy", "terms of use", "terms of service", "subscribe",
    "sign up", "log in", "read more", "share this", "advertisement", "click here", "powered by",
)
_NOTICE_WORDS = re.compile("|".join(w if w == "©" else rf"\b{w}\b" for w in _NOTICE))
_SENTENCE = re.compile(r"""[.!?…。][\s"'”’»)\]]*\Z""")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PROSE = frozenset("p blockquote pre".split()) | _HEADINGS

#: Log odds that an element's name, or its kind, gives all text within.
NAMED, MAYBE_NAMED, ARTICLE = -6.0, -2.5, 1.5


@dataclass
class Block:
    """Text of a run of lines, and what the classifier is told about it."""

    text: str
    path: tuple[int, ...]  # numbers of the open elements, outermost first
    tag: str
    linked: int
    named: float  # log odds from the names of enclosing elements


@dataclass
class _Open:
    tag: str
    number: int
    named: float


@dataclass
class _Reader:
    """Reads one page in a single pass."""

    open: list[_Open] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    count: int = 0
    dropped: int = 0
    anchors: int = 0  # open <a> elements

    def text(self, raw: str) -> None:
        if not self.dropped and raw:
            plain = html.unescape(raw) if "&" in raw else raw
            self.parts.append(plain)
            if self.anchors:
                self.links.append(plain)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            blocks = [e for e in self.open if e.tag not in INLINE]
            self.blocks.append(
                Block(
                    text, tuple(e.number for e in blocks), blocks[-1].tag if blocks else "body",
                    len(" ".join("".join(self.links).split())),
                    min(2 * ARTICLE, max(NAMED, sum(e.named for e in blocks))),
                )
            )
        self.parts, self.links = [], []

    def pop(self) -> None:
        tag = self.open.pop().tag
        self.dropped -= tag in DROPPED
        self.anchors -= tag == "a"

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            if self.open and tag not in VOID:
                self.close_implied(tag)
        if tag in VOID or tag in ("html", "body") and any(e.tag == tag for e in self.open):
            return
        self.count += 1
        self.open.append(_Open(tag, self.count, self.looks(tag, attributes)))
        self.dropped += tag in DROPPED
        self.anchors += tag == "a"

    def close_implied(self, tag: str) -> None:
        while self.open and self.open[-1].tag in INLINE and any(e.tag == "p" for e in self.open):
            self.pop()  # lines of an open paragraph end with it
        if self.open and self.open[-1].tag == "p":
            self.pop()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in CLOSES.get(tag, ()):
                while len(self.open) > i:
                    self.pop()
            elif self.open[i].tag in CONTAINERS and self.open[i].tag not in CLOSES.get(tag, ()):
                break

    def end(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if tag in ("body", "html"):
            return  # what follows still belongs to the page
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                while len(self.open) > i:
                    self.pop()
                return
            if tag in INLINE and self.open[i].tag not in INLINE:
                return

    def looks(self, tag: str, attributes: str) -> float:
        words: set[str] = set()
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                words.add("hidden")
            elif name == "style":
                if re.search(r"display\s*:\s*none", value):
                    words.add("hidden")
            else:
                words.update(_NAME.findall(value))
        in_article = any(e.tag in ("article", "main") for e in self.open)
        around = tag in ("nav", "aside", "menu", "footer") or tag == "header" and not in_article
        within = tag in ("article", "main") or bool(words & _WITHIN)
        if tag in ("html", "body", "article", "main") or words & _WITHIN:
            named = around or bool(words & {"comment", "comments", "hidden", "reply", "replies"})
        else:
            named = around or bool(words & _AROUND)
        if named:
            return NAMED
        return ARTICLE if within else MAYBE_NAMED if words & _PERHAPS else 0.0


def read_blocks(page: str) -> list[Block]:
    """Text blocks of a page in order; linear in its length."""
    reader, at, pattern = _Reader(), 0, _TAG
    while at < len(page):
        tag_at = page.find("<", at)
        if tag_at < 0:
            break
        if page.startswith("<!--", tag_at):
            reader.text(page[at:tag_at])
            end = page.find("-->", tag_at + 4)
            at = len(page) if end < 0 else end + 3
            continue
        following = page[tag_at + 1 : tag_at + 2]
        if following in ("!", "?"):
            reader.text(page[at:tag_at])
            end = page.find(">", tag_at)
            at = len(page) if end < 0 else end + 1
            continue
        m = pattern.match(page, tag_at)
        if not m and pattern is _TAG and (m := _LOOSE_TAG.match(page, tag_at)):
            pattern = _LOOSE_TAG  # a quote that never ends: from here on quotes mean nothing
        if not m:
            name = following.isalpha() or following == "/"
            reader.text(page[at:tag_at] if name else page[at : tag_at + 1])
            end = page.find(">", tag_at) if name else tag_at
            at = len(page) if end < 0 else end + 1
            continue
        reader.text(page[at:tag_at])
        at, tag = m.end(), m[2].lower()
        if m[1]:
            reader.end(tag)
        elif tag in RAW:
            end = _end_of(page, tag, at)
            if tag not in INLINE:
                reader.flush()
            at = end
        else:
            reader.start(tag, m[3])
            if m[3].endswith("/") and tag in ("svg", "math"):
                reader.end(tag)
    reader.text(page[at:])
    reader.flush()
    return reader.blocks


_CLOSERS = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}


def _end_of(page: str, tag: str, at: int) -> int:
    m = _CLOSERS[tag].search(page, at)
    return m.end() if m else len(page)


def content_odds(blocks: Sequence[Block]) -> list[float]:
    """Log odds of each block that it is content; no feature of the text outweighs a clear name."""
    mass: dict[tuple[int, ...], int] = {}
    for b in blocks:
        mass[b.path[:-1]] = mass.get(b.path[:-1], 0) + len(b.text) - b.linked
    most = max(mass.values(), default=0) or 1
    odds = []
    for b in blocks:
        x = b.named - 5.0 * b.linked / len(b.text)
        x += min(b.text.count(" ") + 1, 40) / 20 - 1.0
        x += 1.0 if _SENTENCE.search(b.text[-20:]) else 0.5 if b.tag in _HEADINGS else -0.5
        x += 1.0 if b.tag in _PROSE else 0.3 if b.tag in ("li", "td", "th", "dd", "dt") else -0.3
        x += 2.0 * math.sqrt(max(mass[b.path[:-1]], 0) / most) - 1.0
        low = b.text.lower()
        if any(w in low for w in _NOTICE):
            x -= 2.0 * min(2, sum(1 for _ in _NOTICE_WORDS.finditer(low)))
        odds.append(x)
    return odds


#: Strength of the tie between siblings, its decay per further step in the DOM, the share of it
#: between blocks of different tags, and the share between siblings that do not touch.
TIE, DECAY, UNLIKE, APART = 2.0, 0.6, 0.5, 0.25


def smoothness(blocks: Sequence[Block]) -> list[tuple[int, int, float]]:
    """Ties of each block to the one before, for its place and the nearness of both in the DOM."""
    ties = []
    for i in range(1, len(blocks)):
        a, b = blocks[i - 1].path, blocks[i].path
        common = 0
        while common < min(len(a), len(b)) and a[common] == b[common]:
            common += 1
        further = max(0, len(a) + len(b) - 2 * common - 2)
        like = 1.0 if blocks[i - 1].tag == blocks[i].tag else UNLIKE
        ties.append((i - 1, i, TIE * DECAY**further * like))
    # Blocks of one parent and tag are tied also where others stand between them.
    last: dict[tuple, int] = {}
    for i, block in enumerate(blocks):
        key = (block.path[:-1], block.tag)
        j = last.get(key)
        if j is not None and j < i - 1:
            ties.append((j, i, TIE * APART))
        last[key] = i
    return ties


def minimum_cut(odds: Sequence[float], ties: Sequence[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side (content) in the cut of least capacity.

    Terminal capacities are the costs of the opposite labels, log(1 + e^odds) for calling
    content boilerplate and log(1 + e^-odds) for the reverse. Flow is pushed along shortest
    augmenting paths, level by level.
    """
    n, unit = len(odds), 1_000_000
    source, sink = n, n + 1
    to: list[int] = []
    left: list[int] = []
    edges: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, there: float, back: float) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            edges[x].append(len(to))
            to.append(y)
            left.append(round(c * unit))

    def cost(x: float) -> float:
        return max(x, 0.0) + math.log1p(math.exp(-abs(x)))

    for i, x in enumerate(odds):
        # Only the difference of both costs can cross the cut; the rest flows straight through.
        if cost(x) >= cost(-x):
            edge(source, i, cost(x) - cost(-x), 0)
        else:
            edge(i, sink, cost(-x) - cost(x), 0)
    for a, b, w in ties:
        edge(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in edges[a]:
                if left[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                most = min(left[e] for e in path)
                for k, e in enumerate(path):
                    left[e] -= most
                    left[e ^ 1] += most
                full = next(k for k, e in enumerate(path) if left[e] == 0)
                a = to[path[full] ^ 1]
                del path[full:]
                continue
            while turn[a] < len(edges[a]):
                e = edges[a][turn[a]]
                if left[e] > 0 and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(edges[a]):
                path.append(edges[a][turn[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                turn[a] += 1
            else:
                break


def main_text(page: str | None) -> str:
    """The article's blocks, joined by empty lines."""
    blocks = read_blocks(page or "")
    kept = minimum_cut(content_odds(blocks), smoothness(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


@F.pandas_udf(T.StringType())
def _main_text(page: pd.Series) -> pd.Series:
    return page.map(main_text)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns but ``html``, and ``text``, the main text of each page.

    Null, empty and text-free pages give the empty text; repeated rows stay, each with its text, and
    an empty table gives no rows. Pages are read whole, whatever their length, one at a time. Nulls in
    other columns pass through. A column named ``text`` in the input is replaced; any other name stays.
    """
    ship(pages.sparkSession)
    others = [F.col(f"`{c}`") for c in pages.columns if c not in (html, "text")]
    return pages.select(*others, _main_text(F.coalesce(F.col(f"`{html}`"), F.lit(""))).alias("text"))


def op6(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
