"""Main text of web pages by minimum-cut labelling.

A page is read into blocks: runs of text between block-level tags, each with its chain of open elements. A classifier
gives each block a cost of being called content and one of being called boilerplate; these are the capacities to
the two terminals of a graph. Neighbouring blocks, and blocks of one grandparent element, are tied by smoothness
edges that weigh more the closer the two stand in the element tree. The minimum cut labels all blocks of a page at
once; content blocks are joined in page order.

The classifier adds up
* elements: article and main speak for content; nav, aside, footer, form and a page's header against;
* names (class, id, role): a name counts by its parts, so that `site-footer` and `comments` speak against, but
  `tag-python`, `has-sidebar` or `search-engines` don't. Names of elements that hold the page's main heading, main or
  article say what the page has, not what the element is, and don't count against it;
* the text: its element, length, links and sentence end. The weights of the last three are fitted (`fit`) to blocks
  that elements and names label clearly, on a bounded sample of pages; `TEXT` stands where there are too few.

Text of scripts, styles, templates, comments, drawings and hidden elements is markup and makes no block.
Tags that are never closed, or closed twice, don't break the reading.

Defined results: null or empty html, and pages without content, give an empty text. Repeated rows give equal
results, an empty table an empty table. Ties of the cut go to boilerplate. Pages of any length are read whole and
labelled by one cut; blocks whose own evidence outweighs all their ties are decided first, which doesn't change the
minimum. Columns of any other name may stand beside those read.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed values of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never read.
DROPPED = frozenset("script style noscript template iframe object canvas head select button textarea audio video title datalist".split())
DRAWN = frozenset(("svg", "math"))
RAW_TEXT = frozenset("script style textarea title noscript iframe xmp".split())
#: A start tag closes open elements of these kinds first.
CLOSES = {t: frozenset({"p"}) for t in BLOCK_TAGS - {"br", "body", "html", "head"}} | {
    "li": frozenset({"p", "li"}), "dt": frozenset({"p", "dt", "dd"}), "dd": frozenset({"p", "dt", "dd"}), "tr": frozenset({"p", "tr", "td", "th"}), "td": frozenset({"p", "td", "th"}), "th": frozenset({"p", "td", "th"}), "option": frozenset({"option"}),
}
#: Elements that such closing never reaches across.
SCOPES = frozenset("article aside section main div ul ol dl table nav header footer body html blockquote".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPACE = re.compile(r"[ \t\n\r\f\v  -     　 \u0085]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Parts of names (class, id, role) that speak against content, that do so weakly, that speak for it, and that say
#: nothing beside another part.
STRONG = frozenset(
    """ad ads advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsors sponsored promo promos promotion nav navbar navigation menu menus
    breadcrumb breadcrumbs sidebar sidebars footer masthead topbar cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login notice notices alert
    alerts pagination pager comment comments commentlist commentarea replies respond disqus toolbar contentinfo complementary share sharing related recommended recommendations widget widgets copyright""".split()
)
WEAK = frozenset("social legal privacy search tags tag tagcloud meta popular trending discussion byline header foot recent author bio toc skip aside reply teaser rail".split())
GOOD = frozenset("article post entry story content main body text prose hentry articlebody maincontent single".split())
NEUTRAL = frozenset(
    """site page top bottom left right box block wrap wrapper container inner outer list area section group row col column bar link links item items button buttons icon icons posts
    articles entries stories news blog global primary secondary mobile desktop sticky fixed form field title heading user reader readers slot unit google mega drop down dropdown policy full small large
    cloud id div reply level lvl even odd thread depth parent children and of the js media count card cards panel tab tabs info footer""".split()
)
#: Parts that make a name a property of something else.
MODIFIERS = frozenset("has no with without is not type category cat format status".split())
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*|[^\W\d_]+")
AGAINST_TAGS = frozenset("nav aside footer form menu dialog".split())

#: Weights of elements and names, and of the text (log odds of content). The three last of TEXT are fitted.
ARTICLE, MAIN, OUTSIDE, AGAINST, NAME = 4.0, 3.0, -6.0, -12.0, 12.0
TEXT = {"bias": -1.6, "paragraph": 1.5, "heading": 1.0, "list_item": -0.5, "legal": -3.0, "words": 0.9, "links": -3.5, "sentence": 0.5}
FITTED = ("words", "links", "sentence")
TEXT_LIMIT = 5.0
#: Strength of the ties between neighbours in page order, and between blocks of one grandparent.
ORDER_TIE, PARENT_TIE = 1.2, 1.0
#: Pages that weights are fitted on at most (about), and the fewest blocks of each label.
FIT_PAGES, FIT_LEAST = 2_000, 200


class Block:
    __slots__ = ("chain", "links", "text")

    def __init__(self, text: str, links: int, chain: tuple):
        self.text, self.links, self.chain = text, links, chain


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): entities.unescape((v or "").strip("\"'")) for k, v in _ATTRIBUTE.findall(text)} if text.strip(" /") else {}


def _after_drawing(page: str, tag: str, at: int) -> int:
    """Where a drawing or formula that begins before `at` ends; `at` itself if it never does."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}\b[^>]*>", re.I).finditer(page, at):
        depth += -1 if m.group(1) else not m.group(0).endswith("/>")
        if not depth:
            return m.end()
    return at


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order. A chain holds (number, tag, names) of the open elements, outermost first."""
    out: list[Block] = []
    stack: list[tuple[int, str, str, bool]] = []  # number, tag, names, whether its text is read
    parts: list[str] = []
    numbers, linked, in_link, at = 0, 0, 0, 0
    shown = True

    def end() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip(" ")
            if text:
                out.append(Block(text, min(linked, len(text)), tuple(s[:3] for s in stack)))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if shown and text:
            text = entities.unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    def close(k: int) -> None:
        nonlocal shown, in_link
        if any(s[1] in BLOCK_TAGS for s in stack[k:]):
            end()
        in_link = max(0, in_link - sum(s[1] == "a" for s in stack[k:]))
        del stack[k:]
        shown = not stack or stack[-1][3]

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        tag = name.lower()
        if m.group(1):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][1] == tag:
                    close(k)
                    break
            else:
                if tag in ("p", "br"):
                    end()
            continue
        if tag in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][1] in CLOSES[tag]:
                    close(k)
                    break
                if stack[k][1] in SCOPES:
                    break
        if tag in BLOCK_TAGS:
            end()
        if tag in VOID_TAGS:
            continue
        attributes = _attributes(m.group(3))
        names = " ".join([attributes[k] for k in ("class", "id", "role", "itemprop") if k in attributes])
        if tag in DRAWN and not m.group(3).endswith("/"):
            at = _after_drawing(page, tag, at)
            continue
        hidden = tag in DROPPED or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(_HIDDEN.search(attributes.get("style", "")))
        if m.group(3).endswith("/") and tag not in BLOCK_TAGS:
            continue
        numbers += 1
        stack.append((numbers, tag, names, shown and not hidden))
        shown = stack[-1][3]
        in_link += tag == "a"
        if tag in RAW_TEXT:
            stop = re.compile(rf"</{tag}\b", re.I).search(page, at)
            inner = page[at : stop.start()] if stop else page[at:]
            if tag not in DROPPED:
                say(inner)
            at = stop.start() if stop else n
    end()
    return out


_LEGAL = re.compile(r"^(?:©|\(c\)|copyright\b|all rights reserved\b)", re.I)
_SENTENCE = re.compile(r"[.!?…。！？:;][\"'”’»)\]]*$")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


@lru_cache(4096)
def name_evidence(names: str) -> tuple[float, float]:
    """How far names speak against content (-1 to 0) and for it (0 to 1)."""
    against, good = 0.0, 0.0
    for name in names.split():
        parts = [x.lower() for x in _PARTS.findall(name)]
        if not parts or not MODIFIERS.isdisjoint(parts):
            continue
        plain = all(x in STRONG or x in WEAK or x in GOOD or x in NEUTRAL for x in parts)
        if not STRONG.isdisjoint(parts):
            against = min(against, -1.0 if plain else -0.25)
        elif not WEAK.isdisjoint(parts):
            against = min(against, (-0.25 if len(parts) == 1 else -0.4) if plain else 0.0)
        elif plain and not GOOD.isdisjoint(parts):
            good = 0.2
    return against, good


def _holders(found: list[Block]) -> set[int]:
    """Numbers of the elements that hold main, the main heading or an article that isn't named against."""
    out: set[int] = set()
    for b in found:
        for k, (_, tag, names) in enumerate(b.chain):
            if tag in AGAINST_TAGS and tag != "form" or tag == "header":
                break
            if tag in ("main", "h1") or tag == "article" and name_evidence(names)[0] > -1:
                out.update(x[0] for x in b.chain[:k])
    return out


def place_odds(block: Block, holders: set[int]) -> float:
    """Log odds that a block is content, from its elements and their names."""
    against, good, within = 0.0, 0.0, 0.0
    for number, tag, names in block.chain:
        bad, fine = name_evidence(names) if names and tag not in ("body", "html") else (0.0, 0.0)
        if number in holders:
            bad = 0.0
            if tag == "form":
                tag = "div"
        if tag == "article":
            bad, within = (bad, within) if bad == -1 else (0.5 * bad, max(within, ARTICLE))
        elif tag == "main":
            bad, within = 0.0, max(within, MAIN)
        elif tag in AGAINST_TAGS or (tag == "header" and not within):
            bad = AGAINST / NAME
        elif not within and bad > -0.5 and "header" in names.lower() and tag == "div":
            bad = -0.5
        against, good = min(against, bad), max(good, fine)
    return NAME * (against + good) + within


def text_measures(block: Block) -> tuple[float, float, float]:
    """The measures whose weights are fitted: length, share of links, sentence end."""
    return min(log2(1 + block.text.count(" ") + 1), 6.0) - 1, block.links / len(block.text), float(bool(_SENTENCE.search(block.text)))


def text_odds(block: Block, weights: dict[str, float]) -> float:
    """Log odds that a block is content, from its text and innermost block element."""
    last = next((t for _, t, _ in reversed(block.chain) if t in BLOCK_TAGS), "")
    kind = "paragraph" if last in ("", "p", "blockquote", "pre") else "heading" if last in HEADINGS else "list_item" if last == "li" else None
    out = weights["bias"] + (weights[kind] if kind else 0.0) + (weights["legal"] if _LEGAL.match(block.text) else 0.0)
    out += sum(weights[k] * x for k, x in zip(FITTED, text_measures(block), strict=True))
    return max(-TEXT_LIMIT, min(TEXT_LIMIT, out))


def content_odds(found: list[Block], weights: dict[str, float]) -> list[float]:
    holders = _holders(found)
    places = [place_odds(b, holders) for b in found]
    inside = sum(len(b.text) for b, p in zip(found, places, strict=True) if p >= MAIN)
    other = sum(len(b.text) - b.links for b, p in zip(found, places, strict=True) if AGAINST / 2 < p < MAIN)
    # where article and main hold most of what could be content, the rest of the page is less likely to be
    outside = OUTSIDE if inside > other else 0.0
    return [p + text_odds(b, weights) + (outside if p < MAIN else 0.0) for b, p in zip(found, places, strict=True)]


def minimum_cut(content: list[float], other: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the content terminal. content and other: capacities to the terminals, i.e. what it costs
    to label a node otherwise. Augments shortest paths level by level."""
    n = len(content)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    edges: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, c: float, back: float) -> None:
        edges[a].append(len(to))
        to.append(b)
        room.append(c)
        edges[b].append(len(to))
        to.append(a)
        room.append(back)

    for k in range(n):
        through = min(content[k], other[k])  # flows straight from terminal to terminal
        if content[k] > through:
            edge(source, k, content[k] - through, 0.0)
        elif other[k] > through:
            edge(k, sink, other[k] - through, 0.0)
    for a, b, c in ties:
        edge(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        line = deque([source])
        while line:
            a = line.popleft()
            for e in edges[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    line.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if room[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[a] < len(edges[a]):
                e = edges[a][turn[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if not path:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]
                continue
            path.append(e)
            a = to[e]


def _distance(a: Block, b: Block) -> int:
    """Steps in the element tree between two blocks, at least 1; more across an element that speaks against content."""
    common = 0
    for x, y in zip(a.chain, b.chain, strict=False):
        if x[0] != y[0]:
            break
        common += 1
    apart = [*a.chain[common:], *b.chain[common:]]
    return max(1, len(apart)) + 20 * sum(t in AGAINST_TAGS or t in ("header", "article", "main") or bool(n) and name_evidence(n)[0] == -1 for _, t, n in apart)


def ties_of(found: list[Block]) -> list[tuple[int, int, float]]:
    """At most two ties per block: to the one before, and to the last one of the same grandparent."""
    out, last_of = [], {}
    for k, b in enumerate(found):
        if k:
            out.append((k - 1, k, ORDER_TIE * 2 / (1 + _distance(found[k - 1], b))))
        grand = b.chain[-2][0] if len(b.chain) > 1 else 0
        j = last_of.get(grand)
        if j is not None and j < k - 1:
            out.append((j, k, PARENT_TIE / _distance(found[j], b)))
        last_of[grand] = k
    return out


def labels(odds: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Content or not, for each block of a page, by the minimum cut. A block whose odds outweigh all its ties takes its own
    side in every minimum cut, and then only shifts the odds of its neighbours; what is left falls into parts."""
    n, odds = len(odds), list(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in ties:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    fixed: list[bool | None] = [None] * n
    line = list(range(n))
    while line:
        k = line.pop()
        if fixed[k] is None and abs(odds[k]) > sum(near[k].values()) + 1e-9:
            fixed[k] = odds[k] > 0
            for j, c in near[k].items():
                odds[j] += c if fixed[k] else -c
                del near[j][k]
                line.append(j)
            near[k] = {}
    for first in range(n):
        if fixed[first] is None:
            part, seen = [first], {first: 0}
            for k in part:
                for j in near[k]:
                    if j not in seen:
                        seen[j] = len(part)
                        part.append(j)
            inner = [(seen[k], seen[j], c) for k in part for j, c in near[k].items() if seen[k] < seen[j]]
            for k, good in zip(part, minimum_cut([max(odds[k], 0.0) for k in part], [max(-odds[k], 0.0) for k in part], inner), strict=True):
                fixed[k] = good
    return [bool(x) for x in fixed]


def main_text(page: str | None, weights: dict[str, float] = TEXT) -> str:
    found = blocks(page) if isinstance(page, str) else []
    return "\n".join([b.text for b, good in zip(found, labels(content_odds(found, weights), ties_of(found)), strict=True) if good])


def fit(pages: DataFrame, html: str = "html") -> dict[str, float]:
    """Weights of the text measures: Fisher's discriminant between blocks that stand clearly in an article or main and blocks
    that stand clearly outside, on about FIT_PAGES pages (all, if there are no more). Only sums reach the driver."""
    rows = pages.select(F.col(f"`{html}`").alias("html")).filter("html IS NOT NULL")
    share = max(1.0, rows.count() / FIT_PAGES)
    sample = rows.filter(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < 1_000_000 / share)
    d = len(FITTED)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 1 + d + d * d))
        for pdf in batches:
            for page in pdf["html"]:
                found = blocks(page)
                holders = _holders(found)
                for b in found:
                    place = place_odds(b, holders)
                    if abs(place) >= MAIN:
                        x = np.array(text_measures(b))
                        sums[int(place > 0)] += [1.0, *x, *np.outer(x, x).ravel()]
        yield pd.DataFrame({"label": [0, 1], "sums": sums.tolist()})

    parts = sample.mapInPandas(run, "label int, sums array<double>").select("label", F.posexplode("sums"))
    got = np.zeros((2, 1 + d + d * d))
    for r in parts.groupBy("label", "pos").agg(F.sum("col").alias("x")).collect():  # 2 * (1 + d + d * d) rows
        got[r["label"], r["pos"]] = r["x"]
    n = got[:, 0]
    if n.min() < FIT_LEAST:
        return dict(TEXT)
    mean = got[:, 1 : 1 + d] / n[:, None]
    spread = sum(got[k, 1 + d :].reshape(d, d) - n[k] * np.outer(mean[k], mean[k]) for k in (0, 1)) / n.sum()
    w = np.linalg.solve(spread + 0.05 * np.eye(d), mean[1] - mean[0])
    # a longer text, fewer links and a sentence end never speak against content, and no measure decides alone
    low, high = [0.2, -6.0, 0.0], [1.5, -1.0, 1.5]
    return TEXT | dict(zip(FITTED, np.clip(w, low, high).round(4).tolist(), strict=True))


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), weights: dict[str, float] | None = None) -> DataFrame:
    """The columns `keep` of each row, `text` and `n_chars` (its code points). Weights are fitted if none are given."""
    weights = weights or fit(pages, html)
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [main_text(t, weights) for t in pdf["_html"]]
            yield pdf.drop(columns="_html").assign(text=text, n_chars=[len(t) for t in text])

    rows = pages.selectExpr(*[f"`{c}`" for c in keep], f"`{html}` AS _html")
    return rows.mapInPandas(run, f"{fields}, text string, n_chars long")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
