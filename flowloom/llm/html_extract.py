"""Operator 3: main text of HTML pages from flat text blocks.

A page is read once, from start to end, into flat text blocks: the text between two block-level
tags. A block has its number of words and its link density (the share of its words inside links),
those of the blocks before and after it, whether it is a heading, ends like a sentence and has long
text before and behind it, and what its elements say: the innermost telling one (article or
boilerplate), whether any is boilerplate or a form, and how classes, ids and roles read, near and
all around. A decision tree trained on the small labelled table of ``html_labels`` tells main text
from the rest. Names are only features: pages of the table have none, or such that mislead.

Text in an inline element with a boilerplate name is a block of its own behind the one it stands in.

Defined results: null and empty pages, and pages without a main-text block, have text "" and 0
characters; what is not closed ends with what it stands in, a table cell also with the next cell,
row or part of its table; containers are followed at any depth; an unclosed comment, script or
style runs to the end; unknown character references stay as they are. Repeated rows and null ids stay.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text

_TAG = re.compile(
    r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))",
    re.S,
)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br input".split())
_VOID = frozenset("br img input wbr".split())
#: Elements that stay open until they, or what they stand in, are closed.
_CONTAINER = frozenset("html body div section article main nav header footer aside form dialog menu fieldset noscript template svg math object canvas details figure table td ul ol dl blockquote center head select button".split())
#: Their start tags end an open cell of the same table, and so do the end tags of all but ``th``.
_ENDS_CELL = frozenset("td th tr tbody thead tfoot".split())
_BOILER_TAG = frozenset("nav footer aside dialog menu fieldset noscript template svg math object canvas head select button".split())
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_BOILER_NAME = re.compile(
    r"\b(?:ads?|adverts?|advertis\w*|adsense|sponsor\w*|promo\w*|banner|side ?bar|cookies?\w*|consent|gdpr|notices?|alert|comments?|commentlist|disqus|respond|replies|related|recommend\w*|share|sharing|social|"
    r"newsletters?|subscribe|subscription|signup|pop ?up|modal|overlay|breadcrumbs?|nav|navbar|navigation|menus?|footer|header|masthead|widgets?|login|search|pagination|pager|toolbar|copyright|contentinfo|complementary|form|tags|outbrain|taboola)\b"
)
_ARTICLE_NAME = re.compile(r"\b(?:articles?|content|post|entry|story|main|body|text)\b")
_SPACE = re.compile(r"\s+")

FEATURES = (
    "zone", "boiler_tag", "in_form", "name_near", "name_any", "name_share", "words", "link_density", "words_before", "words_after", "density_before", "density_after", "links",
    "heading", "sentence", "page_article", "long_before", "long_after",
)
#: How a name reads: nothing telling, like an article, like both, like boilerplate, hidden.
PLAIN, ARTICLE, BOTH, BOILER, HIDDEN = range(5)
#: Words of a long block.
LONG = 20


@dataclass
class Block:
    text: str
    words: int
    density: float
    links: int
    zone: int  # of the innermost telling element: 0 none, 1 article, 2 a header in an article, 3 boilerplate
    boiler_tag: bool
    in_form: bool
    name_near: int  # of the innermost element with a telling name
    name_any: int  # the most like boilerplate of all around
    named: int  # number of the element whose name is near
    heading: bool


@dataclass
class Open:
    """An open container and what is known inside it."""

    tag: str
    zone: int = 0
    boiler_tag: bool = False
    in_form: bool = False
    near: int = PLAIN
    worst: int = PLAIN
    named: int = 0


def reading(attrs: str) -> int:
    """How the class, id and role of an element read, and whether it is hidden."""
    names = []
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return HIDDEN
        if key in ("class", "id", "role"):
            names.append(value.replace("-", " ").replace("_", " "))
    name = " ".join(names)
    if not name:
        return PLAIN
    boiler, article = _BOILER_NAME.search(name), _ARTICLE_NAME.search(name)
    return (BOTH if article else BOILER) if boiler else ARTICLE if article else PLAIN


def inside(around: Open, tag: str, attrs: str, number: int) -> Open:
    name = reading(attrs) if attrs and tag not in ("html", "body") else PLAIN
    zone = 1 if tag in ("article", "main") else 3 if tag in _BOILER_TAG else (2 if around.zone in (1, 2) else 3) if tag == "header" else around.zone
    boiler = around.boiler_tag or tag in _BOILER_TAG or (tag == "header" and zone == 3)
    if tag in ("article", "main"):
        near = name if name >= BOILER else ARTICLE
    else:
        near = max(name, BOILER) if boiler and not around.boiler_tag else name
    return Open(tag, zone, boiler, around.in_form or tag == "form", near or around.near, max(around.worst, name), number if near else around.named)


def flat_blocks(page: str) -> list[Block]:
    blocks: list[Block] = []
    parts: list[tuple[str, bool]] = []
    asides: list[tuple[int, list[tuple[str, bool]]]] = []  # inline boilerplate in the block: its name's reading and parts
    into = parts
    stack = [Open("")]
    opened: dict[str, list[int]] = {}  # places in the stack, by name
    link = heading = False
    own = PLAIN  # of the element that the block is, if it is no container
    aside_tag, aside_depth = "", 0
    pos, n = 0, len(page)

    def close(name: str):
        """Closes the innermost element of the name, a cell only within its table, with all it holds."""
        places = opened.get(name)
        if places and (name != "td" or places[-1] > (opened.get("table") or [0])[-1]):
            at = places[-1]
            while len(stack) > at:
                opened[stack.pop().tag].pop()

    def put(found: list[tuple[str, bool]], name: int):
        text = _SPACE.sub(" ", "".join([_html.unescape(p) for p, _ in found])).strip() if any(not p.isspace() for p, _ in found) else ""
        if text:
            words = text.count(" ") + 1
            links = [p.split() for p, linked in found if linked and not p.isspace()]
            o = stack[-1]
            named = -pos if name else o.named
            blocks.append(Block(text, words, min(1.0, sum(map(len, links)) / words), len(links), o.zone, o.boiler_tag, o.in_form, name or o.near, max(o.worst, name), named, heading))

    def flush():
        nonlocal parts, asides, into, aside_tag
        if not parts:
            return
        put(parts, own)
        for name, found in asides:
            put(found, max(own, name))
        parts, asides, aside_tag = [], [], ""
        into = parts

    while pos < n:
        m = _TAG.search(page, pos)
        stop = m.start() if m else n
        if stop > pos:
            into.append((page[pos:stop], link))
        if not m:
            break
        pos = m.end()
        name = m[2] or m[5]
        if not name:
            continue  # a comment or declaration
        tag, closing, attrs = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in _INLINE:
            if tag == "a":
                link = not closing
            elif tag == "br":
                into.append((" ", link))
            elif aside_tag:
                aside_depth += (tag == aside_tag) * (-1 if closing else 1)
                if not aside_depth:
                    aside_tag, into = "", parts
            elif attrs and not closing and tag not in _VOID and not attrs.endswith("/") and (name := reading(attrs)) >= BOILER:
                asides.append((name, []))
                parts.append((" ", False))
                aside_tag, aside_depth, into = tag, 1, asides[-1][1]
            continue
        flush()
        link, own = False, PLAIN
        if tag in _RAW:
            if not closing:
                end = _RAW[tag].search(page, pos)
                pos = end.start() if end else n
            continue
        if tag in _ENDS_CELL and not (closing and tag == "th"):
            close("td")
        if tag in _CONTAINER:
            if closing:
                if tag != "td":  # done above
                    close(tag)
            elif not attrs.endswith("/"):
                opened.setdefault(tag, []).append(len(stack))
                stack.append(inside(stack[-1], tag, attrs, pos))
        elif attrs and not closing:
            own = reading(attrs)
        heading = not closing and tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    flush()
    return blocks


def features(*pages: list[Block]) -> np.ndarray:
    """Features of the blocks of pages, one page after the other; neighbours are of the same page."""
    blocks = [b for page in pages for b in page]
    n = len(blocks)
    x = np.zeros((n, len(FEATURES)))
    if n:
        of = np.repeat(np.arange(len(pages)), list(map(len, pages)))
        w, d = np.array([b.words for b in blocks], float), np.array([b.density for b in blocks])
        x[:, :5] = [(b.zone, b.boiler_tag, b.in_form, b.name_near, b.name_any) for b in blocks]
        _, named = np.unique(of << 40 | np.array([b.named for b in blocks]) + (1 << 39), return_inverse=True)
        x[:, 5] = np.bincount(named, w)[named] / np.bincount(of, w)[of]  # of the page's words, in the element with the near name
        x[:, 6], x[:, 7] = w, d
        same = of[1:] == of[:-1]
        x[1:, 8], x[:-1, 9], x[1:, 10], x[:-1, 11] = w[:-1] * same, w[1:] * same, d[:-1] * same, d[1:] * same
        x[:, 12:15] = [(b.links, b.heading, b.text[-1] in ".!?…\"”»") for b in blocks]
        x[:, 15] = (np.bincount(of, x[:, 0] == 1) > 0)[of]
        long = ((w >= LONG) & (d < 0.3)).astype(np.int64)
        upto = np.cumsum(long)
        first = np.searchsorted(of, of)  # the page's first block
        x[:, 16] = upto - long - (upto - long)[first]
        x[:, 17] = np.bincount(of, long)[of] - x[:, 16] - long
    return x


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1) -> tuple:
    """A binary decision tree on the Gini index: (feature, threshold, low, high) or a leaf's class."""
    if depth == 0 or len(set(y.tolist())) < 2:
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        ones = np.cumsum(t)
        k = np.arange(1, len(t))
        left, right = ones[:-1] / k, (ones[-1] - ones[:-1]) / (len(t) - k)
        gini = k * left * (1 - left) + (len(t) - k) * right * (1 - right)
        gini[(v[1:] == v[:-1]) | (k < least) | (len(t) - k < least)] = np.inf
        if len(gini) and gini.min() < np.inf and (best is None or gini.min() < best[0] - 1e-9):
            at = int(gini.argmin())
            best = (gini[at], f, (v[at] + v[at + 1]) / 2)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, cut = best
    low = x[:, f] <= cut
    return (f, cut, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def decide(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), bool(tree))
    f, cut, low, high = tree
    left = x[:, f] <= cut
    out = np.empty(len(x), bool)
    out[left], out[~left] = decide(low, x[left]), decide(high, x[~left])
    return out


@lru_cache(1)
def trained() -> tuple:
    """The tree of the labelled table."""
    from .html_labels import pages

    xs, ys = [], []
    for page in pages():
        blocks = flat_blocks(page)
        ys += [b.text.startswith("+") for b in blocks]
        xs.append(features(blocks))
    return grow(np.concatenate(xs), np.array(ys, float), depth=11, least=2)


def main_texts(pages: list[str], tree: tuple) -> list[str]:
    found = [flat_blocks(p) for p in pages]
    keep = iter(decide(tree, features(*found)).tolist())
    return ["\n\n".join([b.text for b in blocks if next(keep)]) for blocks in found]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` of every page."""
    tree = trained()
    with_url = pages.select(F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url")).alias("page"), F.col(html_col).alias("html"))

    def make():
        def kernel(texts):
            out = main_texts(texts, tree)
            return {"text": out, "n_chars": list(map(len, out))}

        return kernel

    got = map_text(with_url, make, "text string, n_chars long", "page", "html")
    return got.select(F.col("page.id").alias(id_col), F.col("page.url").alias(url_col), "text", "n_chars")
