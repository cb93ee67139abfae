"""Main text of web pages from streaming parser events and smoothed text-to-tag ratios.

One pass over the parser's events cuts a page into lines (runs of text between block tags), each with
its number of tags, how much of it is link text, and the elements around it. The ratio of text outside links to
tags is smoothed along the page by a Gaussian, so a short line between paragraphs counts as one of them, and a
threshold between the two clusters of ratios marks content lines.

Regions are then chosen element by element. An ``article`` (all of them; without any, a ``main``) is a region
unless it holds no content line and at least half of its text is links, as in teasers. In a region all lines stay,
short ones too, but for blocks without a content line that are mostly links: menus and adverts go though no name says
what they are. On other pages the whole page is the region, and a block without a content line must also stand between content
lines of the element around it, or be a list, table or quotation after one. Lines inside elements
that are named as something else never count: menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments.

Pages are handled one by one inside tasks; there is no exchange. Edge cases: null or empty html gives
an empty text, as does a page without text; unclosed, crossed and unknown tags, comments and broken
references follow the parser's rules; text in no element is a line of the page itself. White space
(also no-break spaces) inside a line becomes one blank. Equal pages give equal texts. Input columns
named like the added ones are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.frames import without

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup option p pre "
    "section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
SILENT = frozenset(
    "head script style title noscript template iframe object svg math canvas audio video select option button textarea "
    "form fieldset label nav aside menu dialog footer".split()
)
MAIN = frozenset("article main".split())
#: Elements that can be blocks of their own on a page.
BLOCKS_OF_LINES = frozenset("article blockquote center details dir div dl figure main ol pre section table td th ul".split())
#: Those of them that belong to the lines before them.
DATA = frozenset("blockquote dl figure ol pre table ul".split())
QUOTED = frozenset("blockquote figure pre".split())
#: An open element that a new one of the same group ends.
ENDS = {
    "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option",
    "p": "p", "a": "a",
}
#: Elements that an unclosed one inside them does not outlive.
SCOPES = frozenset("ul ol dl table tbody thead tfoot section article main div body nav aside footer header form".split())
#: Words in class, id or role that name something other than the article.
OTHER = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|adslot|banner|sponsor|sponsored|promo|promotion|"
    r"sidebar|side-bar|menu|submenu|nav|navbar|navigation|breadcrumbs?|pagination|pager|masthead|topbar|toolbar|"
    r"site-header|page-header|footer|colophon|copyright|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|search|share|sharing|social|related|recommended|widget|toc|"
    r"contentinfo|complementary|dialog|form)(?:$|[\s_-]|\d)", re.I,
)
HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-]|\d)", re.I)
#: Beginnings of class names that say what else the page has.
ABOUT_PAGE = ("has-", "no-", "with-", "without-", "is-")
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|respond|replies|reply|discussion|reactions)(?:$|[\s_-]|\d)", re.I)

WIDTH = 2
SIGMA = 1.0
#: Two clusters are found in like lines too: a line of half the border's density is still content.
SLACK = math.log(2)


class Element:
    """An element of the page; ``silent`` if its text is not the article's."""

    __slots__ = ("tag", "parent", "silent", "reader", "link", "depth")

    def __init__(self, tag: str, parent: "Element | None", silent: bool, reader: bool, link: bool = False):
        self.tag, self.parent, self.silent, self.reader, self.link = tag, parent, silent, reader, link
        self.depth = parent.depth + 1 if parent else 0

    def up(self) -> Iterator["Element"]:
        at: Element | None = self
        while at is not None:
            yield at
            at = at.parent


class Line:
    """Text between block tags, the tags before and in it, its innermost element and its characters in links."""

    __slots__ = ("text", "tags", "element", "links")

    def __init__(self, text: str, tags: int, element: Element, links: int = 0):
        self.text, self.tags, self.element, self.links = text, tags, element, min(links, len(text))


class LineParser(HTMLParser):
    """Cuts a page into lines as its events come in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack = [Element("", None, False, False)]
        self.parts: list[str] = []
        self.tags = self.links = 0

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.stack[-1], self.links))
            self.tags = 0
        self.links = 0
        self.parts = []

    def handle_data(self, data: str) -> None:
        if self.stack[-1].tag not in ("script", "style"):
            self.parts.append(data)
            if self.stack[-1].link:
                self.links += len(" ".join(data.split()))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.cut()
        self.tags += 1
        if tag in VOID:
            return
        if tag in ENDS:
            self._end_open(ENDS[tag].split())
        elif tag in BLOCK:
            self._end_open(["p"])
        parent = self.stack[-1]
        named = dict(attrs)
        words = " ".join(named.get(a) or "" for a in ("class", "id", "role")).split() if tag not in ("html", "body") else []
        names = " ".join(w for w in words if not w.lower().startswith(ABOUT_PAGE) and "-with-" not in w)
        reader = parent.reader or bool(COMMENTS.search(names))
        silent = parent.silent or reader or tag in SILENT or "hidden" in named or named.get("aria-hidden") == "true"
        silent = silent or tag in BLOCK and bool(OTHER.search(names))
        if tag == "header" or tag in BLOCK and HEADER.search(names):
            silent = silent or not any(e.tag in MAIN for e in parent.up())
        if tag in MAIN and not reader and not OTHER.search(names):
            silent = False  # something before it was left open
        parent = self.stack[-1]
        self.stack.append(Element(tag, parent, silent, reader, parent.link or tag == "a" and "href" in named))

    def _end_open(self, tags: list[str]) -> None:
        """Close the nearest open element of ``tags`` in this scope, with all inside it."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                del self.stack[i:]
                return
            if self.stack[i].tag in SCOPES:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.cut()
        self.tags += 1
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_comment(self, data: str) -> None:
        self.tags += 1


def page_lines(html: str) -> list[Line]:
    parser = LineParser()
    parser.feed(html)
    parser.close()
    parser.cut()
    return parser.lines


def smooth(values: list[float], width: int = WIDTH, sigma: float = SIGMA) -> list[float]:
    """Gaussian mean over ``width`` neighbours on each side; at the ends over those there are."""
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-width, width + 1)]
    out = []
    for i in range(len(values)):
        near = [(weights[k + width], values[i + k]) for k in range(-width, width + 1) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def threshold(values: list[float]) -> float:
    """The border between two clusters of values: the middle of their means, found by turns."""
    border = sum(values) / len(values)
    for _ in range(100):
        low, high = [v for v in values if v < border], [v for v in values if v >= border]
        if not low or not high:
            return border
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - border) < 1e-9:
            return border
        border = new
    return border


def content_lines(lines: list[Line], slack: float = 0.0) -> list[bool]:
    """Which lines have a smoothed ratio of text outside links to tags in the upper cluster, or up to ``slack`` below it.
    A line of mostly link text goes by its own ratio, so that one advert among paragraphs is not taken for one."""
    own = [math.log1p((len(line.text) - line.links) / max(1, line.tags)) for line in lines]
    ratios = smooth(own)
    border = threshold(ratios) if ratios else 0.0
    return [
        alone >= border if 2 * line.links >= len(line.text) else near >= border - slack
        for line, alone, near in zip(lines, own, ratios)
    ]


class Block:
    """What an element holds: characters, those in links, and the places of its lines and of its content lines."""

    __slots__ = ("size", "links", "first", "last", "first_content", "last_content", "region", "dropped", "cold")

    def __init__(self) -> None:
        self.size = self.links = 0
        self.first = self.first_content = math.inf
        self.last = self.last_content = -1
        self.region: Element | None = None
        self.dropped = False
        self.cold: Element | None = None

    def add(self, other: "Block") -> None:
        self.size, self.links = self.size + other.size, self.links + other.links
        self.first, self.last = min(self.first, other.first), max(self.last, other.last)
        self.first_content = min(self.first_content, other.first_content)
        self.last_content = max(self.last_content, other.last_content)

    @property
    def link_block(self) -> bool:
        return self.last_content < 0 and 2 * self.links >= self.size


def blocks_of(lines: list[Line], marked: list[bool]) -> dict[Element, Block]:
    """The blocks of all elements around lines that count, outer ones first."""
    blocks: dict[Element, Block] = {}
    for place, (line, content) in enumerate(zip(lines, marked)):
        if line.element.silent:
            continue
        for e in line.element.up():
            if e in blocks:
                break
            blocks[e] = Block()
        own = Block()
        own.size, own.links, own.first, own.last = len(line.text), line.links, place, place
        if content:
            own.first_content = own.last_content = place
        blocks[line.element].add(own)
    inner_first = sorted(blocks, key=lambda e: -e.depth)
    for e in inner_first:
        if e.parent is not None:
            blocks[e.parent].add(blocks[e])
    return {e: blocks[e] for e in reversed(inner_first)}


def kept_lines(lines: list[Line]) -> list[int]:
    """Places of the lines of the page's content regions, in page order."""
    blocks = blocks_of(lines, content_lines(lines, SLACK))
    counting = [i for i, line in enumerate(lines) if not line.element.silent]
    for tag in ("article", "main", ""):
        # With the empty tag, that of the page itself, the page is the one region.
        kept = _in_regions(lines, counting, blocks, tag)
        if kept:
            return kept
    return counting


def _in_regions(lines: list[Line], counting: list[int], blocks: dict[Element, Block], tag: str) -> list[int]:
    for e, block in blocks.items():
        outer = blocks[e.parent] if e.parent is not None else None
        block.region, block.dropped, block.cold = None, False, None
        if outer is None or outer.region is None:
            if e.tag == tag and (outer is None or not block.link_block):
                block.region = e
            continue
        block.region, block.cold = outer.region, outer.cold
        block.dropped = outer.dropped or e.tag in BLOCKS_OF_LINES - QUOTED and block.link_block
        if not tag and block.cold is None and e.tag in BLOCKS_OF_LINES and block.last_content < 0:
            block.cold = e
            after = outer.first_content < block.first
            block.dropped = block.dropped or not (after and (e.tag in DATA or outer.last_content > block.last))
    own = [blocks[lines[i].element] for i in counting]
    return [i for i, block in zip(counting, own) if block.region is not None and not block.dropped]


def main_text(html: str | None) -> str:
    """The lines of the page's content regions in page order, joined by one blank."""
    lines = page_lines(html or "")
    kept = kept_lines(lines)
    if not kept:
        return ""
    before = [i for i in range(kept[0]) if not lines[i].element.silent]
    if before and any(e.tag in ("h1", "h2") for e in lines[before[-1]].element.up()):
        kept.insert(0, before[-1])  # the article's heading stands before the region
    return " ".join(lines[i].text for i in kept)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of the html column."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None)

    source = without(pages, *[n for n in ("text", "n_chars") if n != html.lower()])
    out = source.withColumn("_main", texts(F.col(html))).drop(html).withColumnRenamed("_main", "text")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
