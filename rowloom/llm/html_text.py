"""Main text of web pages by the distribution of text over line blocks.

The markup is stripped into lines, one per block. A line weighs its characters less those of its links. Weights are summed over sliding
windows of lines; text begins where the sums surge to ``SURGE`` of the page's largest one and ends where they dive below it,
between any two lines. Of such a stretch light lines at either end go unless they are headings or paragraphs, and whatever lies between is kept.

Tags are evidence for the sums. Elements of kinds that hold no article (menus, page headers and footers, sidebars, forms, scripts,
styles) leave a gap. Elements whose class, id or role marks them (adverts, notices, comments, …) leave one too, but only if the rest
of the page can be the article: a mark does not count on an element that holds every article, main and first-level heading of the
page and ``LARGE`` of its weight, nor, where a page has none of these, on one that holds half of the weight. A marked article is
kept whole if its sums surge: what is removed inside of it leaves no gap, and text on the other side of its border than the page's largest
window sum has to surge ``BESIDE`` times as high. Headings and paragraphs that are too short to surge stay beside text that does.
Elements whose end tags are omitted end where HTML ends them. A page is read in one pass, whatever is left open in it.

Defined results: null or empty html gives ``''``; character references are decoded; white space inside a block
becomes one space; blocks are joined by one line feed. Rows are independent, so repeated rows give equal texts, and columns beside
the named ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import columns

#: Lines per window, and the share of the page's largest window sum at which text surges.
WINDOW = 3
SURGE = 0.15
#: How much higher sums must surge across the border of a marked article.
BESIDE = 2
#: The share of a page's weight in an element that holds all its articles, from which on a mark on it does not count.
LARGE = 0.3

# Elements without article text, elements whose content is no markup, inline elements,
# elements without content, and the words in class, id or role that mark what is no article.
NO_TEXT = frozenset(
    "head nav footer aside form menu button select option textarea iframe object svg canvas dialog template noscript".split()
)
RAW = frozenset("script style title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MARKS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead banner footer sidebar widget ad ads advert adverts "
    "advertisement advertising sponsor sponsored promo notice notices alert cookie cookies consent popup modal overlay "
    "newsletter subscribe signup login search comment comments commentlist disqus replies share sharing social related "
    "recommended complementary contentinfo".split()
)
# Words that say nothing beside a mark (comment-list, top-ad); with any other word (no-sidebar, search-results) it is none.
BESIDE_MARKS = frozenset(
    "area bar block body bottom box center col column container content footer form global group header home inner item items left "
    "link links list main mobile outer page post primary right row secondary section site slot small text thread top unit wrap wrapper".split()
)
# What the last line of a page says that is no article.
_RIGHTS = re.compile(r"©|\(c\)|copyright|all rights reserved", re.I)

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | {"p"}

# What the start of an element ends, as HTML has it: (the elements that end, the elements beyond which none is looked for).
_SCOPE = frozenset("table td th caption object template button html".split())
_SECTIONS = frozenset("article aside blockquote fieldset figure footer form header main nav section".split())
_ENDS_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header "
    "hgroup hr li main menu nav ol p pre search section summary table ul".split()
) | HEADINGS
_ROWS = frozenset("tbody thead tfoot caption colgroup".split())
_CELLS = frozenset(("td", "th"))
_ITEMS = frozenset(("dd", "dt"))
_OPTIONS = frozenset(("option",))
_STARTS = {
    "li": (frozenset(("li",)), _SCOPE | _SECTIONS | {"ul", "ol", "menu", "dir"}),
    **dict.fromkeys(_ITEMS, (_ITEMS, _SCOPE | _SECTIONS | {"dl"})),
    **dict.fromkeys(_CELLS, (_CELLS, frozenset(("tr", "table")))),
    "tr": (frozenset(("tr", "caption", "colgroup")), frozenset(("table",))),
    **dict.fromkeys(_ROWS, (_ROWS, frozenset(("table",)))),
    "option": (_OPTIONS, frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("optgroup", "option")), frozenset(("select", "datalist"))),
    "button": (frozenset(("button",)), _SCOPE - {"button"}),
    "body": (frozenset(("head",)), frozenset()),
}
_IN_HEAD = frozenset("head base link meta noscript script style template title".split())
_TABLE = frozenset(("table",))
_TABLE_PARTS = _ROWS | _CELLS | {"tr"}

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?])")
# The rest of a tag whose quotes are closed.
_REST = re.compile(r"""(?:[^>"']++|"[^"]*"|'[^']*')*+>""")
_MARK = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|=|/|$)|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[a-z]+")
_END_OF_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def _is_marked(attributes: str, words: frozenset[str]) -> bool:
    for found in _MARK.findall(attributes):
        for token in "".join(found).lower().split():
            parts = _WORD.findall(token)
            if any(p in words for p in parts) and all(p in words or p in BESIDE_MARKS for p in parts):
                return True
    return False


def _is_no_text(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element holds no article by its kind, or is not shown."""
    if name in NO_TEXT or (name == "header" and not inside):
        return True
    return bool(attributes) and name not in ("html", "body") and bool(_HIDDEN.search(attributes))


class _Open:
    """The elements that are open at a place of a page, and for each name the depths at which it is."""

    def __init__(self):
        self.names: list[str] = []
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, names: frozenset[str]) -> int:
        """The depth of the innermost open element of these names, -1 without one."""
        return max((self.depths[name][-1] for name in names if self.depths.get(name)), default=-1)

    def push(self, name: str) -> None:
        self.depths.setdefault(name, []).append(len(self.names))
        if name not in INLINE:
            self.blocks.append(len(self.names))
        self.names.append(name)

    def cut(self, depth: int) -> None:
        """Ends the element at ``depth`` and all inside of it."""
        while len(self.names) > depth:
            name = self.names.pop()
            self.depths[name].pop()
            if name not in INLINE:
                self.blocks.pop()

    def end(self, names: frozenset[str], bounds: frozenset[str]) -> None:
        depth = self.last(names)
        if depth >= 0 and depth > self.last(bounds - names):
            self.cut(depth)

    def started(self, name: str) -> None:
        """Ends what the start of an element ends without an end tag."""
        if self.depths.get("head") and name not in _IN_HEAD:
            self.end(frozenset(("head",)), frozenset(("template", "noscript")))
        if name in _STARTS:
            self.end(*_STARTS[name])
        if name in _ENDS_P:
            self.end(frozenset(("p",)), _SCOPE)
        if name in HEADINGS and self.names and self.names[-1] in HEADINGS:
            self.cut(len(self.names) - 1)

    def ended(self, name: str) -> None:
        """Ends an element and all that is still open inside of it; an end tag without a start ends nothing."""
        names = HEADINGS if name in HEADINGS else frozenset((name,))
        if name in INLINE:
            depth = self.last(names)
            if depth >= 0 and (not self.blocks or depth > self.blocks[-1]):
                self.cut(depth)
        elif name in _TABLE_PARTS:
            self.end(names, _TABLE)
        elif name in ("table", "body", "html", "template"):
            self.end(names, frozenset())
        else:
            self.end(names, _SCOPE | {"ul", "ol"} if name == "li" else _SCOPE)


@dataclass
class Line:
    """A block's text, its characters outside of links, and where it stands."""

    text: str
    weight: int
    inside: bool  # in a marked article
    prose: bool  # in a heading or paragraph
    heading: bool
    marks: tuple[int, ...]  # the marked elements around it
    gap: bool  # something was removed in front of it


@dataclass
class Mark:
    """A marked element: what of the page it holds."""

    weight: int = 0
    articles: int = 0


class _Tags:
    """The tags of a page in order; every search ends at a tag or is not begun again, so all of them take one pass."""

    def __init__(self, html: str):
        self.html, self.last, self.quotes = html, html.rfind(">"), 3

    def next(self, at: int) -> tuple[int, int, str, str, bool] | None:
        """Start, end, name, attributes of the next tag and whether it closes; the name is empty for comments and the like."""
        html = self.html
        while True:
            found = _TAG.search(html, at)
            if found is None:
                return None
            start, at = found.span()
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(html), "", "", False
            if at > self.last:
                # No tag ends behind this place; only a comment can hide what follows.
                at = html.find("<!--", at)
                if at < 0:
                    return None
                continue
            end = html.find(">", at) + 1
            if found[2] and self.quotes:
                rest = _REST.match(html, at)
                end = rest.end() if rest else end
                # A page with quotes that are never closed is read up to the next mark of a tag's end.
                self.quotes -= rest is None
            return start, end, (found[2] or "").lower(), html[at : end - 1], found[1] == "/"


def lines_of(html: str) -> tuple[list[Line], list[Mark], int]:
    """The lines of a page, its marked elements, and how many articles, main elements and first-level headings it has."""
    lines: list[Line] = []
    block: list[str] = []
    linked = 0  # characters of the block inside of links
    stack, tags = _Open(), _Tags(html)
    articles: list[int] = []  # the depths of open articles
    marked: list[tuple[int, int]] = []  # depths and numbers of open marked elements
    marks: list[Mark] = []
    skipped, n_articles, gap = -1, 0, False
    at, end = 0, len(html)

    def close_block() -> None:
        nonlocal gap, linked
        text, in_links = " ".join(unescape("".join(block)).split()), linked
        block.clear()
        linked = 0
        if not text:
            return
        weight = max(0, len(text) - in_links)
        for _, number in marked:
            marks[number].weight += weight
        heading = stack.last(HEADINGS) >= 0
        lines.append(Line(text, weight, bool(articles), heading or stack.last(PROSE) >= 0, heading, tuple(n for _, n in marked), gap))
        gap = False

    def settle() -> None:
        """Forgets articles, marked elements and the skipped one once they are no longer open."""
        nonlocal skipped
        while articles and articles[-1] >= len(stack.names):
            articles.pop()
        while marked and marked[-1][0] >= len(stack.names):
            marked.pop()
        if skipped >= len(stack.names):
            skipped = -1

    while at < end:
        tag = tags.next(at)
        start = tag[0] if tag else end
        if skipped < 0 and start > at:
            block.append(html[at:start])
            if stack.depths.get("a"):
                linked += len(" ".join(unescape(html[at:start]).split()))
        if tag is None:
            break
        _, at, name, attributes, closing = tag
        if not name:
            continue
        if name in RAW and not closing:
            stop = _END_OF_RAW[name].search(html, at)
            at = stop.end() if stop else end
            continue
        if name not in INLINE:
            close_block()
        if closing:
            stack.ended(name)
            settle()
            continue
        stack.started(name)
        settle()
        # An element that is never closed ends where an article begins.
        if skipped >= 0 and name in ("article", "main") and not articles and stack.names[skipped] != name:
            stack.cut(skipped)
            settle()
        if name in VOID or attributes.endswith("/"):
            continue
        if skipped < 0:
            top = name in ("html", "body") or name in ("article", "main") and not articles
            is_marked = bool(attributes) and not top and _is_marked(attributes, MARKS if articles else MARKS | {"header"})
            if _is_no_text(name, attributes, bool(articles)) or (is_marked and name in INLINE):
                close_block()
                skipped = len(stack.names)
                gap = gap or not articles
            elif is_marked:
                marked.append((len(stack.names), len(marks)))
                marks.append(Mark())
            if skipped < 0 and name in ("article", "main", "h1"):
                n_articles += 1
                for _, number in marked:
                    marks[number].articles += 1
                if name != "h1":
                    articles.append(len(stack.names))
        stack.push(name)
    close_block()
    return lines, marks, n_articles


def main_text(html: str | None) -> str:
    """The text between surge and dive points of one page."""
    return "\n".join(_between(*lines_of(html))) if html else ""


def _without_marked(lines: list[Line], marks: list[Mark], n_articles: int) -> list[Line]:
    """The lines outside of the elements whose marks count."""
    whole = sum(line.weight for line in lines)
    counts = [
        m.weight < LARGE * whole or m.articles < n_articles if n_articles else 2 * m.weight < whole for m in marks
    ]
    kept, gap = [], False
    for line in lines:
        if any(counts[number] for number in line.marks):
            gap = gap or not line.inside
            continue
        line.gap = line.gap or gap
        kept.append(line)
        gap = False
    return kept


@dataclass
class _Region:
    """Lines without a gap on one side of an article's border."""

    lines: list[Line]
    sums: list[int]

    @property
    def peak(self) -> int:
        return max(self.sums)

    @property
    def inside(self) -> bool:
        return self.lines[0].inside


def _regions(lines: list[Line]) -> list[_Region]:
    found: list[list[Line]] = []
    for line in lines:
        if not found or line.gap or line.inside != found[-1][-1].inside:
            found.append([])
        found[-1].append(line)
    regions = []
    for some in found:
        weights = [line.weight for line in some]
        regions.append(_Region(some, [sum(weights[i : i + WINDOW]) for i in range(len(weights))]))
    return regions


def _stretches(region: _Region, least: float) -> list[Line]:
    """The lines of a region between surge and dive points, without light lines at the ends of a stretch."""
    n = len(region.lines)
    high = [any(region.sums[j] >= least for j in range(max(0, i - WINDOW + 1), i + 1)) for i in range(n)]
    out, i = [], 0
    while i < n:
        if not high[i]:
            i += 1
            continue
        stop = i
        while stop < n and high[stop]:
            stop += 1
        first, last = i, stop
        while first < last and _is_light(region.lines[first], least):
            first += 1
        while first < last and (_is_light(region.lines[last - 1], least) or _RIGHTS.search(region.lines[last - 1].text) and region.lines[last - 1].weight < least):
            last -= 1
        out.extend(region.lines[first:last])
        i = stop
    return out


def _is_light(line: Line, least: float) -> bool:
    return not line.heading and line.weight * WINDOW < least and not (line.prose and line.weight > 0)


def _between(lines: list[Line], marks: list[Mark], n_articles: int) -> list[str]:
    regions = _regions(_without_marked(lines, marks, n_articles))
    main = max(regions, key=lambda r: r.peak, default=None)
    if main is None:
        return []
    least = [SURGE * main.peak * (1 if r.inside == main.inside else BESIDE) for r in regions]
    surges = [r.peak >= t for r, t in zip(regions, least)]
    out: list[str] = []
    for i, region in enumerate(regions):
        if surges[i]:
            kept = region.lines if region.inside else _stretches(region, least[i])
            out.extend(line.text for line in kept)
        elif all(line.prose for line in region.lines):
            beside = (j for j in (i - 1, i + 1) if 0 <= j < len(regions))
            if any(surges[j] and regions[j].inside == region.inside for j in beside):
                out.extend(line.text for line in region.lines)
    return out


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(key, url, text, n_chars)`` for every page; ``n_chars`` counts code points."""

    @F.pandas_udf("string")
    def text_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(main_text, na_action=None)

    rows = columns(pages, **{key: key, url: url, "_html": html})
    texts = rows.select(key, url, text_of("_html").alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
