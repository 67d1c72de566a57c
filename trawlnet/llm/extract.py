"""Main text of web pages.

Method: line-block distribution. Mark-up is stripped so that every block of the page is a
line; parts that say by their tag, role or name that they are menus, notices, adverts and the
like are left out and end nothing, unless they hold the title or the bulk of the page. The lengths of text outside links are summed over windows of
a few lines; text begins where the sum surges and ends where it dives to nothing. The longest
stretch is kept with everything from the first surge to the last dive in the element it is in,
and with stretches nearly as long. If it is in an article or main element, these elements bound
the text instead, so that titles and lines of links at its ends stay: all of the outermost one, of
those beside it that have text, and of others nearly as long.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.llm.frames import extended, sized

WINDOW = 3  # lines of a block
SHARE = 0.5  # of the best stretch's length that makes another stretch main text too

# Elements by what browsers do with them, and names that pages give to parts
# that are not the article.
_BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav"
    " ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
_CELLS = {"td", "th", "br"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_ASIDE = set(
    "nav header footer aside form menu dialog button select textarea label fieldset iframe object"
    " video audio canvas map datalist".split()
)
# Without text of their own, also within a line: unlike raw text they end with their parent.
_SILENT = {"svg", "math", "template", "noscript"}
_FOREIGN = {"svg", "math"}  # end where a block begins
_ROLES = set(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
_NAMES = set(
    "ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promotion banner"
    " cookie cookies consent gdpr notice notices alert popup modal overlay paywall nav navbar navigation"
    " menu submenu breadcrumb breadcrumbs header masthead topbar toolbar footer sidebar rail widget widgets"
    " related recommended recommendations share sharing social newsletter subscribe subscription signup"
    " login register search searchbox form comment comments commentlist respond reply replies disqus"
    " pagination pager hidden skip toc".split()
)
_REMARKS = {"comment", "comments", "reply", "replies", "respond"}  # articles of readers
_TEXTS = set("p h1 h2 h3 h4 h5 h6 span em strong b i a blockquote".split())
_ARTICLE = {"article", "main"}
_KEPT = {"html", "body", "article", "main"}
_SECTIONS = {"html", "body", "article", "main", "section", "div", "center", "td"}

_RAW = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|title|xmp|noframes)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/>]*)(?:((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|([^>]*)(?:>|\Z))", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PART = re.compile(r"[a-z]+")


def _hidden(attributes: str) -> bool:
    """Whether an element says that it is not shown, or what part of the page's frame it is."""
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role" and value in _ROLES:
            return True
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _named_aside(name: str, attributes: str) -> bool:
    """Whether a class or id says so: any part of it, but whole names for a paragraph or title."""
    for key, value in _ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id"):
            value = value.strip("\"'").lower()
            names = value.split() if name in _TEXTS else _PART.findall(value)
            if not (_REMARKS if name == "article" else _NAMES).isdisjoint(names):
                return True
    return False


class _Page:
    """Lines of one page, in order: text, length outside links, article and element they are in."""

    def __init__(self, spared: set[int] | None = None):
        """``spared``: elements that are no asides whatever they are called; None if nothing is one."""
        self.spared = spared
        self.weights = [0]  # letters outside links right inside each element
        self.lines: list[tuple[str, int, int, int]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.open: list[tuple[str, bool, int]] = []
        # elements by number, in order of their start: name, parent, last element inside
        self.names, self.parents, self.last = ["html"], [0], [0]
        self.aside = self.link = self.article = self.articles = 0
        self.inside: list[tuple[str, int]] = []
        self.beside = [-1]  # parent of each article

    def end_line(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                number = self.inside[0][1] if self.inside else 0
                self.lines.append((text, max(len(text) - self.linked, 0), number, self.open[-1][2] if self.open else 0))
            self.parts, self.linked = [], 0

    def text(self, raw: str) -> None:
        if raw and not self.aside:
            self.parts.append(raw)
            if self.link:
                self.linked += len(" ".join(html.unescape(raw).split()))
            elif self.spared is None:
                self.weights[self.open[-1][2] if self.open else 0] += len(raw) - raw.count(" ")

    def _is_aside(self, name: str, attributes: str, near: list[str]) -> bool:
        if self.spared is None:
            return False
        if attributes and name not in _KEPT and _hidden(attributes):
            return True
        if len(self.names) in self.spared or (name == "label" and "p" in near):
            return False
        if name in _ASIDE:
            return True
        return bool(attributes) and (name not in _KEPT or name == "article") and _named_aside(name, attributes)

    def to_spare(self) -> set[int]:
        """Elements that cannot be asides: those around a title, and those around the text itself.

        The latter hold half of the letters outside links, and all titles, articles and main
        elements of the page. For what tags call a menu or the like, there has to be one.
        """
        total = list(self.weights)
        for at in range(len(total) - 1, 0, -1):
            total[self.parents[at]] += total[at]
        titles = [at for at, name in enumerate(self.names) if name == "h1"]
        anchors = [at for at, name in enumerate(self.names) if name == "h1" or name in _ARTICLE]
        spared = {
            at
            for at, name in enumerate(self.names)
            if 2 * total[at] >= total[0] > 0
            and all(at <= x <= self.last[at] for x in anchors)
            and (anchors or name not in _ASIDE or name == "form")
        }
        for at in titles:
            spared.add(at)
            while at:
                at = self.parents[at]
                inside = any(self.names[x] == "article" for x in self._above(at))
                if self.names[at] in _KEPT or (self.names[at] in _ASIDE and not (self.names[at] == "header" and inside)):
                    break
                spared.add(at)
        return spared

    def _above(self, at: int) -> Iterator[int]:
        while at:
            at = self.parents[at]
            yield at

    def pop(self) -> None:
        name, aside, element = self.open.pop()
        self.last[element] = len(self.names) - 1
        self.aside -= aside
        if name == "a":
            self.link -= 1
        if name in _ARTICLE and self.inside:
            self.inside.pop()

    def region(self, lines: list[int]) -> tuple[int, int]:
        """Numbers, from and to, of the elements in the section that holds these lines, and not one line only."""
        elements = [line[3] for line in self.lines]
        first, last = min(elements[i] for i in lines), max(elements[i] for i in lines)
        at = first
        while at and (
            self.last[at] < last
            or self.names[at] not in _SECTIONS
            or sum(at <= e <= self.last[at] for e in elements) < 2
        ):
            at = self.parents[at]
        return at, self.last[at]

    def close(self, name: str) -> None:
        """End the innermost open element of that name, and what is open inside it."""
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == name:
                if self.aside and name in _BLOCKS and not any(o[1] for o in self.open[:at]):
                    self.end_line()
                while len(self.open) > at:
                    self.pop()
                return

    def start(self, name: str, attributes: str) -> None:
        if name in _BLOCKS:
            while any(o[0] in _FOREIGN for o in self.open[-8:]):
                self.close(next(o[0] for o in reversed(self.open) if o[0] in _FOREIGN))
            if not self.aside:
                self.end_line()
        near = [o[0] for o in self.open[-8:]]
        if name in _BLOCKS and "p" in near and _SILENT.isdisjoint(near[near.index("p") :]):
            self.close("p")
        elif name == "li" and self.open and self.open[-1][0] == "li":
            self.pop()
        if name in _VOID or attributes.endswith("/"):
            return
        aside = name in _SILENT or self._is_aside(name, attributes, near)
        if aside and not self.aside:
            if name in _SILENT:
                self.text(" ")
            else:
                self.end_line()
        self.parents.append(self.open[-1][2] if self.open else 0)
        self.open.append((name, aside, len(self.names)))
        self.names.append(name)
        self.weights.append(0)
        self.last.append(0)
        self.aside += aside
        if name == "a":
            self.link += 1
        if name in _ARTICLE:
            self.articles += 1
            self.beside.append(self.parents[-1])
            self.inside.append((name, self.articles))


def parsed(source: str) -> _Page:
    source = _RAW.sub(" ", source)
    return _read(source, _read(source, None).to_spare())


def _read(source: str, spared: set[int] | None) -> _Page:
    page, at = _Page(spared), 0
    for tag in _TAG.finditer(source):
        page.text(source[at : tag.start()])
        at = tag.end()
        name, attributes = tag[2].lower(), tag[3] if tag[3] is not None else tag[4]
        if name in _BLOCKS and not page.aside:
            page.end_line()
        elif name in _CELLS:
            page.text(" ")
        if tag[1]:
            page.close(name)
        else:
            page.start(name, attributes)
    page.text(source[at:])
    page.end_line()
    while page.open:
        page.pop()
    page.last[0] = len(page.names) - 1
    return page


def main_text(source: str, window: int = WINDOW, share: float = SHARE) -> str:
    """The blocks of the main text, joined by line feeds."""
    page = parsed(source)
    lines = page.lines
    length = [line[1] for line in lines]
    if not any(length):
        return "\n".join(line[0] for line in lines if line[2])
    blocks = np.convolve(length, np.ones(window, int))[: len(length)]  # sums up to each line
    # a stretch: from a surge, a sum after nothing, to the dive, where the sum is nothing again
    stretches: list[list[int]] = []
    for i, value in enumerate(blocks):
        if value and (not i or not blocks[i - 1]):
            stretches.append([])
        if value:
            stretches[-1].append(i)
    weight = [sum(length[i] for i in s) for s in stretches]
    best = stretches[int(np.argmax(weight))]
    of_article: dict[int, int] = {}
    for i in best:
        of_article[lines[i][2]] = of_article.get(lines[i][2], 0) + length[i]
    article = max(of_article, key=of_article.get)
    if article:
        whole = np.bincount([line[2] for line in lines], length)
        parent = page.beside[article]
        same = {n for n, w in enumerate(whole) if w and (page.beside[n] == parent or n and w >= share * whole.max())}
        chosen = {i for i, line in enumerate(lines) if line[2] in same}
        for s, w in zip(stretches, weight, strict=True):  # text of the page outside, by the same share
            outside = [i for i in s if not lines[i][2] and length[i]]
            if sum(length[i] for i in outside) >= share * whole[article]:
                chosen.update(outside)
        kept = sorted(chosen)
    else:
        first, last = page.region([i for i in best if length[i]])
        inside = [i for s in stretches for i in s if first <= lines[i][3] <= last]
        chosen = {i for i in range(min(inside), max(inside) + 1) if first <= lines[i][3] <= last}
        for s, w in zip(stretches, weight, strict=True):
            if w >= share * max(weight):
                chosen.update(range(s[0], max(i for i in s if length[i]) + 1))
        kept = sorted(chosen)
    return "\n".join(lines[i][0] for i in kept)


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Add ``text``, the main text of the column ``html``, to the columns ``keep``.

    Character references are decoded, white space within a block is one space, blocks are
    joined by one line feed. NULL and empty pages and pages without text give an empty text;
    other columns are ignored, repeated rows are treated alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, 4 << 20):
            texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.select(keep).columns, pa.array(texts, pa.string())], names=[*keep, "text"]
            )

    columns = [c for c in keep if c != "html"]
    return pages.select(*columns, F.col("html")).mapInArrow(run, extended(pages, keep, "text string"))
