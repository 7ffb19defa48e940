"""Main-text extraction from HTML.

A streaming pass of the standard library's parser turns a page into lines, one per block of text, each with the
number of tags met inside it. A line's text-to-tag ratio counts the text that is not part of a link or a menu. The
ratios are smoothed by a Gaussian along the page and cut at the threshold between their two clusters. The lines above
it vote: the lines of one section element (``GROUPS``) stay together as the greater part of their text is above or
below. The elements only smooth what the clusters choose, so that the short paragraphs of an article stay with it. Text that is told from an article
by its mark-up alone (``BOILERPLATE``, ``MARKS``: adverts, notices, footers, forms, reader comments) is left out
beforehand; menus and lists of links are not, the ratio tells them.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.llm.common import col, frugal

# HTML element names by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = set("script style noscript template svg canvas object iframe select textarea button head title option audio video map math".split())
#: Hidden elements that no block can be part of: where one begins, they have been left open.
SHORT = set("select button option title svg math head".split())
BOILERPLATE = set("footer aside form dialog search".split())
MENUS = set("nav menu".split())
ARTICLES = ("article", "main")
GROUPS = set("article main section div nav menu aside header footer body form td ul ol".split())
LISTS = ("ul", "ol")
# Words of class, id and role attributes that mark boilerplate; the second set only outside an article.
MARKS = set(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices popup newsletter subscribe subscription signup share sharing social comment comments commentlist disqus respond replies discussion "
    "sidebar sidebars related recommended recommendations trending footer masthead contentinfo complementary".split()
)
OUTER_MARKS = set(
    "alert modal overlay reply side header topbar pager copyright widget widgets login search hidden skip toolbar dialog form".split()
)
ANY_MARKS = MARKS | OUTER_MARKS
#: The same, of menus.
MENU_MARKS = set("menu nav navbar navigation breadcrumb breadcrumbs pagination".split())
#: Words that say where a marked element stands or what holds it; a class name with any other word (``has-sidebar``, ``comments-open``,
#: ``share-price``) marks nothing.
NEUTRAL = set(
    "site page pages post posts article articles entry blog story user users reader readers google top bottom left right primary secondary inner outer first last global "
    "wrapper wrap container holder box area region section block list item items bar panel slot unit row col column group inline link links button buttons icon icons text title message content js".split()
)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _marks(attrs) -> tuple[list[set[str]], bool]:
    """The names in an element's marking attributes, each as its set of words, and whether the element is not shown."""
    names: list[set[str]] = []
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            names += [{w.lower() for w in _WORDS.findall(part) if not w.isdigit()} for part in value.split()]
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and _UNSEEN.search(value):
            return names, True
    return names, False


def _says(names: list[set[str]], marks: set[str]) -> bool:
    """Whether a whole name is made of marks and neutral words, with one mark at least."""
    return any(words and not marks.isdisjoint(words) and words <= marks | NEUTRAL for words in names)


class _Open:
    """An open element and what it inherits: every question about the ancestors is answered by the innermost one."""

    __slots__ = ("tag", "boiler", "hidden", "menu", "article", "group", "mark")

    def __init__(self, tag, boiler, hidden, menu, article, group, mark):
        self.tag, self.boiler, self.hidden, self.menu, self.article, self.group, self.mark = tag, boiler, hidden, menu, article, group, mark


class PageLines(HTMLParser):
    """``lines``: (text, link characters, tags, group, article) in page order; ``parent`` of the list groups.

    Every event costs the same, however many elements are open. Elements left open end with the element around
    them, those of ``SHORT`` with the next block.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.parent: dict[int, int] = {}
        self._open = [_Open("", False, False, False, 0, 0, 0)]
        self._marks: list[int] = []  # of each line the outermost element around it whose name marks boilerplate, or 0
        self._holders: set[int] = set()  # such elements that an article without a mark stands in
        self._marked = 0
        self._count: Counter = Counter()
        self._text: list[str] = []
        self._linked = self._tags = self._groups = self._articles = 0
        self._link = 0  # how many elements were open when the current link began

    def updatepos(self, i, j):
        """Line numbers are not needed."""
        return j

    def _flush(self) -> None:
        if self._text:
            text, top = " ".join("".join(self._text).split()), self._open[-1]
            if text and not top.boiler:
                self.lines.append((text, min(self._linked, len(text)), self._tags, top.group, top.article))
                self._marks.append(top.mark)
            self._text, self._linked = [], 0
        self._tags = 0

    def _pop(self, name: str) -> None:
        if not self._count[name]:
            return
        while True:
            top = self._open.pop()
            self._count[top.tag] -= 1
            if top.tag == name:
                break
        if self._link > len(self._open):
            self._link = 0

    def handle_starttag(self, tag, attrs):
        self._tags += 1
        if tag == "br":
            self._text.append(" ")
        if tag == "a":
            self._link = len(self._open) if any(name == "href" for name, _ in attrs) else 0
        block, hidden = tag in BLOCK, tag in HIDDEN
        if block:
            while self._open[-1].tag in SHORT:
                self._pop(self._open[-1].tag)
            self._flush()
            if self._open[-1].tag == "p":
                self._pop("p")
        if tag in VOID or tag == "html":
            return
        names, unseen = _marks(attrs) if attrs else ([], False)
        top = self._open[-1]
        outside = not top.article
        marked = tag not in ("main", "body") and bool(names) and _says(names, ANY_MARKS if outside else MARKS)
        boiler = unseen or tag in BOILERPLATE or tag == "header" and outside
        menu = tag in MENUS or bool(names) and tag not in ("main", "body") and _says(names, MENU_MARKS)
        if not (block or hidden or boiler or marked or menu):
            return
        mark = top.mark
        if marked and not mark:
            self._marked += 1
            mark = self._marked
        elif tag in ARTICLES and outside and mark and not marked:
            self._holders.add(mark)
        group, article = top.group, top.article
        if tag in GROUPS:
            self._groups += 1
            if tag in LISTS:
                self.parent[self._groups] = group
            group = self._groups
        if tag in ARTICLES and outside:
            self._articles += 1
            article = self._articles
        self._open.append(_Open(tag, top.boiler or boiler, top.hidden or hidden or unseen, top.menu or menu, article, group, mark))
        self._count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self._tags += 1
        if tag == "br":
            self._text.append(" ")
        elif tag in BLOCK:
            self._flush()

    def handle_endtag(self, tag):
        self._tags += 1
        if tag == "a":
            self._link = 0
        if tag in BLOCK:
            self._flush()
        self._pop(tag)

    def handle_data(self, data):
        top = self._open[-1]
        if not top.hidden:
            self._text.append(data)
            if self._link or top.menu:
                self._linked += len(data)

    def close(self):
        """Leaves out the lines of marked elements, but for one that holds an article and most of the page's text: that is its frame."""
        super().close()
        self._flush()
        size = np.bincount(self._marks, [len(line[0]) for line in self.lines], self._marked + 1) if self.lines else np.zeros(1)
        kept = {0} | {m for m in self._holders if 2 * size[m] > size.sum()}
        self.lines = [line for line, mark in zip(self.lines, self._marks) if mark in kept]


def text_to_tag(lines, sigma: float = 1.5) -> tuple[np.ndarray, np.ndarray, float]:
    """Logarithms of the text-to-tag ratio per line, smoothed and plain, and the threshold between the two clusters
    of the smoothed ones (by intermeans)."""
    ratio = np.array([(len(text) - linked) / max(1, tags) for text, linked, tags, _, _ in lines])
    reach = int(3 * sigma) + 1
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    spread = lambda x: np.convolve(x, kernel, mode="full")[reach : reach + len(x)]
    level = np.log1p(spread(ratio) / spread(np.ones(len(ratio))))
    cut = level.mean()
    order = np.sort(level)
    sums = np.concatenate(([0.0], np.cumsum(order)))
    for _ in range(20):
        k = int(np.searchsorted(order, cut, side="right"))
        if not 0 < k < len(order):
            break
        new = (sums[k] / k + (sums[-1] - sums[k]) / (len(order) - k)) / 2
        if new == cut:
            break
        cut = new
    return level, np.log1p(ratio), min(cut, 0.5 * level.max())


def chosen_lines(lines, parent: dict[int, int], level: np.ndarray, plain: np.ndarray, cut: float) -> np.ndarray:
    """Flags of the lines whose group's text lies above the threshold for the greater part.

    Smoothing would carry an article's text over its border: where one article holds most of the text above, a line
    outside it counts only if its plain ratio reaches the mean of the article's.
    """
    size = np.array([len(line[0]) for line in lines])
    linked = np.array([line[1] for line in lines])
    own = np.array([line[3] for line in lines])
    article = np.array([line[4] for line in lines])
    n = int(own.max()) + 1
    total, links = np.bincount(own, size, n), np.bincount(own, linked, n)
    # A list of links is judged by itself, any other list with what is around it.
    up = np.arange(n)
    for group in sorted(parent):
        if group < n and links[group] <= 0.5 * total[group]:
            up[group] = up[parent[group]]
    own = up[own]
    above = (level >= cut) & (level > 0)
    by_article = np.bincount(article, size * above)
    best = int(by_article.argmax())
    if best and by_article[best] >= 0.5 * by_article.sum():
        above &= (article == best) | (plain >= plain[above & (article == best)].mean())
    mass = np.bincount(own, size * above, n)
    return ((mass > 0) & (mass >= 0.5 * np.bincount(own, size, n)))[own]


def main_text(html: str | None) -> str:
    """The content blocks of a page, joined by blank lines; empty for a null, empty or text-free page."""
    if not html:
        return ""
    page = PageLines()
    page.feed(html)
    page.close()
    if not page.lines:
        return ""
    keep = chosen_lines(page.lines, page.parent, *text_to_tag(page.lines))
    return "\n\n".join(line[0] for line, on in zip(page.lines, keep.tolist()) if on)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars of every page.

    Null and empty pages, and pages without text, have an empty text. Very long pages are read whole, in time that
    grows with their length. Repeated rows are extracted once each, rows with one text alike; columns that are not
    kept are ignored, whatever their names; an empty table gives an empty one.
    """

    @frugal
    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "_text", "_chars"]
            )

    names = [f"_{i}" for i in range(len(keep))]
    schema = StructType([StructField(n, pages.schema[k].dataType) for n, k in zip(names, keep)] + [StructField("_text", StringType()), StructField("_chars", LongType())])
    made = pages.select(col(html_col).alias("_html"), *[col(k).alias(n) for n, k in zip(names, keep)]).mapInArrow(run, schema)
    return made.toDF(*keep, "text", "n_chars")
