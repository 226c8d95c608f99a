"""Main text of web pages.

The standard library's parser streams events, which become lines: one for each block of text, with the tags
that stand in it and the path of elements around it. Each line's text-to-tag ratio is smoothed with a Gaussian,
and a threshold (one standard deviation) clusters lines into content and others. The clusters select the regions:
the article elements that hold content lines, if there are any, else the smallest container that holds all content
lines, without the lists and tables in it that hold no content line beside links and are links for the most part.
Inside regions all text stays, as short lines of an article have low ratios too, but for what is marked
as another kind of thing: elements made for it (nav, aside, form, ...) and classes whose names say so. A name that may
also stand for content (`legal-analysis`) needs the clusters to agree: most of the element's text is not content.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from planeframe.llm import textkernel as K
from planeframe.llm.common import narrow, released

# Elements of HTML by their role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot "
    "th thead tr ul".split()
)
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video map textarea select option button datalist".split())
ASIDE = frozenset("nav header footer aside form menu dialog".split())
CONTAINERS = frozenset("html body main section div table tbody td center".split())
LISTS = frozenset("ul ol dl dir table".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEAD_PARTS = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: An open one of these ends where the next one begins (or another block, for p).
ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id or role that mark something other than the article; fixed values.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr "
    "popup modal overlay newsletter share sharing social nav navbar navigation navigator menu menubar breadcrumb breadcrumbs "
    "pagination pager sidebar widget widgets recommended recommendations masthead topbar toolbar comment comments commentlist "
    "disqus contentinfo complementary".split()
)
#: The same for words that mark so by themselves, but may stand for content beside others.
WEAK = frozenset("notice notices alert subscribe signup paywall aside related footer header respond reply replies form search login copyright legal disclaimer skip hidden".split())
_WORDS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")

SIGMA, RADIUS = 1.0, 2


def marked(attrs: list[tuple[str, str | None]]) -> int:
    """2 if the attributes mark something other than the article, 1 if they may, 0 if they don't."""
    most = 0
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for token in value.split():
                words = set(_WORDS.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower())) - {""}
                if words & MARKS or words and words <= WEAK:
                    return 2
                most = max(most, int(bool(words & WEAK)))
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return 2
        elif name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 2
    return most


class Line(NamedTuple):
    text: str
    tags: int
    path: tuple[int, ...]
    kept: bool  # not inside what is marked as another kind of thing
    links: int  # characters inside links
    anchors: int  # links that begin in it


class Lines(HTMLParser):
    """Collects the lines, the names of the elements in their paths, and which of these may be marked."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, bool]] = []  # name, number, silent, aside
        self.lines: list[Line] = []
        self.names: dict[int, str] = {}
        self.weak: set[int] = set()
        self.text: list[str] = []
        self.links = self.anchors = 0
        self.tags = 0
        self.made = 0

    def flush(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                self.lines.append(Line(text, max(1, self.tags), tuple(x[1] for x in self.stack), not any(x[3] for x in self.stack), self.links, self.anchors))
                self.tags = 0
            self.text, self.links, self.anchors = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in HEAD_PARTS:
            self._end_head(tag == "body")
        if tag in VOID:
            if tag in ("br", "wbr") or tag not in BLOCKS:
                if tag == "br":
                    self.text.append(" ")
            else:
                self.flush()
            return
        if tag in BLOCKS:
            self.flush()
            if any(x[0] == "p" for x in self.stack[-3:]) and tag != "p" or tag == "p":
                self._close("p", BLOCKS - {"p"})
            if tag in ENDS_ITSELF:
                for other in ENDS_ITSELF[tag]:
                    self._close(other, frozenset({"ul", "ol", "dl", "table", "tr" if tag in ("td", "th") else "table", "select"}))
        self.anchors += tag == "a"
        up = self.stack[-1] if self.stack else ("", 0, False, False)
        self.made += 1
        self.names[self.made] = tag
        # an article or main element may be called anything; the page's own elements hold the article
        mark = 2 if tag in ASIDE else 0 if tag in ("html", "body", "article", "main") else marked(attrs)
        if mark == 1:
            self.weak.add(self.made)
        self.stack.append((tag, self.made, up[2] or tag in SILENT, up[3] or mark == 2))

    def _end_head(self, always: bool = False) -> None:
        """An open head ends where what can't stand in it begins, and a body ends it in any case."""
        if self.stack and (always or self.stack[-1][0] == "head"):
            at = next((at for at, x in enumerate(self.stack) if x[0] == "head"), None)
            if at is not None:
                del self.stack[at:]

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """What follows <![ without a known section's name is a comment up to the next >, as in browsers."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def _close(self, tag: str, barrier: frozenset[str]) -> None:
        """Closes the innermost open `tag`, unless a barrier stands between."""
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                self.flush()
                del self.stack[at:]
                return
            if self.stack[at][0] in barrier:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        names = [x[0] for x in self.stack]
        if tag not in names:
            return
        at = len(names) - 1 - names[::-1].index(tag)
        if tag not in BLOCKS and any(n in BLOCKS for n in names[at + 1 :]):
            return  # an inline end tag doesn't close the blocks that were opened since
        del self.stack[at:]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        if not (self.stack and self.stack[-1][2]):
            self.text.append(data)
            if any(x[0] == "a" for x in self.stack):
                self.links += len(data.strip())

    def close(self) -> None:
        super().close()
        self.flush()


def content(lines: list[Line]) -> np.ndarray:
    """Which lines have a high smoothed text-to-tag ratio."""
    ratio = np.array([len(x.text) / x.tags for x in lines], float)
    reach = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(reach**2) / (2 * SIGMA**2))
    weight = np.convolve(np.ones(len(ratio)), kernel, "full")[RADIUS:-RADIUS]
    smooth = np.convolve(ratio, kernel, "full")[RADIUS:-RADIUS] / weight
    return smooth >= min(smooth.std(), smooth.max())


def main_text(html: str) -> str:
    """The article's blocks, one a line; empty if there is none."""
    parser = Lines()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # the parser's own complaint about a broken declaration: keep what was read
        parser.flush()
    lines = [x for x in parser.lines if x.kept]
    if not lines:
        return ""
    high = content(lines).tolist()
    size, inside, links = Counter(), Counter(), Counter()  # of each element: characters, in content lines that are not links, in links
    for x, ok in zip(lines, high):
        for e in x.path:
            size[e] += len(x.text)
            inside[e] += (ok and 2 * x.links < len(x.text)) * len(x.text)
            links[e] += x.links
    paths = [x.path for x, ok in zip(lines, high) if ok]
    regions: set[int] = set()
    for name in ("article", "main"):  # the outermost ones
        regions = regions or {e for path in paths if (e := next((e for e in path if parser.names[e] == name), 0))}
    gone = {e for e in parser.weak if 2 * inside[e] < size[e]}
    if not regions:
        if paths:  # numbers grow with depth
            regions = {max((e for e in set(paths[0]).intersection(*paths) if parser.names[e] in CONTAINERS), default=0)} - {0}
        gone |= {e for e in size if parser.names[e] in LISTS and not inside[e] and 2 * links[e] >= size[e]}
        lines = [x for x in lines if x.anchors < 2 or 5 * x.links < 4 * len(x.text)]  # links in a row
    return "\n".join(x.text for x in lines if (not regions or regions.intersection(x.path)) and not gone.intersection(x.path))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of pages(page_id, url, html).

    Character references are decoded, white space inside a block becomes one space, blocks are joined by a
    line feed in page order. A null or empty html, or one without an article, gives an empty text. Null ids
    and urls stay null; repeated rows give repeated rows; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = K.utf8(batch.column(2))
            for a, b in K.runs(off):
                part = batch.slice(a, b - a)
                texts = [main_text(h) if h else "" for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    rows = narrow(pages, "page_id", "url", "html").selectExpr("CAST(page_id AS BIGINT) page_id", "url", "html")
    return rows.mapInArrow(released(work), "page_id bigint, url string, text string, n_chars bigint")
