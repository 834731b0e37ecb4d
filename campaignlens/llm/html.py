"""Main text of web pages: parser events, text-to-tag ratios smoothed over lines, and clusters of content lines.

The standard library's streaming parser splits a page into lines (blocks of text). Each
line has a text-to-tag ratio, in which link text counts as tags; what tag, role or class mark as a menu, advert, comment
and the like only scales it down. Ratios are smoothed with a Gaussian, and two-means clustering of the smoothed ratios
gives a threshold: lines above it are content. The content region is the innermost element that holds nearly all text of content lines, and
from there the article or main element around it, or else the outermost elements that add no
more links than text. In such an element all lines count, also short and linked ones, but for marked ones below the threshold and,
outside an article, lists of links before or after the content. Where only the page's body holds the content, the runs of content lines
select it: lines before the first and after the last are left out. All steps take time linear in the page.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from campaignlens.llm.common import append_columns, small_batches

# Elements that start a new line, whose text no reader sees as text, that mark something else than main text, and that have no end.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
UNSEEN = frozenset("head script style noscript template iframe object embed svg math canvas audio video button select textarea input title applet form".split())
MARKS = frozenset("nav header footer aside dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LISTS = frozenset("ul ol dl".split())
FRAMES = frozenset(("html", "body"))
NEVER_NAMED = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
ENDED_BY = {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "tr": ("p", "td", "th", "tr"), "br": (), "option": ()}
REGIONS = frozenset("article section main div body html table tbody tr td blockquote center details figure".split()) | LISTS | UNSEEN | MARKS
NAMES_OTHER = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sidebar aside widget related recommended recommendations trending share sharing social follow newsletter subscribe subscription signup login "
    "comment comments comentarios disqus reply replies respond footer foot header masthead topbar toolbar copyright legal disclaimer search form skip".split()
)
#: Words of these that articles have as subjects too: a name marks only if its other words, if any, are of such or of a page's furniture.
NAMES_EITHER = frozenset("notice notices alert related recommended recommendations trending share sharing social follow promotion banner reply replies respond legal search form skip menu foot".split())
FURNITURE = frozenset(
    "area articles bar block bottom box button buttons card cards col column container content div entries footer grid group header icon icons inner item items left link links list message module more msg news outer page pages panel "
    "post posts primary region results right row secondary section site stories story tab tabs tags text title to top us widgets wrap wrapper you your".split()
)
NAMES_MAIN = frozenset("article content main post entry story body text".split())
ROLES_OTHER = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
NAME = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: What a mark leaves of a ratio, the least ratio of content, and the largest smoothed one after scaling.
MARKED, LEAST, SCALE = 0.0002, 0.02, 1000.0
#: Text of the largest run of content lines that another needs to be content as well, and the low lines that end a run.
RUN_SHARE, GAP = 0.1, 5


@dataclass
class Line:
    text: str
    tags: int
    linked: int
    region: int  # the innermost
    mark: int  # the innermost marked region around it, 0 for none

    @property
    def is_link(self) -> bool:
        return self.linked >= 0.8 * len(self.text)


class Lines(HTMLParser):
    """Collects lines and regions. Region 0 is the page; of the others ``tags`` are the tags, ``parents`` the regions around them and ``spans`` their first and one past their last line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.tags_of, self.parents, self.spans = [""], [0], [[0, 0]]
        self.open: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # tag, number, innermost mark, unseen
        self.opened: Counter = Counter()
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0

    def read(self, html: str) -> None:
        """A tag that the page's end cuts off is no text."""
        whole = html.rfind(">") + 1
        self.feed(html[:whole])
        self.close()
        if not self.cdata_elem:
            self.handle_data(unescape(re.split("<[A-Za-z/!?]", html[whole:], maxsplit=1)[0]))
        self.end_line()
        for _, number, _, _ in self.open:
            self.spans[number][1] = len(self.lines)

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            _, number, mark, unseen = self.open[-1]
            if text and not unseen:
                self.lines.append(Line(text, self.tags, self.linked, number, mark))
            self.parts = []
        self.tags = self.linked = 0

    def handle_starttag(self, tag, attrs):
        named, hidden = self.named(attrs) if attrs and tag not in NEVER_NAMED else (False, False)
        if tag in BLOCKS or tag in REGIONS or named or hidden:
            self.end_line()
            # these may have no end tag of their own
            while tag in BLOCKS and self.open[-1][0] in ENDED_BY.get(tag, ("p",)):
                self.close_last()
        self.tags += 1
        if tag == "a":
            self.links += 1
        if (tag in REGIONS or named or hidden) and tag not in VOID:
            _, parent, mark, unseen = self.open[-1]
            number = len(self.parents)
            self.tags_of.append(tag)
            self.parents.append(parent)
            self.spans.append([len(self.lines), len(self.lines)])
            self.open.append((tag, number, number if named or tag in MARKS else mark, unseen or hidden or tag in UNSEEN))
            self.opened[tag] += 1

    @staticmethod
    def named(attrs) -> tuple[bool, bool]:
        """Whether attributes name something else than main text, and whether they hide the element."""
        other = False
        for key, value in attrs:
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and value and HIDDEN.search(value):
                return False, True
            if key == "role" and value in ROLES_OTHER:
                other = True
            if key in ("class", "id") and value:
                for name in value.split():
                    words = set(NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
                    telling = bool(words & NAMES_OTHER - NAMES_EITHER) or words <= NAMES_OTHER | FURNITURE
                    other |= bool(words & NAMES_OTHER and telling and not words & NAMES_MAIN or "comment" in words or "comments" in words)
        return other, False

    def handle_endtag(self, tag):
        if tag in BLOCKS or tag in REGIONS or self.opened[tag]:
            self.end_line()
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if self.opened[tag]:
            while self.close_last() != tag:
                pass

    def close_last(self) -> str:
        tag, number, _, _ = self.open.pop()
        self.opened[tag] -= 1
        self.spans[number][1] = len(self.lines)
        return tag

    def parse_comment(self, i, report=1):
        """A comment without an end reaches to that of the page."""
        end = self.rawdata.find("-->", i + 4)
        return end + 3 if end >= 0 else len(self.rawdata)

    def parse_marked_section(self, i, report=1):
        """As in browsers, these sections end at the next ``>``."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    def handle_data(self, data):
        self.parts.append(data)
        if self.links:
            self.linked += len(data)


def smoothed(values: np.ndarray, radius: int = 2, sigma: float = 1.0) -> np.ndarray:
    """Gaussian mean over the lines beside each, by the weight that lies within the page."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel, "full")[radius : radius + len(x)]
    return full(values) / full(np.ones(len(values)))


def threshold(values: np.ndarray) -> float:
    """Half way between the centres of two clusters of the values, on a logarithmic scale."""
    x = np.log1p(values)
    low, high = x.min(), x.max()
    for _ in range(20):
        middle = (low + high) / 2
        up = x >= middle
        if up.all() or not up.any():
            break
        low, high = x[~up].mean(), x[up].mean()
    return float(np.expm1((low + high) / 2))


def content_lines(lines: list[Line]) -> np.ndarray:
    """Which lines the smoothed ratios put in the upper cluster. Marked lines and links are not lifted by what stands beside them."""
    ratio = np.array([(len(x.text) - x.linked) / max(1, x.tags) * (MARKED if x.mark else 1) for x in lines], float)
    near = smoothed(ratio)
    alone = np.array([bool(x.mark) or x.is_link for x in lines])
    near[alone] = np.minimum(near, ratio)[alone]
    if near.max() < LEAST:
        return np.zeros(len(lines), bool)
    scaled = near * (SCALE / near.max())
    return (scaled >= threshold(scaled)) & (near >= LEAST)


def main_text(html: str | None, share: float = 0.9) -> str:
    """Text of a page's content region, its lines joined by one space."""
    if not html:
        return ""
    page = Lines()
    page.read(html)
    lines = page.lines
    content = content_lines(lines) if lines else np.zeros(0, bool)
    if not content.any():
        return ""
    # text of content lines, all text and link text up to each line
    plain = np.array([len(x.text) - x.linked for x in lines])
    upto = [np.concatenate([[0], np.cumsum(x)]) for x in (plain * content, plain * ~content, [x.linked for x in lines])]
    mass = np.array([upto[0][b] - upto[0][a] for a, b in page.spans])
    # regions are numbered as they open, so of nested ones the innermost has the largest number
    region = int(np.flatnonzero(mass >= share * upto[0][-1])[-1])
    region = climbed(region, page, upto)
    first, last = page.spans[region]
    kept = np.array([x.mark <= region for x in lines]) | content
    inside = first + np.flatnonzero(content[first:last])
    if page.tags_of[region] in FRAMES or not region:
        first, last = dense(lines, content, inside, first, last)
        kept &= ~in_runs_of_links(lines, content)
    elif not is_within(region, page, "article"):
        # an article's own lists, and those between its lines, are text
        for a, b in link_lists(page, first, last, inside[0], inside[-1]):
            kept[a:b] = False
    return " ".join(x.text for x, stays in zip(lines[first:last], kept[first:last]) if stays)


def ancestors(region: int, page: Lines):
    while region:
        yield region
        region = page.parents[region]


def is_within(region: int, page: Lines, tag: str) -> bool:
    return any(page.tags_of[r] == tag for r in ancestors(region, page))


def climbed(region: int, page: Lines, upto: list) -> int:
    """The outermost article around a region, else the main element, else the widest element around it that plain text alone adds to."""
    around = list(ancestors(region, page))
    for tag in ("article", "main"):
        found = [r for r in around if page.tags_of[r] == tag]
        if found:
            return found[-1]
    total = lambda r: sum(x[page.spans[r][1]] - x[page.spans[r][0]] for x in upto)
    linked = lambda r: upto[2][page.spans[r][1]] - upto[2][page.spans[r][0]]
    for wider in around[1:]:
        # links beside the content mean that the wider element is the page's frame
        if page.tags_of[wider] in FRAMES or (linked(wider) - linked(region)) * 2 > total(wider) - total(region):
            break
        region = wider
    return region


def dense(lines: list[Line], content: np.ndarray, inside: np.ndarray, first: int, last: int) -> tuple[int, int]:
    """From the first to one past the last of the runs of content lines that hold much of the text. More than ``GAP`` low lines in a row end a run."""
    runs = np.split(inside, np.flatnonzero(np.diff(inside) > GAP + 1) + 1)
    sizes = [sum(len(lines[i].text) - lines[i].linked for i in run) for run in runs]
    large = [run for run, size in zip(runs, sizes) if size >= RUN_SHARE * max(sizes)]
    return int(large[0][0]), int(large[-1][-1]) + 1


def in_runs_of_links(lines: list[Line], content: np.ndarray) -> np.ndarray:
    """Low lines that are links, more than ``GAP`` in a row: a menu between runs of content."""
    out = np.array([x.is_link for x in lines]) & ~content
    edges = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(int), [0]])))
    for a, b in edges.reshape(-1, 2):
        out[a:b] = b - a > GAP
    return out


def link_lists(page: Lines, first: int, last: int, content: int, end: int):
    """Spans of lists of two lines or more within a region that are all links and end before its first content line or begin after its last one."""
    links = np.concatenate([[0], np.cumsum([x.is_link for x in page.lines])])
    for tag, (a, b) in zip(page.tags_of, page.spans):
        if tag in LISTS and first <= a and b <= last and b - a > 1 and links[b] - links[a] == b - a and (b <= content or a > end):
            yield a, b


def extract_main_text(df: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """Append ``out``: the main text of each whole page, empty where there is none or the page is null.

    Broken markup is read as the parser recovers; a tag or comment that the page's end cuts off is no text. A page without content lines, such
    as one of menus or links alone, gives an empty text. Repeated rows are extracted each. A column named
    ``out`` is replaced, also if it is the input.
    """
    small_batches(df.sparkSession, 500)
    return append_columns(df, html_col, T.StructType([T.StructField(out, T.StringType())]), lambda: lambda pages: [[main_text(p) for p in pages]])
