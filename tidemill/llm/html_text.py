"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams events; text between block boundaries is a line, with its ratio of text outside links to tags. Tags and
words of class, id or role weigh the line: nothing in a menu, an advert or a comment, a part where they only hint at such, or stands beside an article. The weighted ratios
are smoothed with a Gaussian and split in two clusters. The upper cluster chooses the content region: the smallest element that
holds nearly all of its text, or the ``article`` or ``main`` round it. Of a region, lines of no weight go, as do lines all of links, or of little
weight, that aren't in the upper cluster; all others are its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm.common import extended, slices, without

#: Elements whose text nobody reads on the page, or only as a control's.
SKIPPED = frozenset("head title script style noscript template svg math canvas button select option textarea label iframe object audio video datalist".split())
#: Elements that are never main text but are lines of the page.
BOILER = frozenset("nav header footer aside form fieldset dialog menu".split())
#: Elements that begin and end a line.
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address center hr details summary hgroup search".split()
) | BOILER | frozenset("head title script style noscript template iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these ends an open element of the same group, as HTML implies.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What an implied end doesn't reach beyond.
SCOPES = frozenset("ul ol dl table".split())
#: Words of class or id that mark an element as other than main text, and those that only hint at it.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices "
    "pager pagination popup promo promotion replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar".split()
)
WEAK = frozenset("header related search widget".split())
#: Words beside them that say nothing, that say the opposite, and that say main text.
PLAIN = frozenset("area bar block body bottom box col column container content form global group inner item items left link links list main module outer page panel primary right row secondary section site slot text title top unit wrap wrapper".split())
NEGATED = frozenset("has hide no show with without".split())
MAIN = frozenset("article body content entry main post story".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: What a line is worth in an element that is hinted at.
HINTED = 0.3
_WORDS = re.compile(r"[a-z0-9]+")
#: A tag that the page's end cuts off.
_CUT = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Lines(HTMLParser):
    """Lines of a page as (text, tags, link characters, element); ``parents``, ``names`` and ``worth`` describe the elements."""

    def __init__(self, marks: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.marks = marks
        self.parents, self.names, self.worth = [-1], ["#page"], [1.0]
        self.open: list[tuple[str, int, bool]] = [("#page", 0, False)]  # name, element, skipped
        self.lines: list[tuple[str, int, int, int]] = []
        self.parts: list[str] = []
        self.n_tags = self.links = 0
        self.in_link = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.n_tags, self.links, self.open[-1][1]))
            self.n_tags = 0
        self.parts.clear()
        self.links = 0

    def pop_to(self, at: int) -> None:
        if not self.open[-1][2]:
            self.end_line()
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.n_tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.in_link += 1
        if tag in BLOCKS:
            if tag in IMPLIED:
                for at in range(len(self.open) - 1, 0, -1):
                    if self.open[at][0] in SCOPES:
                        break
                    if self.open[at][0] in IMPLIED[tag]:
                        self.pop_to(at)
                        break
            elif self.open[-1][0] == "p":
                self.pop_to(len(self.open) - 1)
        if tag in VOID:
            if tag in BLOCKS and not self.open[-1][2]:
                self.end_line()
            return
        skipped = tag in SKIPPED or self.hidden(tag, attrs)
        worth = self.worth_of(tag, attrs) if self.marks else 1.0
        if not (skipped or tag in BLOCKS or worth < 1):
            return
        if not self.open[-1][2]:
            self.end_line()
        above = self.open[-1][1]
        own = tag in ("article", "main") or any(k == "role" and v == "main" for k, v in attrs)
        if tag == "header" and self.marks and self.in_own(above):
            worth = HINTED
        self.parents.append(above)
        self.names.append("main" if own and tag != "article" else tag)
        # An article within what is only hinted at is an article all the same.
        self.worth.append(worth if own and self.worth[above] > 0 else min(worth, self.worth[above]))
        self.open.append((tag, len(self.names) - 1, skipped or self.open[-1][2]))

    def in_own(self, element: int) -> bool:
        while element > 0:
            if self.names[element] in ("article", "main"):
                return True
            element = self.parents[element]
        return False

    @staticmethod
    def hidden(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        return tag not in ("html", "body") and any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and _HIDDEN.search(v or "")) for k, v in attrs)

    @staticmethod
    def worth_of(tag: str, attrs: list[tuple[str, str | None]]) -> float:
        """1, 0 for an element marked as other than main text, or ``HINTED``."""
        if tag in ("html", "body"):
            return 1.0
        worth, mains = 0.0 if tag in BOILER else 1.0, False
        for name, value in attrs:
            value = (value or "").lower()
            if name == "role" and value in ROLES:
                return 0.0
            if name not in ("class", "id"):
                continue
            for token in value.split():
                words = _WORDS.findall(token)
                mains |= bool(words) and MAIN.issuperset(words)
                if NEGATED.isdisjoint(words) and not (STRONG.isdisjoint(words) and WEAK.isdisjoint(words)):
                    unknown = any(w not in STRONG and w not in WEAK and w not in PLAIN and not w[0].isdigit() for w in words)
                    worth = min(worth, HINTED if unknown or STRONG.isdisjoint(words) else 0.0)
        return 1.0 if mains and worth == HINTED else worth

    def handle_endtag(self, tag: str) -> None:
        self.n_tags += 1
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                self.pop_to(at)
                break

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math"):
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if not self.open[-1][2]:
            self.parts.append(data)
            if self.in_link:
                self.links += len(data)


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing with the window cut at the ends."""
    radius = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    whole = np.convolve(ratios, kernel)[radius : radius + len(ratios)]
    return whole / np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """The cut between two clusters on a line, from its ends inwards."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        cut = (low + high) / 2
        upper = values >= cut
        if upper.all():
            return cut
        low, high = float(values[~upper].mean()), float(values[upper].mean())
    return (low + high) / 2


def content_lines(page: Lines, share: float = 0.9, clusters: bool = True) -> list[bool]:
    """Whether each line is main text. Without ``clusters`` every line counts as one of the upper cluster."""
    lines, parents, names = page.lines, page.parents, page.names
    if not lines:
        return []
    at = np.array([e for *_, e in lines])
    worth = np.array(page.worth)
    if page.marks:  # where there is an article, the rest of the page is hinted at
        own = np.zeros(len(parents), bool)
        for i in range(1, len(parents)):
            own[i] = own[parents[i]] or (names[i] in ("article", "main") and worth[i] >= 1)
        if own[at].any():
            worth = np.where(own, worth, np.minimum(worth, HINTED))
    worth = worth[at]
    length, links = np.array([len(t) for t, *_ in lines], float), np.array([n for _, _, n, _ in lines], float)
    ratio = smoothed(np.log1p(worth * np.maximum(length - links, 0) / np.array([max(1, n) for _, n, *_ in lines])))
    upper = (ratio >= threshold(ratio)) & (worth > 0) if clusters else worth > 0
    if not upper.any():
        upper = worth > 0
    weight, count = np.zeros(len(parents)), np.zeros(len(parents), int)
    np.add.at(weight, at, worth * np.maximum(length - links, 0) * upper)
    np.add.at(count, at, 1)
    children: list[list[int]] = [[] for _ in parents]
    for i in range(len(parents) - 1, 0, -1):  # an element's number is above its parent's
        weight[parents[i]] += weight[i]
        count[parents[i]] += count[i]
        children[parents[i]].append(i)
    region = 0
    while weight[0] > 0 and (into := [i for i in children[region] if weight[i] >= share * weight[0] and count[i]]):
        region = into[0]
    own, e = region, region
    while e > 0:  # the outermost article round it, or else the outermost main
        if names[e] == "article" or (names[e] == "main" and names[own] != "article"):
            own = e
        e = parents[e]
    if names[own] in ("article", "main"):
        region = own
    else:  # no paragraph alone is a region
        while region > 0 and names[region] not in ("div", "section", "body", "table", "td", "html"):
            region = parents[region]
    inside = np.zeros(len(parents), bool)
    for i in range(len(parents)):
        inside[i] = i == region or (i > 0 and inside[parents[i]])
    kept, linked = worth >= 1, links >= 0.8 * length
    if clusters:
        kept = np.where(linked, kept & upper, kept | (upper & (worth > 0)))
    else:
        kept &= ~linked
    return (inside[at] & kept).tolist()


def main_text(html: str | None, marks: bool = True, clusters: bool = True) -> str:
    """The main text of a page. ``marks`` and ``clusters`` leave a part of the method out, to see what it does."""
    page = Lines(marks)
    page.feed(_CUT.sub("", html or ""))
    page.close()
    if not page.open[-1][2]:
        page.end_line()
    return "\n".join(line[0] for line, ok in zip(page.lines, content_lines(page, clusters=clusters), strict=True) if ok)


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` with ``text``, the main text of each whole page.

    A null or empty page, or one without text, gives an empty text. Pages of any length are read whole, a tag that the end cuts off is no text; repeated
    rows give the same text each, an empty table an empty one, and an older ``text`` column is replaced. Nothing is shuffled.
    """
    df = without(df, "text")
    names, at = df.columns, df.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, names[at]):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([main_text(h) for h in b.column(at).to_pylist()], pa.string())], [*names, "text"])

    return df.mapInArrow(run, extended(df, text="string"))


def op6_html_extraction(pages: DataFrame) -> DataFrame:
    """The main text of every page."""
    return extract(pages.select("page_id", "url", "html")).selectExpr("page_id", "url", "text", "cast(char_length(text) as bigint) n_chars")
