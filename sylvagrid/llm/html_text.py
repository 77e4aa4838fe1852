"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events. Text between two block boundaries is a line, with the
tags met since the last one. Elements that are never content by their own name, role or class (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) are left out with all
they hold. A line's text-to-tag ratio is smoothed with a Gaussian over its neighbours, and a threshold of one
standard deviation, for the smoothed and the line's own ratio, parts the lines in two clusters. A region, the nearest article, section or division around
a line, is content if one of its lines is in the upper cluster; of a content region every line is kept,
however short. Where a page has articles with text, only those are regions.

White space inside a line becomes one space, lines are trimmed and joined by a blank line; character references
are decoded once. Null and empty pages give an empty text, as do pages without text. Repeated rows are extracted
alike, other columns stay (``text`` and ``n_chars`` are replaced). A tag that the page's end cuts off is dropped,
a comment without an end takes the rest of the page, as browsers have it; so time is linear in the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, small_batches

RADIUS = 2  # lines; the Gaussian's standard deviation is half of it
THRESHOLD = 1.0  # standard deviations of the smoothed ratios

# The names of HTML elements and roles, and words of class names, by what they stand for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
REGIONS = frozenset("article body div main section td".split())
ARTICLES = frozenset(("article", "main"))
NEVER = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe math menu nav noframes noscript object option script search select "
    "style svg template textarea title video".split())
NEVER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NEVER_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer login "
    "masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related share sharing sidebar social sponsor "
    "sponsored subscribe toolbar widget".split())
# An article's class often names what the theme shows beside it; only these say what the article is.
NEVER_ARTICLES = frozenset("ad ads advert advertisement comment comments notice promo promoted related sponsored".split())
FRAMES = frozenset(("html", "body"))  # likewise
PRESENCE = frozenset("has hide is no show with without".split())  # "has-sidebar" is not a sidebar
# Elements whose start ends others that were left open, and where the search for those stops.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist"),
        "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("tr", "table"), "tbody": ("tr tbody thead", "table"),
        "tfoot": ("tr tbody thead", "table")}
IMPLIED = {tag: (frozenset(ended.split()), frozenset(stop.split())) for tag, (ended, stop) in ENDS.items()}
TRACKED = REGIONS | {"table", "tr"}
UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
COMMENT_END = re.compile(r"--!?>")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
CLOSES_HEAD = frozenset(("body", "article", "main", "header", "nav", "div", "p", "h1"))


@dataclass
class Line:
    text: list[str] = field(default_factory=list)
    tags: int = 0
    region: int = 0


class Page(HTMLParser):
    """The lines of a page outside of what is never content."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # open elements that matter: name, never content, region
        self.depth: dict[str, int] = {}
        self.hidden = 0
        self.regions = 1
        self.articles: set[int] = set()
        self.lines: list[Line] = []
        self.line = Line()

    def region(self) -> int:
        return self.open[-1][2] if self.open else 0

    def cut(self) -> None:
        """End the line at a block boundary."""
        if self.line.text:
            self.lines.append(self.line)
            self.line = Line()

    def never(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in NEVER:
            return True
        if tag in FRAMES:
            return False
        inside = self.region() in self.articles
        if tag == "header":
            return not inside  # an article's own header holds its title
        words = NEVER_ARTICLES if tag in ARTICLES else NEVER_WORDS
        for name, value in attrs:
            if name == "role" and value and value.strip().lower() in NEVER_ROLES:
                return True
            for label in value.split() if name in ("class", "id") and value else ():
                said = [w.lower() for w in WORD.findall(label)]
                if said and said[0] not in PRESENCE and (not words.isdisjoint(said) or (not inside and tag not in ARTICLES and "header" in said)):
                    return True
        return False

    def imply_ends(self, tag: str) -> None:
        """Close what a start tag closes: a paragraph, the last list item, a table's last cell."""
        if self.depth.get("p") and (tag in BLOCKS):
            self.leave("p")
        ended, stop = IMPLIED.get(tag, (frozenset(), frozenset()))
        if any(self.depth.get(x) for x in ended):
            for name, _, _ in reversed(self.open):
                if name in ended:
                    return self.leave(name)
                if name in stop:
                    return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.depth.get("head") and tag in CLOSES_HEAD:
            self.leave("head")
        self.imply_ends(tag)
        never = self.never(tag, attrs)
        if not self.hidden:
            if tag in BLOCKS:
                self.cut()
            self.line.tags += 1
            if tag == "br":
                self.line.text.append(" ")
        if tag in VOID or not (never or self.hidden or tag in TRACKED or self.depth.get(tag)):
            return
        region = self.region()
        if tag in REGIONS and not self.hidden and not never:
            nested = region in self.articles and tag not in ARTICLES  # parts of an article belong to it
            if not nested:
                region, self.regions = self.regions, self.regions + 1
                if tag in ARTICLES:
                    self.articles.add(region)
        self.open.append((tag, never, region))
        self.depth[tag] = self.depth.get(tag, 0) + 1
        self.hidden += never

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def leave(self, tag: str) -> None:
        """Close the innermost open element of a name, and all that were left open inside."""
        while self.depth.get(tag):
            name, never, _ = self.open.pop()
            self.depth[name] -= 1
            self.hidden -= never
            if name == tag:
                break

    def handle_endtag(self, tag: str) -> None:
        self.leave(tag)
        if not self.hidden:
            if tag in BLOCKS:
                self.cut()
            self.line.tags += 1

    def parse_html_declaration(self, i: int) -> int:
        """Where a comment or declaration ends; the page is fed whole, so one without an end takes the rest."""
        if not self.rawdata.startswith("<!--", i):
            end = self.rawdata.find(">", i)
            return end + 1 or len(self.rawdata)
        if self.rawdata.startswith((">", "->"), i + 4):  # an empty comment
            return self.rawdata.index(">", i) + 1
        end = COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def handle_data(self, data: str) -> None:
        if not self.hidden and data:
            if not self.line.text:
                if data.isspace():
                    return
                self.line.region = self.region()
            self.line.text.append(data)


def smoothed(ratio: np.ndarray) -> np.ndarray:
    """Gaussian mean of each value and its neighbours; fewer neighbours at the ends count alike."""
    at = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-0.5 * (at / (RADIUS / 2)) ** 2)
    return np.convolve(ratio, kernel)[RADIUS:RADIUS + len(ratio)] / np.convolve(np.ones(len(ratio)), kernel)[RADIUS:RADIUS + len(ratio)]


def main_text(html: str) -> str:
    last = html.rfind(">") + 1
    unfinished = UNFINISHED.search(html, last)
    page = Page()
    page.feed(html[:unfinished.start()] if unfinished else html)
    page.close()
    page.cut()
    lines = [(" ".join("".join(x.text).split()), max(1, x.tags), x.region) for x in page.lines]
    lines = [x for x in lines if x[0]]
    if any(r in page.articles for _, _, r in lines):
        lines = [x for x in lines if x[2] in page.articles]
    if not lines:
        return ""
    own = np.array([len(t) / n for t, n, _ in lines])
    ratio = smoothed(own)
    # A line reaches the threshold by itself too, or a neighbour's ratio would carry it in; the best line always counts.
    upper = (np.minimum(own, ratio) >= THRESHOLD * ratio.std()) | (ratio == ratio.max())
    content = {r for (_, _, r), x in zip(lines, upper.tolist(), strict=True) if x}
    return "\n\n".join(t for t, _, r in lines if r in content)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``, and ``n_chars``, its code points."""
    own = [c for c in pages.columns if c not in ("text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(h or "") for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in own), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             [*own, "text", "n_chars"])

    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in pages.select(*own).schema),
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return small_batches(pages).select(*own).mapInArrow(run, schema)
