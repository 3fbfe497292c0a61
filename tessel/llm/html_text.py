"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element. A line's weight is its length
without link text. Tags only feed the weights: lines under menus, headers, footers, sidebars,
notices, adverts, forms and comments (an article within an article is one) weigh nothing, and where
a page marks article or main elements, so do lines outside of them. Weights are summed over
sliding windows of `window` lines of the whole page; the text surges where such a sum rises from
nothing and dives where it falls back to nothing, and lines between surge and dive are kept.

Where article or main elements are marked, every such stretch is kept, whichever of them it is
in, with a heading right before it; what lies between (runs of links) is not. Elsewhere the
heaviest stretch is kept, and with it those that have lines of its section, so an
advert of many lines does not cut an article. Of equally heavy stretches or sections the first is taken.

Nulls: a null or empty page has no text. Unclosed and stray tags are met with the
usual rules (a block opens a new line; an end tag closes what it names, if it is open).
Repeated rows are reported as often; other columns are not read, so their names don't matter.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

#: Fixed values of HTML: elements that break a line, without content of their own, and whose content is no text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select".split())
OUTSIDE = frozenset("head title nav header footer aside form button menu dialog label fieldset".split())
SECTION = frozenset("article body div main section table td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADING = re.compile(r"header|title|heading", re.I)
#: Words of class, id and role that name what is no article text.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|promoted|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscribe|signup|menu|nav|navbar|navigation|breadcrumb\w*|sidebar\w*|side|aside|widget\w*|footer|foot|header|masthead|topbar|toolbar|comments?|commentlist|disqus|replies|respond|reply|share|sharing|social|related|recommend\w*|pagination|pager|search|login|skip|complementary|contentinfo|copyright|disclaimer|tags|byline-links)(?=$|[\s_-])",
    re.I,
)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*?(?:>|\Z)", re.S)
NAME = re.compile(r"</?\s*([a-zA-Z][^\s/>]*)")
NAMING = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\shidden(?:[\s>=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Open:
    __slots__ = ("name", "outside", "link", "core", "box", "heading", "article")

    def __init__(self, name: str, outside: bool, link: bool, core: bool, box: int, heading: bool, article: bool):
        self.name, self.outside, self.link, self.core, self.box, self.heading, self.article = name, outside, link, core, box, heading, article


class Line(NamedTuple):
    """weight: characters that are no link's; article: in an article or main element; section: number of the element it is in, 0 for none."""

    text: str
    weight: int
    outside: bool
    article: bool
    section: int
    heading: bool


def lines_of(page: str) -> list[Line]:
    """The lines of a page, those outside its main text too."""
    out: list[Line] = []
    stack: list[_Open] = []
    pieces: list[str] = []
    linked = boxes = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            top = stack[-1] if stack else None
            outside = bool(top and top.outside)
            out.append(Line(text, 0 if outside else max(0, len(text) - linked), outside, bool(top and top.core), top.box if top else 0, bool(top and top.heading)))
        pieces.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            pieces.append(text)
            if stack and stack[-1].link:
                linked += len(" ".join(text.split()))

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        say(page[at:lt])
        found = TOKEN.match(page, lt)
        if not found:
            say("<")
            at = lt + 1
            continue
        tag, at = found.group(), found.end()
        if tag[1] in "!?":
            if tag.startswith("<![CDATA["):
                say(tag[9:-3])
            continue
        name = NAME.match(tag).group(1).lower()
        if tag[1] == "/":
            if name in BLOCK:
                flush()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth].name == name:
                    if any(x.name in ("article", "main", "body") for x in stack[depth + 1 :]) and name not in BLOCK:
                        break
                    del stack[depth:]
                    break
            continue
        if name in RAW:
            if not tag.endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(page, at)
                at = end.end() if end else (n if name in ("script", "style") else at)
            if name not in ("svg", "math"):
                say(" ")
            continue
        if name == "br":
            say(" ")
            continue
        if name in BLOCK:
            flush()
        if name in VOID or tag.endswith("/>") and name not in BLOCK:
            continue
        if name == "p" or name == "li":  # an open paragraph or item ends where the next begins
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth].name == name:
                    del stack[depth:]
                    break
                if stack[depth].name in BLOCK and stack[depth].name != "p":
                    break
        above = stack[-1] if stack else None
        outside = bool(above and above.outside)
        core = bool(above and above.core)
        if name in ("article", "main") and not outside:
            core, outside = True, name == "article" and bool(above and above.article)
        elif name not in ("body", "html") and not outside:
            outside = name in OUTSIDE and not (name == "header" and core) or bool(HIDDEN.search(tag))
            if not outside and "=" in tag:
                outside = any(NAMES.search("".join(m)) and not (core and HEADING.search("".join(m))) for m in NAMING.findall(tag))
        box = above.box if above else 0
        if name in SECTION:
            boxes += 1
            box = boxes
        stack.append(_Open(name, outside, name == "a" or bool(above and above.link), core, box, name in HEADINGS or bool(above and above.heading), name == "article" or bool(above and above.article)))
    flush()
    return out


def window_sums(weights: list[int], window: int) -> list[int]:
    """The sum of weights over the window around each line."""
    half = window // 2
    return [sum(weights[max(0, i - half) : i + half + 1]) for i in range(len(weights))]


def main_text(page: str | None, window: int = 3) -> str:
    """The blocks of the main text, joined by a blank line."""
    lines = lines_of(page) if page else []
    marked = any(x.article and not x.outside for x in lines)
    sums = window_sums([x.weight if x.article or not marked else 0 for x in lines], window)
    stretches, surge = [], None
    for i, total in enumerate([*sums, 0]):
        if total and surge is None:
            surge = i
        elif not total and surge is not None:
            stretches.append((surge, i))
            surge = None
    if marked:
        inside, follows = [total > 0 for total in sums], False
        for i in range(len(lines) - 1, -1, -1):
            if lines[i].heading and not lines[i].outside:
                inside[i] = inside[i] or follows
            elif not lines[i].outside:
                follows = inside[i]
        return "\n\n".join(x.text for x, own in zip(lines, inside, strict=True) if own and x.article and not x.outside)
    if not stretches:
        return ""
    surge, dive = max(stretches, key=lambda s: sum(x.weight for x in lines[s[0] : s[1]]))
    section: dict[int, int] = {}
    for x in lines[surge:dive]:
        section[x.section] = section.get(x.section, 0) + x.weight
    home = max(section, key=section.get)
    keep = [s for s in stretches if any(x.section == home and x.weight for x in lines[s[0] : s[1]])]
    return "\n\n".join(x.text for a, b in keep for x in lines[a:b] if not x.outside)


def _extract(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(x, window) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def html_text(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, window: int = 3) -> DataFrame:
    """One row for each page: page_id, url, text (empty if there is none), n_chars (code points)."""
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(_extract(window), "page_id bigint, url string, text string, n_chars bigint")
