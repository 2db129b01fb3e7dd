"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines: the text of a block element is a line, decoded, white space in it being one space.  Page
structure leaves empty lines behind: two containers that meet are two apart, sections, and what is no article by its
element or name (menus, headers, footers, sidebars, notices, adverts, forms, comments), are a whole window apart.
A line weighs its characters outside links, and a window sums ``window`` lines on end.  The main text begins where the
sums surge from nothing and ends where they dive back to it:

1. Where the page marks its article, the surge and the dive lie at the edges of the heaviest article, and of those
   whose largest sum is half of its own or more.
2. Else runs of positive sums are compared in the same way, and lines at a run's border that a container cuts off go
   while their own sums are far below the run's (a heading that leads in the text stays).
3. Windows inside that hold links alone are menus and go.

Every page is read in one pass, in time linear in its length, in the task that scans it; nothing is shuffled.

Defined results: a null or empty page, or one without text outside such parts, has an empty text.  What is not closed
ends with what holds it, a raw element (script, style, title) or comment with the page.  One ``br`` is white space,
several on end finish the line.  A form that holds all of the page's text is no form.  White space is Unicode's.  Rows
are independent, so repeated rows and ids, ties and nulls in other columns need no rule.  Pages of any length are
read whole.  An empty table gives an empty table.  Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from html import unescape
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from .common import mapped


def words(text: str) -> frozenset[str]:
    return frozenset(text.split())


# HTML's elements by their kind, and the names that pages give to what is no article.
VOID = words("area base br col embed hr img input link meta param source track wbr")
RAW = words("iframe noembed noframes noscript script style textarea title xmp")
HEADINGS = words("h1 h2 h3 h4 h5 h6")
LINES = HEADINGS | words("address blockquote caption center dd dt figcaption hr legend li option p pre summary tr")
CONTAINERS = words("body colgroup details div dl fieldset figure frameset head hgroup html ol table tbody td tfoot th thead ul")
SECTIONS = words("article aside dialog footer form header main menu nav search section")
NO_ARTICLE = words("aside audio button canvas datalist dialog footer form header math menu nav object search select svg template video")
ROLES = words("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar")
NAMES = words(
    """ad ads adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies
    copyright discussion disqus feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay
    pager pagination popup promo promoted recommendations recommended related replies respond responses search share sharing sidebar signup
    skip social sponsor sponsored subscribe teaser toolbar topbar widget widgets"""
)
OF_ARTICLES, LEADS, NEGATIONS = words("article content entry post story"), words("banner header"), words("has hide is no show with without")
#: Elements that a new one of theirs ends, inside the nearest of the others.
IMPLIED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select datalist")}

# quotes count after an equals sign alone, and only if they end
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
PART = re.compile(r"[-_:]+|(?<=[a-z0-9])(?=[A-Z])")


class Line(NamedTuple):
    text: str
    weight: int
    gap: int
    host: int
    heading: bool


def named(name: str) -> bool:
    """Whether a class or id names what is no article."""
    parts = [p.lower() for p in PART.split(name) if p]
    if not parts or parts[0] in NEGATIONS or (parts[0] in OF_ARTICLES and parts[-1] in LEADS):
        return False
    return parts[0] in NAMES or parts[-1] in NAMES


def unwanted(tag: str, attributes: str, in_host: bool) -> bool:
    """Whether an element is no part of an article; headers inside one are."""
    if tag in NO_ARTICLE and not (tag == "header" and in_host):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True
    if tag == "article" or tag in HEADINGS:  # its layout's names say nothing
        return any(x in NAMES - LEADS - {"notice", "alert"} for x in found.get("class", "").lower().split())
    return found.get("role", "").lower() in ROLES or any(map(named, found.get("class", "").split() + found.get("id", "").split()))


class Page:
    """One pass over a page that collects its lines."""

    def __init__(self, window: int, forms: bool):
        self.window, self.forms = window, forms
        self.lines: list[Line] = []
        self.pieces: list[tuple[str, bool]] = []
        self.gap = self.breaks = self.hosts = self.off = 0
        self.link = self.heading = False
        self.open: list[tuple[str, bool, int]] = []  # name, unwanted, the host that it begins
        self.at: dict[str, list[int]] = {}
        self.within: list[int] = []

    def finish(self, gap: int) -> None:
        """The end of a line, and empty lines after it."""
        if self.pieces:
            decoded = [(unescape(t), linked) for t, linked in self.pieces]
            text = " ".join("".join(t for t, _ in decoded).split())
            if text:
                weight = sum(len("".join(t.split())) for t, linked in decoded if not linked)
                self.lines.append(Line(text, weight, self.gap, self.within[0] if self.within else 0, self.heading))
                self.gap = 0
            self.pieces = []
        self.link, self.breaks = False, 0
        self.gap += gap

    def close(self, place: int) -> None:
        """Ends the open elements from a place in the stack on."""
        while len(self.open) > place:
            name, off, host = self.open.pop()
            self.at[name].pop()
            self.off -= off
            if host:
                self.within.pop()

    def size(self, name: str) -> int:
        """The empty lines that an element leaves before and after it."""
        return self.window if name in SECTIONS else int(name in CONTAINERS)

    def begin(self, name: str, attributes: str) -> None:
        if name == "br":
            self.breaks += 1
            if self.breaks > 1:
                self.finish(0)
            else:
                self.pieces.append((" ", True))
            return
        block = name in LINES or name in CONTAINERS or name in SECTIONS
        if block:
            if self.at.get("p"):
                self.close(self.at["p"][-1])
            if name in IMPLIED:
                mine, others = IMPLIED[name]
                edge = max((self.at[x][-1] for x in others.split() if self.at.get(x)), default=-1)
                if (inner := min((y for x in mine.split() for y in self.at.get(x, ())[-1:] if y > edge), default=None)) is not None:
                    self.close(inner)
            self.finish(self.size(name))
            self.heading = name in HEADINGS
        if name in VOID:
            return
        host = name in ("main", "article") or bool(re.search(r"\brole\s*=\s*[\"']?main\b", attributes))
        if host and self.off and all(x in ("form", "header") for x, off, _ in self.open if off):
            self.open, self.off = [(x, False, h) for x, _, h in self.open], 0  # a form or header around the article
        off = unwanted(name, attributes, bool(self.within)) and not (name == "form" and self.forms)
        if off and not block:
            self.pieces.append((" ", True))
        number = 0
        if host and not off and not self.off:
            self.hosts += 1
            number = self.hosts
            self.within.append(number)
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append((name, off, number))
        self.off += off
        if name == "a":
            self.link = True

    def end(self, name: str) -> None:
        if name in LINES or name in CONTAINERS or name in SECTIONS:
            self.finish(self.size(name))
            self.heading = False
        off = self.off
        if self.at.get(name):
            self.close(self.at[name][-1])
        if off and not self.off:
            self.gap += self.window if name in LINES or name in CONTAINERS or name in SECTIONS else 0
        if name == "a":
            self.link = False

    def say(self, text: str) -> None:
        if text and not self.off:
            self.pieces.append((text, self.link))
            if self.breaks and not text.isspace():
                self.breaks = 0

    def read(self, html: str) -> list[Line]:
        at = 0
        while (mark := html.find("<", at)) >= 0:
            self.say(html[at:mark])
            at = mark
            if html.startswith("<!--", mark):
                end = html.find("-->", mark + 2)
                at = len(html) if end < 0 else end + 3
            elif html[mark + 1 : mark + 2] in ("!", "?") or (html.startswith("</", mark) and not html[mark + 2 : mark + 3].isalpha()):
                end = html.find(">", mark)
                at = len(html) if end < 0 else end + 1
            elif not (html[mark + 1 : mark + 2].isalpha() or html.startswith("</", mark)):
                self.say("<")
                at = mark + 1
            else:
                found = TAG.match(html, mark)
                if not found:  # a tag without its end
                    at = len(html)
                    continue
                at, name = found.end(), found[2].lower()
                if found[1]:
                    self.end(name)
                elif name in RAW:
                    end = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
                    at = html.find(">", end.start()) + 1 or len(html) if end else len(html)
                else:
                    self.begin(name, found[3])
                    if name in ("svg", "math") and found[3].endswith("/"):
                        self.end(name)
        self.say(html[at:])
        self.finish(0)
        return self.lines


def peaks(lines: list[Line], window: int) -> np.ndarray:
    """For each line the largest sum of the windows that hold it, empty lines between counted."""
    places = np.cumsum([min(x.gap, window) + 1 for x in lines])
    weights = np.zeros(places[-1] + 1, np.int64)
    weights[places] = [x.weight for x in lines]
    sums = np.convolve(weights, np.ones(window, np.int64))
    return np.stack([sums[places + i] for i in range(window)]).max(axis=0)


def between(lines: list[Line], window: int, border: float, least: int) -> list[Line]:
    """A run of positive sums from its surge to its dive."""
    top = peaks(lines, window)
    strong = np.flatnonzero(top >= min(border * top.max(), least))
    first, last = int(strong[0]), int(strong[-1])
    while first and (lines[first].gap < 2 or lines[first - 1].heading):
        first -= 1
    while last + 1 < len(lines) and lines[last + 1].gap < 2:
        last += 1
    return lines[first : last + 1]


def main_lines(lines: list[Line], window: int = 3, share: float = 0.5, border: float = 0.2, least: int = 80) -> list[str]:
    """The texts of the lines between surge and dive."""
    marked = any(x.host and x.weight for x in lines)
    parts, last = [], None
    for x in lines:
        if marked and not x.host:
            continue
        if not parts or (x.host != last if marked else x.gap >= window):
            parts.append([])
        parts[-1].append(x)
        last = x.host
    tops = [peaks(p, window).max() for p in parts]
    heaviest = max(range(len(parts)), key=lambda i: sum(x.weight for x in parts[i]), default=None)
    out = []
    for part, top in zip(parts, tops):
        if not top or top < share * tops[heaviest]:
            continue
        for menu, run in groupby(part if marked else between(part, window, border, least), lambda x: x.weight == 0):
            run = [x.text for x in run]
            out += [] if menu and len(run) >= window else run
    return out


def main_text(html: str | None, window: int = 3) -> str:
    """The main text of a page, a line for each block."""
    lines = Page(window, False).read(html or "") or Page(window, True).read(html or "")
    return "\n".join(main_lines(lines, window))


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", *, window: int = 3) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of pages."""
    made = mapped(pages, [page_id, url], html, [StructField("_text", StringType())], lambda values: (pa.array([main_text(v, window) for v in values], pa.string()),))
    return made.select(F.col(f"`{page_id}`"), F.col(f"`{url}`"), F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
