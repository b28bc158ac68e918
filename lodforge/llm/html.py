"""Main-text extraction: parser events, text-to-tag ratio per line, Gaussian smoothing and threshold clustering.

The standard library's parser streams events; block elements cut the page into lines, each with its characters, those inside
links, and tags. The ratio of a line is its characters outside links over its tags. Ratios are smoothed, and lines at or above
the standard deviation of the smoothed ratios are content. Content then decides twice:

- *Marks.* Tags, roles and class or id words mark menus, sidebars, notices, adverts, forms and comments. Lines of nothing but
  links count as marked too. A marked element is left out, but for a word or form that holds the page's title or, with no
  article beside it, half of the content: then the mark is wrong and only marks inside it count.
- *Region.* Ratios of marked lines fall to zero and those inside article or main double. If articles hold half of the content
  they are the region; else it is the element whose content lines outweigh its other lines most. Every unmarked line of the
  region stays, however short, and so does every unmarked article.

Elements are numbered and know their parent, and sums run once over all of them, so time is linear in the page however deep
it is nested. Defined cases: null or empty html, or a page whose lines are all marked: empty text, 0 characters; unclosed
elements end with their parent; equal scores go to the outer element; repeated rows each get their result; extra columns stay.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed words: elements by their role on a page, and words in class or id that mark what is no main text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never text; always marked; never marked by words.
SILENT = frozenset("button canvas datalist head iframe noscript object script select style svg template textarea title".split())
STRONG = frozenset("aside dialog footer menu nav".split())
UNMARKED = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notices overlay pager pagination popup promo promoted promotion recommended recommendations related replies reply respond search share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
NEGATED = frozenset("has no with without".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Elements that a new one of the group ends.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIER = frozenset("article aside blockquote body div dl fieldset form main nav ol section table td th ul".split())
#: Elements that can be the region; blocks of text can't.
_CONTAINERS = frozenset("article body center div html main section".split())
SIGMA, REACH, HALF = 1.0, 3, 0.5
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def marks(name: str) -> bool:
    """Whether a class or id name marks its element: by its last word, or by the first of at most two, unless negated."""
    words = [w.lower() for w in _WORD.findall(name)]
    return bool(words) and words[0] not in NEGATED and (words[-1] in MARKED or len(words) <= 2 and words[0] in MARKED)


class _Lines(HTMLParser):
    """Collects ``lines`` (text, tags, link characters, links, element) and elements: ``parent``, ``tag``, ``mark`` (0, 1 by words, 2 strong)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.parent, self.tag, self.mark = [], [-1], [""], [0]
        self.open, self.count, self.scopes = [0], Counter(), [(0, Counter())]  # a scope: place of its barrier in ``open``, names open inside
        self.text, self.tags, self.linked, self.links, self.silent, self.anchors = [], 0, 0, 0, None, 0

    def _mark(self, tag: str, attrs: list) -> tuple[bool, int]:
        """Whether the element is never shown, and its mark."""
        found = 2 if tag in STRONG or tag == "header" and not (self.count["article"] or self.count["main"]) else 1 if tag == "form" else 0
        for name, value in attrs:
            value = value or ""
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                return tag not in UNMARKED, found
            if name == "role" and value.lower() in ROLES:
                found = max(found, 1 if value.lower() == "form" else 2)
            elif name in ("class", "id") and not found and tag not in UNMARKED:
                inside = self.count["article"] or self.count["main"]
                found = int(any(marks(n) and not (inside and n.lower().endswith(("header", "masthead"))) for n in value.split()))
        return tag in SILENT, found

    def cut(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.links, self.open[-1]))
            self.tags = 0
        self.text, self.linked, self.links = [], 0, 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            if self.silent is not None and self.tag[self.silent] not in SILENT and self.mark[self.silent] == 1 and self.tag[self.silent] not in BLOCKS:
                self.silent = None  # a marked inline element that holds blocks is an element like others
            if self.silent is None:
                self.cut()
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        ended = CLOSES.get(tag) or (CLOSES["p"] if tag in BLOCKS else ())
        if ended:
            barrier, inside = self.scopes[-1]
            if any(inside[name] for name in ended):
                k = len(self.open) - 1
                while self.tag[self.open[k]] not in ended:
                    k -= 1
                self._close(k)
            elif self.tag[self.open[barrier]] in ended:
                self._close(barrier)
        never, mark = self._mark(tag, attrs)
        own = len(self.tag)
        self.parent.append(self.open[-1]), self.tag.append(tag), self.mark.append(mark)
        if self.silent is None and (never or mark == 1 and tag not in BLOCKS):  # its data is dropped and the line goes on
            self.silent = own
        if tag == "a":
            self.anchors += 1
            self.links += 1
        self.scopes[-1][1][tag] += 1
        self.count[tag] += 1
        self.open.append(own)
        if tag in _BARRIER:
            self.scopes.append((len(self.open) - 1, Counter()))

    def _close(self, k: int) -> None:
        if self.silent is not None and self.silent >= self.open[k]:
            self.silent = None
        for i in range(len(self.open) - 1, k - 1, -1):
            if self.scopes[-1][0] == i:
                self.scopes.pop()
            name = self.tag[self.open[i]]
            self.scopes[-1][1][name] -= 1
            self.count[name] -= 1
            self.anchors -= name == "a"
        del self.open[k:]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if not (self.count if tag in _BARRIER else self.scopes[-1][1])[tag]:
            return
        k = len(self.open) - 1
        while self.tag[self.open[k]] != tag:
            k -= 1
        if tag in BLOCKS and (self.silent is None or self.silent >= self.open[k]):
            self.cut()
        self._close(k)

    def handle_data(self, data):
        if self.silent is None:
            self.text.append(data)
            if self.anchors:
                self.linked += len("".join(data.split()))


def smooth(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing that keeps its weight at the ends."""
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    cut = slice(REACH, REACH + len(ratios))
    return np.convolve(ratios, kernel)[cut] / np.convolve(np.ones(len(ratios)), kernel)[cut]


def content_lines(ratios: np.ndarray) -> np.ndarray:
    """Lines of the cluster at or above the standard deviation of the smoothed ratios."""
    smoothed = smooth(ratios)
    return (smoothed >= smoothed.std()) & (smoothed > 0)


def _below(parent: list[int], at: np.ndarray, values: np.ndarray) -> list[float]:
    """Sums of ``values`` (of lines at elements ``at``) over every element's subtree; parents come before their children."""
    total = np.bincount(at, values, len(parent)).tolist()
    for e in range(len(parent) - 1, 0, -1):
        total[parent[e]] += total[e]
    return total


def _handed_down(parent: list[int], own: list) -> list:
    """The value of the outermost ancestor-or-self that has one."""
    out = list(own)
    for e in range(1, len(parent)):
        out[e] = out[parent[e]] or own[e]
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    lines, parent, tag = parser.lines, parser.parent, parser.tag
    if not lines:
        return ""
    size, tags, linked = (np.array(x, np.float64) for x in ([len(x[0]) for x in lines], [x[1] for x in lines], [x[2] for x in lines]))
    at, letters = np.array([x[4] for x in lines]), np.array([len("".join(x[0].split())) for x in lines])
    free = np.maximum(letters - linked, 0.0)
    bare = free <= 0.1 * letters  # nothing but links and what separates them
    run = bare & np.convolve(np.convolve(bare, np.ones(3), "full") >= 3, np.ones(3), "full")[2:-2].astype(bool)
    menu = run | bare & (np.array([x[3] for x in lines]) > 1)
    ratio = free / np.maximum(tags, 1)
    content = content_lines(ratio)
    mass, titles = _below(parent, at, size * content), _below(parent, at, np.array([tag[e] == "h1" for e in at], np.float64))
    article = _handed_down(parent, [e if t in ("article", "main") and parser.mark[e] == 0 else 0 for e, t in enumerate(tag)])
    within = np.array([article[e] > 0 for e in at])
    in_articles = _below(parent, at, size * within)
    believed = [m == 2 or m == 1 and not titles[e] and (mass[e] < HALF * mass[0] or mass[0] == 0 or in_articles[0] > in_articles[e]) for e, m in enumerate(parser.mark)]
    out = _handed_down(parent, believed)
    kept = ~(np.array([out[e] for e in at]) | menu)
    if not kept.any():
        return ""
    content = content_lines(ratio * kept * np.where(within, 2.0, 1.0)) & kept
    whole = (size * content).sum()
    if whole and (size * content * within).sum() >= HALF * whole:
        region = within
    elif whole:
        title = np.array([tag[e] == "h1" for e in at])
        score = _below(parent, at, np.where(content | title, size, -size) * kept)
        best = max((e for e in range(len(tag)) if tag[e] in _CONTAINERS or e == 0), key=lambda e: (score[e], -e))
        region = np.array(_handed_down(parent, [e == best for e in range(len(tag))]))[at] | within
    else:
        region = kept
    return "\n\n".join(x[0] for x, k in zip(lines, kept & region, strict=True) if k)


def _texts(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(h) for h in pages], dtype=object)


def extracted(column: str = "html") -> Column:
    return F.pandas_udf(_texts, "string")(column)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` (replaced if there) and ``n_chars`` instead of ``html``."""
    return pages.withColumn("text", extracted("html")).drop("html").withColumn("n_chars", F.length("text").cast("long"))
