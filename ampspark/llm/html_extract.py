"""Main text of a web page, by text-to-tag ratios over streaming parser events.

The standard library's parser streams events; block-level tags end a line, and every line knows
the container element it is in.  What is never text of the article is left out at once: head, scripts,
styles, menus, headers, footers, sidebars, forms, and containers whose class or id is one of ``NAMES``
(adverts, notices, reader comments and the like; whole names of container elements only).

1. Every line has a ratio of text to tags (link text counts against it), smoothed with a
   Gaussian over its neighbours.
2. Threshold clustering: two means over the logarithms of the smoothed ratios part the lines into
   dense and thin ones.
3. A container's worth is its characters in dense lines less those in thin ones, with half of the dense ones
   once more for an article or main element.  The worthiest container is the content region (among equals
   the innermost, then the first).
4. An article or main element is taken whole.  Of another container, the lines from the first
   dense line (with headings right before it) to the last one.

White space inside a line is one space, lines are trimmed and joined by one space in
page order; character references are decoded.  A null or empty page, or one without
dense lines, gives the empty text.  Rows that repeat a page each get it; an empty table
gives no rows; columns other than page_id, url and html are neither read nor returned.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = frozenset(
    "address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style noscript template svg iframe object nav footer aside form button select textarea dialog menu".split())
NAMES = frozenset(
    "ad ads advert advertisement sponsored promo banner nav navbar menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies cookie-notice cookie-banner consent gdpr notice "
    "newsletter subscribe popup modal share sharing social related recommended comment comments comment-list comments-area disqus_thread replies respond widget pagination pager".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CONTENT = frozenset(["article", "main"])
CONTAINERS = CONTENT | {"body", "div", "section", "td", "ul", "ol", "dl", "table"}
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
SIGMA = 1.0
BONUS = 0.5


class Lines(HTMLParser):
    """The page's lines: [text parts, tags, link characters, container, heading]; containers: [parent, is article or main]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.containers: list[tuple[int, bool]] = [(-1, False)]
        self.lines: list[list] = [[[], 0, 0, 0, False]]
        self.stack: list[tuple[str, bool, int]] = []
        self.open: Counter[str] = Counter()
        self.dropped = 0
        self.at = 0
        self.inside = 0

    def _break(self) -> None:
        if self.lines[-1][0] or self.lines[-1][3] != self.at:
            self.lines.append([[], 0, 0, self.at, False])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._break()
        self.lines[-1][1] += 1
        if tag in VOID:
            return
        if tag == "p":  # an open paragraph ends where the next begins
            self._close("p", stop=CONTAINERS | DROPPED | {"li", "blockquote"})
        given = dict(attrs)
        named = tag in CONTAINERS and tag not in CONTENT and any(n in NAMES for k in ("class", "id") for n in (given.get(k) or "").lower().split())
        page_header = tag == "header" and not self.inside
        drop = tag in DROPPED or page_header or named or (given.get("role") or "").lower() in ROLES or "hidden" in given or (given.get("aria-hidden") or "") == "true"
        self.stack.append((tag, drop, self.at))
        self.open[tag] += 1
        self.dropped += drop
        if tag in CONTAINERS and not self.dropped:
            self.containers.append((self.at, tag in CONTENT))
            self.at = len(self.containers) - 1
            self.inside += tag in CONTENT
            self._break()

    def _close(self, tag: str, stop: frozenset = frozenset()) -> None:
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                for name, drop, at in reversed(self.stack[i:]):
                    self.inside -= name in CONTENT and at != self.at
                    self.dropped -= drop
                    self.open[name] -= 1
                    self.at = at
                del self.stack[i:]
                return
            if self.stack[i][0] in stop:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._break()
        self.lines[-1][1] += 1
        self._close(tag)
        if tag in BLOCKS:
            self._break()

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            if self.lines[-1][3] != self.at:
                self._break()
            line = self.lines[-1]
            line[0].append(data)
            if self.open["a"]:
                line[2] += len(data.strip())
            line[4] = line[4] or any(self.open[h] for h in HEADINGS)


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian means over the neighbours within three sigma."""
    reach = math.ceil(3 * sigma)
    weights = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        low, high = max(0, i - reach), min(len(ratios), i + reach + 1)
        near = weights[low - i + reach : high - i + reach]
        out.append(sum(map(float.__mul__, near, ratios[low:high])) / sum(near))
    return out


def dense_lines(ratios: list[float]) -> list[bool]:
    """Two means over the logarithms of the smoothed ratios: whether a line is in the upper cluster; equal ones are."""
    values = [math.log1p(x) for x in smoothed(ratios)]
    low, high = min(values, default=0.0), max(values, default=0.0)
    if high - low < 1e-9:
        return [high > 0] * len(values)
    while True:
        cut = (low + high) / 2
        under, over = [v for v in values if v <= cut], [v for v in values if v > cut]
        new = sum(under) / len(under), sum(over) / len(over)
        if new == (low, high):
            return [v > cut for v in values]
        low, high = new


def content_lines(lines: list[tuple[str, int, int, int, bool]], containers: list[tuple[int, bool]]) -> list[str]:
    """The texts of the content region's lines, from (text, tags, link characters, container, heading)."""
    hit = dense_lines([float(max(0, len(t) - 2 * links)) / max(1, tags) for t, tags, links, _, _ in lines])
    if not any(hit):
        return []
    dense, thin = [0] * len(containers), [0] * len(containers)
    for (t, _, _, at, _), h in zip(lines, hit):
        (dense if h else thin)[at] += len(t)
    for c in range(len(containers) - 1, 0, -1):  # a parent comes before its children
        dense[containers[c][0]] += dense[c]
        thin[containers[c][0]] += thin[c]
    depth = [0] * len(containers)
    for c in range(1, len(containers)):
        depth[c] = depth[containers[c][0]] + 1
    best = max(range(len(containers)), key=lambda c: (dense[c] * (1 + BONUS * containers[c][1]) - thin[c], depth[c], -c))
    inside = [False] * len(containers)
    for c in range(len(containers)):
        inside[c] = c == best or c > best and inside[containers[c][0]]
    own = [i for i, line in enumerate(lines) if inside[line[3]]]
    if not containers[best][1]:
        ends = [k for k, i in enumerate(own) if hit[i]]
        first = ends[0]
        while first and lines[own[first - 1]][4]:
            first -= 1
        own = own[first : ends[-1] + 1]
    return [lines[i][0] for i in own]


def extract(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = [(" ".join("".join(parts).split()), tags, links, at, heading) for parts, tags, links, at, heading in parser.lines]
    return " ".join(content_lines([x for x in lines if x[0]], parser.containers))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; one row per page."""

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(h) for h in batch], dtype=object)

    rows = pages.select("page_id", "url", main_text(F.col("html").cast("string")).alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
