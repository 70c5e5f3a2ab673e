"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The page streams through the standard library's parser. Block elements and line breaks end a line; a line keeps its
text, the number of tags in it and whether it stands in a part of the page that is no article (by element, by role, or
by the words of its class and id). The ratio of text to tags, smoothed with a Gaussian along the page, is compared with a
threshold between the clusters of high and low ratios; a heading or a short line goes with its neighbours by the
smoothing. Lines outside the article are smoothed for themselves and never content, but they are part of the clusters:
menus and footers are what low ratios look like. Where the page marks an article (article, main, or a class or id that
says so), the mark is a prior: the odds of marked against other text multiply the ratios of marked lines and divide those
of others. A mark on less than half of the text says nothing. Lines of links are content only alone, in a marked part, and
with a high ratio around them. Inside an article the words of a class or id that speak against it put its block to the
clusters as a whole, without the prior; a block for readers' comments is out, unless it holds most of the text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder semantics a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is never text of the article.
SKIPPED = frozenset("script style noscript template svg iframe object canvas video audio map head title textarea select option button".split())
OUTSIDE = frozenset("nav header footer aside form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ARTICLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that leave an open head open.
IN_HEAD = frozenset("head title style script noscript template meta link base".split())
#: Words in a class or id, between hyphens, underscores, blanks and case changes.
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related "
    "recommended popular share sharing social comment comments respond reply replies disqus discussion cookie cookies consent notice notification alert popup modal newsletter subscribe subscription "
    "signup login pagination pager toolbar copyright disclaimer skip".split()
)
COMMENT_WORDS = frozenset("comment comments respond reply replies disqus".split())
ARTICLE_WORDS = frozenset("article post story entry content main".split())
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SIGMA = 1.5
#: Letters a tag from which a line counts as text alike, so that one huge paragraph does not set the clusters.
FULL_RATIO = 200.0
#: The most that a mark multiplies a line's ratio by.
MOST_ODDS = 16.0


class _Lines(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # tag, no text, outside, in an article, doubted block (below 0: readers' comments)
        self.stack: list[tuple[str, bool, bool, bool, int]] = []
        self.lines: list[tuple[str, int, int, bool, bool, int]] = []  # text, tags, letters in links, outside, in an article, doubted block
        self.text: list[str] = []
        self.tags = self.linked = self.links = self.blocks = 0

    def state(self) -> tuple[bool, bool, bool, int]:
        return self.stack[-1][1:] if self.stack else (False, False, False, 0)

    def close_head(self) -> None:
        if (k := next((k for k, x in enumerate(self.stack) if x[0] == "head"), None)) is not None:
            del self.stack[k:]

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text or self.tags:
            self.lines.append((text, self.tags, self.linked, *self.state()[1:]))
        self.text, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.flush()
        if tag == "body" or self.stack and self.stack[-1][0] == "head" and tag not in IN_HEAD:
            self.close_head()
        self.tags += 1
        if tag in VOID:
            return
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and (k := self._open({"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ("dt", "dd")))) is not None:
            del self.stack[k:]  # the element before it was not closed
        silent, outside, article, doubted = self.state()
        names = dict(attrs)
        silent = silent or tag in SKIPPED or "hidden" in names or "display:none" in (names.get("style") or "").replace(" ", "").lower()
        words = {w.lower() for w in _WORDS.findall(f"{names.get('class') or ''} {names.get('id') or ''}")} if len(names) else set()
        marked = tag in ARTICLE or names.get("role") in ("main", "article") or bool(words & ARTICLE_WORDS)
        against = words & OUTSIDE_WORDS if tag not in ("html", "body", "article", "main") and tag not in INLINE and tag not in HEADINGS else set()
        if tag in OUTSIDE or names.get("role") in ROLES or (against and not article):
            # A comment is often an article of its own, inside the part for comments; a heading's block is the article's.
            outside = outside or not (tag == "header" and article)
        elif against - {"header"} and not doubted:
            self.blocks += 1
            doubted = -self.blocks if against & COMMENT_WORDS else self.blocks
        self.links += tag == "a"
        self.stack.append((tag, silent, outside, article or marked and not outside, doubted))

    def _open(self, tags: tuple[str, ...]) -> int | None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                return k
            if self.stack[k][0] in ("ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "nav", "aside", "footer", "header", "form", "blockquote"):
                return None
        return None

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        self.tags += 1
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.links -= sum(x[0] == "a" for x in self.stack[k:])
                del self.stack[k:]
                return
            if tag in INLINE and self.stack[k][0] not in INLINE:
                return

    def parse_html_declaration(self, i: int) -> int:
        """A declaration that is none, as <![if x>, is a comment up to the next >; nothing behind it is lost."""
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self.close_head()
        if not self.state()[0]:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())


def smooth(x: list[float], sigma: float = SIGMA) -> list[float]:
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(x)):
        total = weight = 0.0
        for k, w in enumerate(kernel, i - reach):
            if 0 <= k < len(x):
                total, weight = total + w * x[k], weight + w
        out.append(total / weight)
    return out


def threshold(x: list[float]) -> float:
    """Between the two clusters of ratios (two means, by iteration); 0 where there is one cluster."""
    if not x or max(x) <= 0:
        return 0.0
    low, high = min(x), max(x)
    for _ in range(50):
        cut = (low + high) / 2
        a, b = [v for v in x if v <= cut], [v for v in x if v > cut]
        if not a or not b:
            return 0.0
        new = sum(a) / len(a), sum(b) / len(b)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2 if high > 3 * low else 0.0


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by one space; '' for null, empty or contentless pages."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return " ".join(x[0] for x, keep in zip(parser.lines, content(parser.lines), strict=True) if keep)


def prior(lines: list[tuple[str, int, int, bool, bool, int]]) -> float:
    """The odds that a letter of plain text stands in a marked part: from 1 to ``MOST_ODDS``."""
    marked, other = (sum(max(0, len(x[0]) - x[2]) for x in lines if x[4] == m) for m in (True, False))
    return min(MOST_ODDS, max(1.0, marked / other)) if other else MOST_ODDS if marked else 1.0


def ratio(line: tuple[str, int, int, bool, bool, int]) -> float:
    """Letters a tag, less the share of letters in links."""
    return min(FULL_RATIO, len(line[0]) / max(1, line[1])) * (1 - min(1.0, line[2] / len(line[0])))


def content(lines: list[tuple[str, int, int, bool, bool, int]]) -> list[bool]:
    """For each line of ``_Lines`` whether it is content."""
    out = [False] * len(lines)
    at = [k for k, x in enumerate(lines) if not x[3] and x[0]]
    rows = [lines[k] for k in at]
    ratios = [ratio(x) for x in rows]
    smoothed = smooth(ratios)
    cut, odds = threshold(smoothed + smooth([ratio(x) for x in lines if x[3] and x[0]])), prior(rows)
    linked = [False, *(x[2] >= 0.9 * len(x[0]) for x in rows), False]
    means: dict[int, tuple[float, int]] = {}  # of each doubted block and, at 0, of the rest: sum of ratios by letter, letters
    for x, r in zip(rows, ratios, strict=True):
        total, letters = means.get(x[5], (0.0, 0))
        means[x[5]] = total + r * len(x[0]), letters + len(x[0])
    mean = {block: total / letters for block, (total, letters) in means.items()}
    # Two thirds of the rest's ratio, where that is less than the cut: a block of the article's own kind stays.
    least = min(cut or math.inf, 2 / 3 * mean.get(0, 0.0))
    half = sum(letters for _, letters in means.values()) / 2
    for n, (k, x, r) in enumerate(zip(at, rows, smoothed, strict=True), 1):
        if linked[n]:
            out[k] = x[4] and not x[5] and r >= cut / odds and r > 0 and not linked[n - 1] and not linked[n + 1]
        elif x[5]:
            out[k] = mean[x[5]] >= least and (x[5] > 0 or means[x[5]][1] > half)
        elif cut > 0:
            out[k] = (r * odds if x[4] else r / odds) >= cut
        else:  # one cluster: the mark alone tells the lines apart
            out[k] = x[4] or odds == 1
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, size, texts = 0, 0, []
        for k, html in enumerate(batch.column(2)):
            texts.append(main_text(html.as_py()))
            size += len(texts[-1])
            if size > 8_000_000 or k == len(batch) - 1:
                ids, urls = batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])
                first, size, texts = k + 1, 0, []


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of ``pages`` (page_id, url, html).

    Null and empty pages give empty texts; pages cut off in the middle give what they have; repeated rows give repeated
    rows. Other columns are ignored; an empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
