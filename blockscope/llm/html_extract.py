"""Main text of HTML pages by line-block distribution.

Markup that is never article text is dropped, the rest becomes one line per block element.  The
text lengths of neighbouring lines are summed in a sliding window; text starts where the sum
surges and ends where it dives.  Link lists and lines of boilerplate blocks weigh nothing, so that
the curve falls to zero on them; lines in an article or main element weigh a little more than their
length.
"""

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines in a window, and the summed length at which text surges.
WINDOW = 3
SURGE = 40
#: What a line in an article or main element weighs besides its length: less than a surge.
INSIDE = SURGE // 2

# Elements by what they do to text.
SILENT = frozenset(
    "script style noscript template head title svg math iframe object canvas audio video map select "
    "option textarea button".split()
)
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p "
    "pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that name a part which is not the article.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad(?:s|box|slot|unit|vert\w*)?|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|disclaimer|notices?|alert|popup|modal|"
    r"newsletter|subscribe|nav\w*|menu|breadcrumbs?|side-?bar|footer|masthead|toolbar|share|social|"
    r"related|recommend\w*|comments?|commentlist|respond|disqus|repl(?:y|ies)|contentinfo|"
    r"complementary|search|login|signup|pagination|pager|widget\w*)(?:$|[\s_-])",
    re.IGNORECASE,
)
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies))(?:$|[\s_-])", re.IGNORECASE)
WHITE = re.compile(r"\s+")
_CUT_OFF = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?\Z")


@dataclass
class Line:
    text: str
    linked: int  # characters inside links
    boilerplate: bool
    inside: bool  # in an article or main element


class Lines(HTMLParser):
    """A page as lines, one for each stretch of text between block tags.

    Only elements of a kind are tracked, each with the number of its own tags open, so
    that left-out end tags of others do no harm.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[list] = []  # tag, kind, open tags of that name
        self.places: dict[str, list[int]] = {}  # where a tag's elements stand among the open ones
        self.count = dict.fromkeys(("silent", "boilerplate", "article", "main", "link"), 0)
        self.text: list[str] = []
        self.linked = 0

    def kind(self, tag: str, attrs: list) -> str | None:
        if tag in SILENT:
            return "silent"
        if tag in BOILERPLATE and not (tag == "header" and self.count["article"]):
            return "boilerplate"
        if any(k == "hidden" for k, _ in attrs):
            return "boilerplate"
        named = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        if named and tag not in ("html", "body", "main"):
            if (COMMENT if tag == "article" else NAMED).search(named):
                return "boilerplate"
        return {"article": "article", "main": "main", "a": "link"}.get(tag)

    def flush(self) -> None:
        text = WHITE.sub(" ", "".join(self.text)).strip()
        if text:
            inside = self.count["article"] + self.count["main"] > 0
            self.lines.append(Line(text, self.linked, self.count["boilerplate"] > 0, inside))
        self.text, self.linked = [], 0

    def close_from(self, at: int) -> None:
        for tag, kind, _ in self.open[at:]:
            self.count[kind] -= 1
            self.places[tag].pop()
        del self.open[at:]

    def nearest(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else -1

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            if self.open and self.open[-1][0] in ("p", "a", "head"):  # their end may be left out
                self.close_from(len(self.open) - 1)
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        kind = self.kind(tag, attrs)
        if kind:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append([tag, kind, 1])
            self.count[kind] += 1
        elif (at := self.nearest(tag)) >= 0:
            self.open[at][2] += 1

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        at = self.nearest(tag)
        if at >= 0:
            self.open[at][2] -= 1
            if not self.open[at][2]:
                self.close_from(at)

    def handle_data(self, data):
        if not self.count["silent"]:
            self.text.append(data)
            if self.count["link"]:
                self.linked += len(data.strip())


def lines_of(page: str) -> list[Line]:
    """The page's lines; a tag cut off at the page's end is markup."""
    parser = Lines()
    parser.feed(_CUT_OFF.sub("", page))
    parser.close()
    parser.flush()
    return parser.lines


def spans(weights: list[int], surge: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Ranges of lines from a surge to the next dive of the block lengths.

    The block of a line sums the window that starts there.  Text surges at a line of
    weight whose block reaches ``surge``, and dives where a block is zero; weightless
    lines at the end of a range are not in it.
    """
    n = len(weights)
    total = np.concatenate([[0], np.cumsum([*weights, *[0] * window])])
    block = total[window : window + n] - total[:n]
    found, at = [], 0
    while at < n:
        if block[at] < surge or not weights[at]:
            at += 1
            continue
        end = at
        while end < n and block[end] > 0:
            end += 1
        last = end
        while not weights[last - 1]:
            last -= 1
        found.append((at, last))
        at = end
    return found


def main_text(page: str | None) -> str:
    """The article of a page, one line per block; empty if there is none.

    Boilerplate inside an article or main element is markup and leaves the lines before the
    curve; elsewhere it stays as lines without weight, where the curve dives.  Text must surge
    to ``SURGE`` characters in a window.  A line in an article or main element weighs ``INSIDE`` more
    than its length, however linked, so that short lines surge with a neighbour; elsewhere lines that
    are mostly links weigh nothing.  Text outside such elements is found by its own length, whether
    the page has one or not.  If nothing surges, the lines in article or main elements
    are the text, or all lines of weight where there are none.
    """
    if not page:
        return ""
    lines = [x for x in lines_of(page) if not (x.boilerplate and x.inside)]
    weights = [
        0
        if x.boilerplate or (not x.inside and 2 * x.linked > len(x.text))
        else len(x.text) + INSIDE * x.inside
        for x in lines
    ]
    within = [w * x.inside for w, x in zip(weights, lines)]
    found = spans(weights, SURGE) or spans(within, 1) or spans(weights, 1)
    kept = [x for low, high in found for x in lines[low:high]]
    return "\n".join(x.text for x in kept if not x.boilerplate)


def main_text_of(page: Column) -> Column:
    """The article of a column of whole HTML pages; null and empty pages have an empty one."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return run(page)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: id, url, ``text``, ``n_chars`` (code points).  Repeated rows stay rows."""
    text = main_text_of(F.col(html_col))
    return pages.select(F.col(id_col), F.col(url_col), text.alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long")
    )
