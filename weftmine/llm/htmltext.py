"""HTML extraction: flat text blocks, classified by word counts and link densities of a block and its neighbours.

A page is cut into its blocks in order. A decision tree, grown from a small labelled table, asks for words and link densities of a block,
the one before and the one after first. Only in what that leaves open it asks for hints of the markup: whether the block is a
heading, where it stands to an article, whether it lies in an element for other things, or in one named so. A hint holds only as far as words bear it
out: an article must hold a good part of the page's plain words, and an element with most of them, or with the article, is not shunned for its name.

Defined results: a null or empty page, and one without main text, has the empty text; damaged markup is read as far as it
goes; an empty table gives no rows; repeated rows each get their own; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftmine.llm.arrow import slices

# Element names of HTML, and words of class names and ids that mark what is not main text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("html body caption dd dt li legend summary tbody td tfoot th thead tr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("audio button canvas head iframe noscript object script select style svg template textarea title video".split())
SHUNNED = frozenset("aside dialog footer menu nav".split())
SHUNNED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu navigation search".split())
SHUNNED_WORDS = frozenset(
    "ad ads adv advert advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
#: Parts that make a class name or id tell of another element, or of whether there is one.
LEADING = frozenset("has is no not show with without".split())
TRAILING = frozenset("allowed closed disabled enabled off on open".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    heading: bool
    article: bool
    shunned: bool  # in an element for something other than main text
    named: bool  # in one whose class name or id says so


def shuns(names: str) -> bool:
    """Whether one of the class names or ids has a word that marks what is not main text."""
    parts = [[w for w in re.split(r"[^a-z0-9]+", name) if w] for name in names.split()]
    return any(not SHUNNED_WORDS.isdisjoint(p) and p[0] not in LEADING and p[-1] not in TRAILING for p in parts)


class _Open(NamedTuple):
    tag: str
    silent: bool
    shunned: bool
    article: bool
    link: bool
    heading: bool
    named: int = 0  # the innermost element around that a class name or id shuns, by its number in ``around``


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.parts: list[tuple[str, bool]] = []
        self.open = [_Open("", False, False, False, False, False)]
        self.state = self.open[0]
        self.named: list[int] = []  # of each block
        self.around = [0]  # of each shunned element, the next such one around it; 0 is none
        self.freed, self.main = set(), False

    def _within(self, named: int) -> int:
        self.around.append(named)
        return len(self.around) - 1

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(t for t, _ in self.parts).split())
        if text:
            linked = sum(len(t.split()) for t, link in self.parts if link)
            s = self.state
            self.blocks.append(Block(text, len(text.split()), linked, s.heading, s.article, s.shunned, bool(s.named)))
            self.named.append(s.named)
        self.parts = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.flush()
            if tag in CLOSES_P:
                self._close("p")
            elif tag in ("li", "dd", "dt", "tr", "td", "th"):
                self._close(tag, within=("ul", "ol", "menu", "dl", "table") if tag not in ("td", "th") else ("tr", "table"))
            elif tag == "body":
                self._close("head")
        elif tag == "br":
            self.parts.append((" ", False))
        if tag in VOID:
            return
        s = self.state
        shunned, article, named = s.shunned, s.article, s.named
        if tag == "form":
            named = self._within(named)
        if not shunned:
            shunned = tag in SHUNNED or tag == "header" and not article
            for name, value in attrs:
                value = (value or "").lower()
                if name in ("class", "id") and tag not in ("html", "body", "main"):
                    if shuns(value) and not (article and tag in HEADINGS | {"header"}) and not (name == "id" and tag in HEADINGS | {"section"}):
                        named = self._within(named)
                elif name == "role":
                    shunned |= value in SHUNNED_ROLES
                    article |= value == "main"
                elif name == "itemprop":
                    article |= value == "articlebody"
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                    shunned = True
        article |= tag in ("article", "main")
        if article and not s.article and not shunned and named == s.named and not self.main:
            # What holds the page's first article is not shunned for its name.
            self.main = True
            while named and named not in self.freed:
                self.freed.add(named)
                named = self.around[named]
            named = s.named
        self.state = _Open(tag, s.silent or tag in SILENT, shunned, article and not shunned, s.link or tag == "a", tag in HEADINGS or s.heading, named)
        self.open.append(self.state)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID or tag in BLOCK:
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)

    def _close(self, tag: str, within: Sequence[str] = ()) -> bool:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                self.state = self.open[-1]
                return True
            if self.open[i].tag in within or tag == "p" and self.open[i].tag in ("div", "td", "li", "article", "section", "body"):
                return False
        return False

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if tag not in VOID:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self.state.silent:
            self.parts.append((data, self.state.link))

    def judged(self) -> list[Block]:
        """The blocks, those in elements shunned for their names among them, unless such an element holds the article or, on a page without, most words."""
        n = len(self.around)
        if not self.main:
            held = [0] * n
            for b, named in zip(self.blocks, self.named, strict=True):
                held[named] += b.words
            total = sum(held)
            for e in range(n - 1, 0, -1):  # an element comes after all around it
                held[self.around[e]] += held[e]
            self.freed.update(e for e in range(1, n) if 2 * held[e] > total)
        free = [True] * n
        for e in range(1, n):
            free[e] = e in self.freed and free[self.around[e]]
        return [b._replace(named=not free[named], article=b.article and free[named]) for b, named in zip(self.blocks, self.named, strict=True)]


def blocks(html: str) -> list[Block]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.judged()


#: The part of a page's plain words that its articles must hold.
BELIEVED = 0.25
FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "heading", "place", "shunned", "named")
#: Of these, the ones of words and links: block, the one before, the one after.
TEXT = 6


def features(found: Sequence[Block]) -> np.ndarray:
    """A row for each block, by FEATURES. Its place is 1 in an article, -1 beside one, 0 in a page without."""
    words = np.array([0, *(b.words for b in found), 0], float)
    density = np.array([0, *(b.linked / b.words for b in found), 0], float)
    plain = np.array([0 if b.shunned or b.named else b.words - b.linked for b in found])
    inside = np.array([b.article for b in found], bool)
    page = bool(inside.any() and plain[inside].sum() >= BELIEVED * plain.sum())
    hints = np.array([(b.heading, 0 if not page else 1 if b.article else -1, b.shunned, b.named) for b in found], float).reshape(len(found), 4)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], hints])


#: Where a block may stand, as (place, shunned, named): in an article, on a page without one, beside one, in a shunned element, in one named so (beside an article and without).
STANDS = ((1, 0, 0), (0, 0, 0), (-1, 0, 0), (-1, 1, 0), (0, 1, 0), (1, 1, 0), (-1, 0, 1), (0, 0, 1), (1, 0, 1))
#: A small labelled table: words and density of a block, of the one before and of the one after, whether it is a heading; and whether it is main
#: text in an article, on a page without one, and beside one. In shunned or named elements none of these is.
LABELLED = [
    # Prose in a run of prose.
    (120, 0.00, 60, 0.00, 80, 0.00, 0, 1, 1, 1), (60, 0.05, 45, 0.00, 70, 0.00, 0, 1, 1, 1), (35, 0.00, 50, 0.00, 40, 0.00, 0, 1, 1, 1), (28, 0.00, 30, 0.00, 26, 0.10, 0, 1, 1, 1),
    (400, 0.02, 90, 0.00, 30, 0.00, 0, 1, 1, 1), (75, 0.20, 60, 0.10, 45, 0.00, 0, 1, 1, 1), (45, 0.30, 28, 0.00, 55, 0.05, 0, 1, 1, 1), (30, 0.00, 200, 0.00, 35, 0.00, 0, 1, 1, 1),
    # Prose at an end of a run, or alone.
    (150, 0.00, 1, 1.00, 60, 0.00, 0, 1, 1, 0), (45, 0.00, 8, 0.00, 50, 0.00, 0, 1, 1, 0), (60, 0.00, 70, 0.00, 0, 0.00, 0, 1, 1, 0), (400, 0.02, 9, 0.00, 0, 0.00, 0, 1, 1, 0),
    (90, 0.10, 8, 0.00, 14, 0.00, 0, 1, 1, 0), (35, 0.00, 50, 0.00, 2, 0.00, 0, 1, 1, 0), (75, 0.00, 60, 0.00, 1, 1.00, 0, 1, 1, 0), (22, 0.00, 1, 1.00, 1, 1.00, 0, 1, 1, 0),
    (200, 0.05, 2, 1.00, 5, 0.80, 0, 1, 1, 0), (16, 0.00, 0, 0.00, 0, 0.00, 0, 1, 1, 0), (28, 0.00, 1, 1.00, 12, 0.00, 0, 1, 1, 0), (14, 0.00, 1, 1.00, 60, 0.00, 0, 1, 1, 0),
    # Short lines among or beside prose.
    (2, 0.00, 80, 0.00, 45, 0.00, 0, 1, 1, 0), (1, 0.00, 60, 0.00, 50, 0.00, 0, 1, 1, 0), (18, 0.00, 50, 0.00, 45, 0.00, 0, 1, 1, 0), (12, 0.00, 30, 0.00, 28, 0.00, 0, 1, 1, 0),
    (5, 0.00, 70, 0.00, 18, 0.00, 0, 1, 1, 0), (3, 0.00, 14, 0.00, 40, 0.00, 0, 1, 1, 0), (8, 0.00, 40, 0.00, 0, 0.00, 0, 1, 1, 0), (4, 0.00, 90, 0.00, 12, 0.00, 0, 1, 1, 0),
    (12, 0.25, 30, 0.00, 35, 0.00, 0, 1, 1, 0), (9, 0.00, 16, 0.00, 20, 0.00, 0, 1, 1, 0), (1, 0.00, 20, 0.00, 12, 0.00, 0, 1, 1, 0), (4, 0.00, 30, 0.00, 5, 1.00, 0, 1, 1, 0),
    # Short lines among short lines, and scraps among links.
    (2, 0.00, 1, 0.00, 3, 0.00, 0, 1, 1, 0), (1, 0.00, 0, 0.00, 1, 0.00, 0, 1, 1, 0), (3, 0.00, 6, 0.00, 3, 0.00, 0, 1, 1, 0), (5, 0.00, 4, 0.00, 12, 0.00, 0, 1, 1, 0),
    (6, 0.00, 4, 0.00, 19, 0.00, 1, 1, 1, 0), (2, 0.00, 4, 0.00, 2, 0.00, 1, 1, 1, 0), (1, 0.00, 5, 0.00, 3, 0.00, 0, 1, 1, 0), (6, 0.00, 3, 0.00, 0, 0.00, 0, 1, 1, 0),
    (3, 0.00, 5, 1.00, 8, 0.00, 0, 1, 0, 0), (4, 0.00, 3, 1.00, 2, 1.00, 0, 1, 0, 0),
    (5, 0.00, 2, 1.00, 0, 0.00, 0, 1, 0, 0), (2, 0.00, 0, 0.00, 1, 1.00, 0, 1, 0, 0), (7, 0.00, 0, 0.00, 0, 0.00, 0, 1, 1, 0), (10, 0.00, 1, 1.00, 9, 0.00, 0, 1, 0, 0),
    # Headings before or in prose, and over links.
    (3, 0.00, 1, 1.00, 75, 0.00, 1, 1, 1, 0), (5, 0.00, 2, 1.00, 33, 0.00, 1, 1, 1, 0), (6, 0.00, 1, 1.00, 90, 0.00, 1, 1, 1, 0), (4, 0.00, 1, 1.00, 48, 0.00, 0, 1, 1, 0),
    (10, 0.00, 1, 1.00, 60, 0.00, 1, 1, 1, 0), (6, 0.00, 12, 0.00, 90, 0.00, 1, 1, 1, 0), (4, 0.00, 55, 0.00, 70, 0.00, 1, 1, 1, 0), (3, 0.00, 0, 0.00, 40, 0.00, 1, 1, 1, 0),
    (22, 0.00, 15, 0.00, 30, 0.00, 1, 1, 1, 0), (7, 0.00, 10, 0.00, 25, 0.00, 1, 1, 1, 0), (3, 0.00, 1, 1.00, 2, 1.00, 1, 1, 0, 0), (9, 0.00, 1, 1.00, 4, 0.00, 1, 1, 1, 0),
    # A linked line within prose.
    (9, 1.00, 40, 0.00, 35, 0.00, 0, 1, 1, 0), (4, 1.00, 70, 0.00, 60, 0.05, 0, 1, 1, 0), (30, 0.60, 25, 0.00, 45, 0.00, 0, 1, 1, 0), (2, 1.00, 45, 0.00, 30, 0.00, 0, 1, 1, 0),
    (6, 1.00, 28, 0.00, 90, 0.00, 1, 1, 1, 0), (12, 0.80, 33, 0.10, 50, 0.00, 0, 1, 1, 0), (1, 1.00, 26, 0.00, 28, 0.00, 0, 1, 1, 0), (8, 1.00, 12, 0.00, 14, 0.00, 0, 1, 0, 0),
    # Link lists.
    (1, 1.00, 0, 0.00, 1, 1.00, 0, 0, 0, 0), (1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 0, 0), (2, 1.00, 1, 1.00, 9, 0.00, 0, 0, 0, 0), (2, 1.00, 3, 1.00, 2, 1.00, 0, 0, 0, 0),
    (3, 1.00, 60, 0.00, 2, 1.00, 0, 0, 0, 0), (2, 1.00, 2, 1.00, 0, 0.00, 0, 0, 0, 0), (5, 1.00, 4, 1.00, 6, 1.00, 0, 0, 0, 0), (30, 0.80, 25, 0.90, 12, 0.70, 0, 0, 0, 0),
    (8, 0.90, 40, 0.00, 6, 1.00, 0, 0, 0, 0), (10, 1.00, 6, 1.00, 50, 0.00, 0, 0, 0, 0), (15, 0.55, 1, 1.00, 14, 0.60, 0, 0, 0, 0), (40, 0.70, 3, 1.00, 2, 1.00, 0, 0, 0, 0),
    (1, 1.00, 1, 1.00, 70, 0.00, 0, 0, 0, 0), (7, 1.00, 0, 0.00, 5, 1.00, 1, 0, 0, 0), (6, 0.60, 5, 1.00, 0, 0.00, 0, 0, 0, 0), (1, 1.00, 1, 1.00, 12, 0.00, 0, 0, 0, 0),
]


def examples(rows: Sequence[tuple] = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels: each row of the table at each place where a block may stand."""
    table = [(*row[:7], *stands, stands[1:] == (0, 0) and row[8 - stands[0]]) for row in rows for stands in STANDS]
    out = np.array(table, float)
    return out[:, :-1], out[:, -1]


class Split(NamedTuple):
    feature: int
    at: float
    below: Split | float
    above: Split | float


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, text: int = 4) -> Split | float:
    """A decision tree by Gini impurity; a leaf is the share of main text in it. Of equally good splits the first holds.

    The first ``text`` storeys ask for words and links alone, further ones for them and for hints.
    """
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(TEXT if text > 0 else x.shape[1]):
        values = np.unique(x[:, f])
        for at in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < at
            impurity = sum(s.sum() * (p := y[s].mean()) * (1 - p) for s in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, float(at), low
    if best is None:
        return grow(x, y, depth, 0) if text > 0 else share
    _, f, at, low = best
    return Split(f, at, grow(x[low], y[low], depth - 1, text - 1), grow(x[~low], y[~low], depth - 1, text - 1))


def learned(rows: Sequence[tuple] = LABELLED) -> Split | float:
    return grow(*examples(rows))


def shares(tree: Split | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, Split):
        return np.full(len(x), tree)
    return np.where(x[:, tree.feature] < tree.at, shares(tree.below, x), shares(tree.above, x))


def main_text(html: str | None, tree: Split | float) -> str:
    found = blocks(html or "")
    if not found:
        return ""
    return "\n\n".join(b.text for b, share in zip(found, shares(tree, features(found)), strict=True) if share >= 0.5)


def extract(pages: DataFrame, tree: Split | float | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    tree = learned() if tree is None else tree

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(h.as_py(), tree) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(rows, "page_id long, url string, text string, n_chars long")
