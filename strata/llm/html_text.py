"""Main text of HTML pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks at block-level tags. A block is described by its own words
and link density and by those of its neighbours, and by the regions it lies in, which tags and
names of classes tell. Regions decide first; within them words and links do. A small
decision tree, trained on the labelled table below, tells main text from the rest.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attributes: quotes count only after an equals sign, and only if they are closed.
ATTRS = r"(?>[^>\"'=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|title|select|object)(?![\w-]){ATTRS}(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>{ATTRS})(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Tags that begin or end a block.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul br button label".split()
)
#: Containers whose region is followed to their end.
CONTAINER = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header html main menu nav ol section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())
SIDE = frozenset("nav footer aside form menu dialog button label legend option".split())
CLASS = re.compile(
    r"""(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""",
    re.I,
)
#: Names of regions that are not main text, unless the words within an article tell otherwise.
HINT = re.compile(
    r"advert\w*|banner|sponsor\w*|promo\w*|sidebar|widgets?|nav\w*|menus?|breadcrumbs?|footer|notices?|alerts?|popup|modal|newsletter|subscri\w*|signup|login|search|share|sharing"
    r"|socials?|related|recommend\w*|copyright|disclaimer|contentinfo|complementary|toolbar|pagination|pager"
)
#: Names among them that leave no doubt, however long the text is.
NEVER = re.compile(r"ads?|adsense|adbox|adslot|adunit|advert\w*|sponsor\w*|comments?|commentlist|respond|disqus|cookies?|consent")
#: Names of page headers; within an article they name its own heading.
HEAD = re.compile(r"header|masthead|topbar")
#: Parts of a name that say what kind of element it is and not what it holds. A name is judged by the last other part:
#: comment-list holds comments, comments-open, related-work and search-page do not hold what they begin with.
KIND = frozenset(
    "area articles bar block body bottom box button buttons card cards col column container content form group icon icons inner item items label left link links list module message"
    " outer overlay panel post posts reading region right root row section slot sticky stories strip text thread title toggle top unit view widget wrap wrapper zone".split()
)
#: Parts that say what a name is not, or only that it goes with it.
WITHOUT = frozenset("has with no not is without hide show".split())
WORDS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
#: Names of elements that hold the article of a page.
BODY = re.compile(r"(?:^|\s)(?:main|articleBody|(?:article|entry|post|story)[_-](?:body|content|text))(?:$|\s)", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)", re.I)
UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WHITE = re.compile(r"\s+")


@lru_cache(maxsize=1 << 14)
def _named(names: str) -> tuple[bool, bool, bool]:
    """Whether any of the names in an attribute tells a region by HINT, NEVER or HEAD."""
    found = [False] * 3
    for name in names.split():
        parts = [x.lower() for x in WORDS.split(name) if x]
        while len(parts) > 1 and (parts[-1] in KIND or parts[-1].isdigit()):
            parts.pop()
        if parts and not WITHOUT.intersection(parts[:-1]):
            found = [x or bool(p.fullmatch(parts[-1])) for x, p in zip(found, (HINT, NEVER, HEAD), strict=True)]
    return tuple(found)


@dataclass(frozen=True)
class Place:
    """Where a block is. What lies around an article never decides about it while the page has no other one."""

    side: bool = False  # within a region that is not main text for certain, or not shown
    hint: bool = False  # within an element whose class or id names such a region
    main: bool = False  # within an article
    around: bool = False  # the article is within such an element or region, or has such a name itself
    never: bool = False  # within advertisements, comments, or what is hidden

    def within(self, tag: str, attrs: str) -> Place:
        """The place inside a container."""
        named = " ".join("".join(x) for x in CLASS.findall(attrs))
        whole = tag in ("html", "body")
        hint, never, head = (False,) * 3 if whole else _named(named)
        main = self.main or tag in MAIN or (tag in CONTAINER and not whole and bool(BODY.search(named)))
        never = self.never or never or bool(HIDDEN.search(QUOTED.sub("", attrs)) or UNSHOWN.search(attrs))
        hint = self.hint or hint or (head and not main)
        side = self.side or tag in SIDE or (tag == "header" and not main)
        if main and not self.main:
            return Place(False, False, True, side or hint, never)
        return Place(side, hint, main, self.around, never)


@dataclass
class Block:
    text: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    place: Place = Place()


def blocks(page: str) -> Iterator[tuple[str, float, int, Block]]:
    """(text, link density, words, block) of each block with text, in page order."""
    stack: list[tuple[str, Place]] = []
    open_ = Counter()  # of each container in the stack
    now, link, at = Block(), False, 0

    def finish() -> Iterator[tuple[str, float, int, Block]]:
        text = WHITE.sub(" ", html.unescape("".join(now.text))).strip()
        if text:
            n = len(text.split())
            yield text, min(1.0, len(html.unescape("".join(now.linked)).split()) / max(1, n)), n, now

    def add(s: str) -> None:
        if s:
            now.text.append(s)
            if link:
                now.linked.append(s)

    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if m["raw"]:
            continue
        tag = (m["tag"] or "").lower()
        if tag == "a":
            link = not m["end"]
            continue
        if tag not in BLOCK:
            continue
        yield from finish()
        link = False
        if tag in CONTAINER or tag in SIDE:
            if not m["end"]:
                stack.append((tag, (stack[-1][1] if stack else Place()).within(tag, m["attrs"] or "")))
                open_[tag] += 1
            elif open_[tag]:
                ended = None
                while ended != tag:
                    ended = stack.pop()[0]
                    open_[ended] -= 1
        now = Block([], [], stack[-1][1] if stack else Place())
    add(page[at:])
    yield from finish()


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "side", "hint", "main", "page_main")

#: Words and links of the blocks before and after a block: running text, links, text on one side only, nothing.
PROSE = ((40, 0.0, 60, 0.0), (90, 0.05, 25, 0.1), (30, 0.2, 140, 0.0))
LINKS = ((2, 1.0, 2, 1.0), (6, 0.9, 5, 0.8), (1, 1.0, 3, 1.0))
ENDS = ((2, 1.0, 55, 0.0), (0, 0.0, 70, 0.0), (65, 0.0, 0, 0.0), (80, 0.1, 4, 1.0))
SHORT = ((1, 0.0, 1, 0.0), (3, 0.0, 8, 0.0), (12, 0.1, 2, 0.0), (0, 0.0, 0, 0.0))

#: Words and links of a block: a paragraph, a heading or a short line, a line that is a link or mostly links.
LONG = ((35, 0.1), (60, 0.0), (90, 0.05), (200, 0.02), (45, 0.2))
LINE = ((1, 0.0), (3, 0.0), (8, 0.0), (14, 0.0), (20, 0.1), (6, 0.33))
LINKED = ((1, 1.0), (4, 0.6), (12, 1.0), (7, 0.8), (40, 0.9), (90, 0.7))


def _rows(own: tuple, around: tuple, side: int, hint: int, main: int, page_main: int, label: int) -> list[tuple]:
    return [(*x, *y, side, hint, main, page_main, label) for x in own for y in around]


ANY = PROSE + LINKS + ENDS + SHORT
#: Labelled blocks: the features in the order above, then whether the block is main text.
TABLE = (
    # the article: all that is not links, links within prose, but no lists of links
    *_rows(LONG + LINE, ANY, 0, 0, 1, 1, 1), *_rows(LINKED, PROSE + ENDS + SHORT, 0, 0, 1, 1, 1), *_rows(LINKED, LINKS, 0, 0, 1, 1, 0),
    # sections of it with the name of something else: long text among long text belongs to it, the rest are notices, shares, related pages
    *_rows(LONG, PROSE, 0, 1, 1, 1, 1), *_rows(LONG, LINKS + ENDS + SHORT, 0, 1, 1, 1, 0), *_rows(LINE + LINKED, ANY, 0, 1, 1, 1, 0),
    # forms, menus and asides in it, and whatever is outside it
    *_rows(LONG + LINE + LINKED, ANY, 1, 0, 1, 1, 0), *_rows(LONG + LINE + LINKED, ANY, 1, 1, 1, 1, 0), *_rows(LONG + LINE + LINKED, ANY, 0, 0, 0, 1, 0),
    *_rows(LONG + LINE + LINKED, ANY, 0, 1, 0, 1, 0), *_rows(LONG + LINE + LINKED, ANY, 1, 0, 0, 1, 0),
    # pages without an article: text, headings and lines beside text; lines among links are labels of menus
    *_rows(LONG, ANY, 0, 0, 0, 0, 1), *_rows(LINE, PROSE + ENDS + SHORT, 0, 0, 0, 0, 1), *_rows(LINE, LINKS, 0, 0, 0, 0, 0), *_rows(LINKED, ANY, 0, 0, 0, 0, 0),
    # regions of such pages that are not main text, comments in article elements of their own included
    *_rows(LONG + LINE + LINKED, ANY, 1, 0, 0, 0, 0), *_rows(LONG + LINE + LINKED, ANY, 0, 1, 0, 0, 0), *_rows(LONG + LINE + LINKED, ANY, 0, 1, 1, 0, 0),
    *_rows(LONG + LINE + LINKED, ANY, 1, 1, 1, 0, 0), *_rows(LONG + LINE + LINKED, ANY, 1, 0, 1, 0, 0),
)


@dataclass(frozen=True)
class Node:
    feature: int = -1
    at: float = 0.0
    below: Node | bool = False
    above: Node | bool = False


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8) -> Node | bool:
    """A classification tree by Gini impurity; ties go to the first feature and the lowest cut."""
    if not depth or len(set(labels.tolist())) < 2:
        return bool(2 * labels.sum() >= len(labels))
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] < cut
            gini = sum(len(y) * (p := y.mean()) * (1 - p) for y in (labels[low], labels[~low]))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, cut)
    if best is None:
        return bool(2 * labels.sum() >= len(labels))
    _, f, cut = best
    low = rows[:, f] < cut
    return Node(f, float(cut), grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1))


@lru_cache(maxsize=1)
def tree() -> Node | bool:
    table = np.array(TABLE, float)
    return grow(table[:, :-1], table[:, -1])


def classify(node: Node | bool, row: tuple) -> bool:
    while isinstance(node, Node):
        node = node.below if row[node.feature] < node.at else node.above
    return node


def main_text(page: str | None) -> str:
    """The blocks of main text, joined by line ends; empty for a page without any."""
    found = list(blocks(page or ""))
    clean = any(b.place.main and not (b.place.side or b.place.hint or b.place.around or b.place.never) for *_, b in found)
    places = [(p.side or p.never or (clean and p.around), p.hint, p.main) for p in (b.place for *_, b in found)]
    has_main = any(main and not (side or hint) for side, hint, main in places)
    nothing = ("", 0.0, 0, None)
    out = []
    for i, (text, links, n, _) in enumerate(found):
        before, after = found[i - 1] if i else nothing, found[i + 1] if i + 1 < len(found) else nothing
        if classify(tree(), (n, links, before[2], before[1], after[2], after[1], *places[i], has_main)):
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``; null and empty pages give empty texts.

    Repeated rows come back as often as they occur, an empty table gives an empty one, other columns
    are left out, and a page is read whole, however long or deep it is.
    """
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            lengths = pa.array(list(map(len, texts)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), lengths], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
