"""Main text of web pages: flat text blocks, classified by a decision tree over a block and its neighbours.

A page is cut at its block-level tags into flat blocks. A block's features are its word count and link density, those of
the block before and after it, its place (inside navigation and the like, inside the article, neither) and its kind. The
tree is grown here, by Gini impurity, on the labelled blocks of `html_labels` and is the same on every run. Blocks that
it takes for main text are joined in page order by line feeds.

Character references are decoded as HTML5 says, white space inside a block becomes one space. Scripts, styles, comments
and form controls are no text at all; an element of this kind that is never closed reaches to the end of the page.

Defined cases: null and empty pages, and pages without main text, give an empty text; broken markup is read as far as it
goes, a tag that never ends is text; repeated rows give the same text; other columns pass through, but for one with
the result's name, which the result replaces.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columns import clear_of

#: HTML element names by their part in a page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset(
    "article aside body blockquote details dialog div dl fieldset figure footer form header li main menu nav ol search "
    "section span table td tr ul p".split()
)
SILENT_TAGS = frozenset(
    "script style noscript template iframe object svg math select textarea button canvas audio video head title "
    "datalist option label".split()
)
RAW_TAGS = frozenset("script style textarea title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTER_TAGS = frozenset("nav aside footer form menu dialog search".split())
#: Words in class, id and role that name a page's furniture.
FURNITURE = frozenset(
    "ad ads adv advert advertisement advertising adverts sponsor sponsored sponsor promo promoted promotion banner cookie "
    "cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "signin login comment comments commentlist respond reply replies discussion disqus reactions responses share sharing "
    "social related recommended recommendations teaser teasers trending popular pagination pager breadcrumb breadcrumbs "
    "navigation contentinfo complementary copyright legal disclaimer paywall feedback survey poll tags taglist".split()
)
LAYOUT = frozenset("sidebar side widget widgets nav navbar menu footer header masthead topbar toolbar search skip".split())
MAIN_WORDS = frozenset("article main content story post entry body".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
    re.DOTALL,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")

OUTSIDE, NEUTRAL, INSIDE = -1, 0, 1


@dataclass
class Block:
    text: str
    words: int
    linked: int
    place: int
    heading: bool
    listed: bool


def _names(attributes: str) -> set[str]:
    found: set[str] = set()
    for match in _NAMES.finditer(attributes):
        value = next((g for g in match.groups() if g), "")
        split = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
        found.update(_PART.findall(split))
    return found


def _mark(tag: str, attributes: str) -> str:
    """What a container says of what it holds: furniture, layout, main or nothing."""
    names = _names(attributes) if tag not in ("body", "html") and "=" in attributes else set()
    if tag in OUTER_TAGS or names & FURNITURE or "hidden" in attributes.lower().split():
        return "furniture"
    if tag == "header" or names & LAYOUT:
        return "layout"
    if tag in ("article", "main") or tag in ("div", "section") and names & MAIN_WORDS:
        return "main"
    return ""


def _place(stack: Sequence[tuple[str, str]]) -> int:
    """Furniture holds for all inside it; of layout and main marks the one closest to the article's core counts."""
    marks = [mark for _, mark in stack]
    if "furniture" in marks:
        return OUTSIDE
    if "main" in marks:
        # a header or side part inside the article's own body is part of neither menu nor page header
        inner = marks[marks.index("main") :]
        names = [tag for tag, mark in stack[marks.index("main") :] if mark == "layout"]
        return INSIDE if "layout" not in inner or all(n == "header" for n in names) else OUTSIDE
    return OUTSIDE if "layout" in marks else NEUTRAL


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    kind, text, linked = "", [], []
    in_link, skip_until, silent = False, -1, []

    def close() -> None:
        nonlocal text, linked
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                n = words.count(" ") + 1
                links = len(html.unescape("".join(linked)).split())
                listed = kind in ("li", "td", "th", "dt", "dd") or any(t in ("li", "td") for t, _ in stack)
                out.append(Block(words, n, min(links, n), _place(stack), kind[:1] == "h" and kind[1:].isdigit(), listed))
        text, linked = [], []

    def take(part: str) -> None:
        if part and not silent:
            text.append(part)
            linked.append(part if in_link else " ")

    at = 0
    for match in _TOKEN.finditer(page):
        if match.start() < skip_until:
            continue
        take(page[max(at, skip_until) : match.start()])
        at = match.end()
        tag = (match[2] or match[5] or "").lower()
        if not tag:
            continue
        ending = bool(match[1] or match[4])
        attributes = match[3] or match[6] or ""
        if tag in SILENT_TAGS:
            if ending:
                if tag in silent:
                    del silent[len(silent) - 1 - silent[::-1].index(tag) :]
            elif tag in RAW_TAGS:
                end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
                at = skip_until = end.end() if end else len(page)
                take(" ")
            elif not attributes.endswith("/"):
                silent.append(tag)
            if tag not in BLOCK_TAGS:
                take(" ")
                continue
        if tag in BLOCK_TAGS and tag not in ("head", "title") and not ending:
            if tag in ("body", "article", "main"):
                silent.clear()
            elif "head" in silent:
                silent.remove("head")
        if tag == "br":
            take(" ")
        elif tag == "a":
            in_link = not ending
        if tag in BLOCK_TAGS:
            close()
            if ending:
                in_link = False
            kind = "" if ending else tag
            if not ending:  # an open paragraph ends where a block begins, an item where the next one does
                while stack and (stack[-1][0] == "p" or tag == "li" and stack[-1][0] == "li"):
                    stack.pop()
        if tag in CONTAINERS and tag not in VOID_TAGS:
            if not ending:
                if not attributes.endswith("/"):
                    stack.append((tag, _mark(tag, attributes)))
            elif any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
    take(page[max(at, skip_until) :])
    close()
    return out


FEATURES = (
    "words", "density", "words_before", "density_before", "words_after", "density_after", "place", "heading", "listed",
)


def features(found: Sequence[Block]) -> np.ndarray:
    """(blocks, features); a page's ends count as blocks without words."""
    words = np.array([0, *[b.words for b in found], 0], float)
    density = np.array([0, *[b.linked / b.words for b in found], 0], float)
    own = np.array([(b.place, b.heading, b.listed) for b in found], float).reshape(-1, 3)
    flat = [words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:]]
    return np.column_stack([*flat, own])


@dataclass
class Node:
    share: float
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 3) -> Node:
    """A binary tree by Gini impurity; of equal splits the first feature and the smallest limit win."""
    node = Node(float(y.mean()))
    if depth == 0 or node.share in (0.0, 1.0) or len(y) < 2 * least:
        return node
    best = len(y) * 2 * node.share * (1 - node.share) - 1e-9
    for feature in range(x.shape[1]):
        order = np.argsort(x[:, feature], kind="stable")
        values, ones = x[order, feature], np.cumsum(y[order])
        for i in np.flatnonzero(values[1:] > values[:-1]) + 1:
            if i < least or len(y) - i < least:
                continue
            low, high = ones[i - 1] / i, (ones[-1] - ones[i - 1]) / (len(y) - i)
            impurity = i * 2 * low * (1 - low) + (len(y) - i) * 2 * high * (1 - high)
            if impurity < best:
                best, node.feature, node.limit = impurity, feature, float((values[i] + values[i - 1]) / 2)
    if node.feature >= 0:
        left = x[:, node.feature] <= node.limit
        node.low, node.high = grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)
    return node


def is_main(tree: Node, x: np.ndarray) -> np.ndarray:
    if tree.feature < 0:
        return np.full(len(x), tree.share >= 0.5)
    left = x[:, tree.feature] <= tree.limit
    out = np.empty(len(x), bool)
    out[left], out[~left] = is_main(tree.low, x[left]), is_main(tree.high, x[~left])
    return out


@lru_cache(maxsize=1)
def trained_tree() -> Node:
    from .html_labels import labelled_pages

    rows, labels = [], []
    for page, wanted in labelled_pages():
        found = blocks(page)
        if len(found) != len(wanted):
            raise ValueError(f"{len(wanted)} labels for {len(found)} blocks: {[b.text for b in found]}")
        rows.append(features(found))
        labels.extend(wanted)
    return grow(np.vstack(rows), np.array(labels, float))


def main_text(page: str | None, tree: Node) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, is_main(tree, features(found)), strict=True) if keep)


def extract_main_text(pages: DataFrame, *, html_column: str = "html", result: str = "text") -> DataFrame:
    """Adds `result`, the main text of each page."""
    pages = clear_of(pages, result)
    place, tree = pages.columns.index(html_column), trained_tree()
    schema = T.StructType([*pages.schema.fields, T.StructField(result, T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, tree) for page in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, result]
            )

    return pages.mapInArrow(scan, schema)
