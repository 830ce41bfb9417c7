"""Main text of web pages from flat text blocks and a decision tree.

A page becomes a flat list of text blocks (what stands between block-level
tags).  Each block is described by its words and link density, those of the
blocks before and after it, and what its containers say of themselves (element
names, class and id words).  A decision tree, trained on the small labelled
table below, tells main text from the rest.  Pages are independent, so there
is no shuffle.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from curata.llm.common import schema_with, with_columns

# Fixed values of HTML: elements whose content is no text of the page, that stand in a line, that have no end.
RAW = "script|style|noscript|template|textarea|title|svg|iframe|object|select|option|button|math|canvas|audio|video"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Containers that go with the element's open and end tags; others (p, li, ...) only part blocks.
CONTAINERS = frozenset("article aside body details dialog div dl fieldset figure footer form header main menu nav ol section table tbody td th tr ul".split())
CONTENT_TAGS = frozenset("article main".split())
OTHER_TAGS = frozenset("nav aside footer form header menu dialog fieldset".split())
CONTENT_WORDS = frozenset("article articlebody body content entry main maincontent post story".split())
OTHER_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement alert banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright "
    "disclaimer disqus follow footer form gdpr header legal login masthead menu meta modal nav navbar navigation newsletter notice notification overlay "
    "pager pagination popup promo promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe tags toc toolbar topbar widget widgets".split()
)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:(?<=/)>|>(?:.*?)(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
# Names with such words speak of the page's state or of topics, not of what the container is: no-sidebar, comments-open, category-legal.
STATE_WORDS = frozenset("no not non without with has open closed enabled disabled free off on category cat tag term topic status format".split())
# How surely a container is no main text: by a compound name, form or header; by a plain name or an element; by being hidden.
WEAK, SURE, HIDDEN = 1, 2, 3
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    words: int
    linked: int  # of the words
    other: bool  # inside a container that names itself menu, footer, advert, ...
    content: bool  # inside a container that names itself article, main, ...
    heading: bool


def _claims(name: str, attributes: str) -> tuple[int, int]:
    """How surely a container's element and names say other (0, WEAK, SURE, HIDDEN) and content (0, WEAK, SURE)."""
    other = SURE if name in OTHER_TAGS and name not in ("form", "header") else WEAK if name in OTHER_TAGS else 0
    content = SURE if name == "main" else 0
    own = False  # names itself content in a plain name
    for hit in _ATTRIBUTE.finditer(attributes):
        key, value = hit[1].lower(), hit[2] or hit[3] or hit[4] or ""
        if key == "hidden" and value.lower() != "false" or key == "style" and _UNSEEN.search(value):
            return HIDDEN, content
        if key not in ("class", "id", "role"):
            continue
        for token in value.split():
            words = {w.lower() for w in _WORD.findall(token)}
            if not words or words & STATE_WORDS:
                continue
            if words <= OTHER_WORDS:
                other = max(other, SURE)
            elif words & OTHER_WORDS or token == "hidden":
                other = max(other, WEAK)
            elif words & CONTENT_WORDS:
                own = True
                if key == "role" and token == "main":
                    content = SURE
    if other == WEAK and (own or content) and name not in ("form", "header"):
        other = 0
    if other == 0 and not content and (own or name in CONTENT_TAGS):
        content = WEAK
    return other, content


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order: character references decoded, white space runs one space, empty blocks left out.

    A container inside another speaks for itself: main text in a container of a doubtful name, or in a form or header, is
    main text; <main> is wherever it stands.  A form around half of the page's words or more says nothing.
    """
    out: list[Block] = []
    forms: list[int] = []  # of each block: the form whose words alone make it other, or -1
    words_in: list[int] = []  # of each form
    parts: list[str] = []
    linked: list[bool] = []
    stack: list[tuple[str, int, bool, int, int]] = [("", 0, False, -1, -1)]  # name, other, content, form, form that counts
    in_link, heading = False, False

    def close() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                n = sum(len(p.split()) for p, a in zip(parts, linked, strict=True) if a)
                words = text.count(" ") + 1
                _, other, content, form, counts = stack[-1]
                out.append(Block(text, words, min(n, words), other > 0, content, heading))
                forms.append(counts)
                if form >= 0:
                    words_in[form] += words
            parts.clear()
            linked.clear()

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            parts.append(html.unescape(text) if "&" in text else text)
            linked.append(in_link)
            continue
        name = m["name"]
        if name is None:
            if m["raw"] is not None and m["raw"].lower() not in INLINE:
                close()
            continue
        name = name.lower()
        if name == "a":
            in_link = not m["end"]
        if name in INLINE:
            continue
        close()
        if name[0] == "h" and name[1:].isdigit():
            heading = not m["end"]
        if name in VOID or name not in CONTAINERS:
            continue
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        _, other, content, form, counts = stack[-1]
        # what the body's classes say holds for all of the page
        says_other, says_content = (0, 0) if name == "body" else _claims(name, m["attributes"] or "")
        # the header of an article or of the main text holds its title
        if says_other < HIDDEN and name == "header" and any(x[0] in CONTENT_TAGS for x in stack):
            says_other = 0
        if says_content and other <= says_content:
            other, counts = 0, -1
        if says_content:
            content = True
        if name == "form" and says_other < SURE:
            says_other = 0
            if form < 0:
                words_in.append(0)
                form = counts = len(words_in) - 1
        stack.append((name, max(other, says_other), content, form, counts))
    close()
    half = sum(b.words for b in out) / 2
    for b, f in zip(out, forms, strict=True):
        b.other = b.other or (f >= 0 and words_in[f] < half)
    return out


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "other", "content", "heading")
# Labelled blocks: the features above, then 1 for main text.  Words and link densities are of typical pages.
LABELLED = np.array(
    [
        # menus and link lists without names
        (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0), (2, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0),
        (3, 1.0, 2, 1.0, 60, 0.0, 0, 0, 0, 0), (6, 1.0, 5, 1.0, 7, 1.0, 0, 0, 0, 0), (12, 0.9, 3, 1.0, 10, 1.0, 0, 0, 0, 0),
        (20, 0.8, 15, 0.7, 22, 0.9, 0, 0, 0, 0), (40, 0.75, 9, 1.0, 4, 1.0, 0, 0, 0, 0), (8, 0.6, 80, 0.0, 3, 1.0, 0, 0, 0, 0),
        (2, 1.0, 90, 0.0, 2, 1.0, 0, 0, 0, 0), (4, 0.5, 2, 1.0, 1, 1.0, 0, 0, 0, 0), (15, 0.45, 3, 0.6, 5, 1.0, 0, 0, 0, 0),
        (2, 1.0, 1, 1.0, 60, 0.0, 0, 0, 0, 0), (2, 1.0, 0, 0.0, 24, 0.0, 0, 0, 0, 0), (1, 1.0, 30, 0.0, 30, 0.0, 0, 0, 0, 0),
        (9, 0.8, 4, 0.0, 45, 0.0, 0, 0, 0, 0), (26, 0.9, 40, 0.0, 8, 0.0, 0, 0, 0, 0), (35, 0.7, 20, 0.0, 30, 0.0, 0, 0, 0, 0),
        (2, 1.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0), (5, 0.6, 2, 0.0, 18, 0.0, 0, 0, 0, 0), (3, 0.7, 25, 0.0, 0, 0.0, 0, 0, 0, 0),
        # lines of chrome without links
        (3, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0), (4, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0), (6, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0, 0),
        (5, 0.0, 3, 1.0, 3, 1.0, 0, 0, 1, 0), (8, 0.0, 70, 0.0, 0, 0.0, 0, 0, 0, 0), (2, 0.0, 2, 0.0, 3, 0.0, 0, 0, 0, 0),
        (9, 0.1, 4, 0.5, 0, 0.0, 0, 0, 0, 0), (1, 0.0, 3, 1.0, 1, 1.0, 0, 0, 0, 0),
        (3, 0.0, 0, 0.0, 4, 0.0, 0, 0, 0, 0), (4, 0.0, 3, 0.0, 2, 1.0, 0, 0, 0, 0), (7, 0.0, 2, 1.0, 4, 1.0, 0, 0, 0, 0),
        (10, 0.0, 5, 0.8, 6, 0.9, 0, 0, 0, 0), (6, 0.0, 40, 0.0, 0, 0.0, 0, 0, 0, 0), (5, 0.0, 100, 0.0, 2, 1.0, 0, 0, 0, 0),
        # running text without names
        (24, 0.05, 2, 1.0, 3, 0.0, 0, 0, 0, 1), (24, 0.05, 3, 0.0, 1, 1.0, 0, 0, 0, 1), (28, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 1),
        (40, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 1), (90, 0.1, 3, 1.0, 4, 0.0, 0, 0, 0, 1), (65, 0.0, 4, 0.0, 1, 1.0, 0, 0, 0, 1),
        (26, 0.2, 2, 0.0, 0, 0.0, 0, 0, 0, 1), (150, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0, 1), (23, 0.1, 12, 0.0, 2, 1.0, 0, 0, 0, 1),
        (25, 0.0, 30, 0.0, 40, 0.0, 0, 0, 0, 1), (60, 0.0, 3, 1.0, 55, 0.0, 0, 0, 0, 1), (120, 0.05, 90, 0.0, 4, 1.0, 0, 0, 0, 1),
        (45, 0.1, 10, 0.0, 70, 0.02, 0, 0, 0, 1), (80, 0.2, 60, 0.1, 75, 0.0, 0, 0, 0, 1), (33, 0.0, 8, 0.0, 0, 0.0, 0, 0, 0, 1),
        (200, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (18, 0.0, 50, 0.0, 45, 0.0, 0, 0, 0, 1), (22, 0.0, 2, 1.0, 65, 0.0, 0, 0, 0, 1),
        (30, 0.25, 40, 0.0, 42, 0.1, 0, 0, 0, 1), (55, 0.0, 70, 0.0, 6, 0.0, 0, 0, 0, 1), (16, 0.0, 25, 0.0, 31, 0.0, 0, 0, 0, 1),
        # short lines and headings inside running text without names
        (5, 0.0, 60, 0.0, 70, 0.0, 0, 0, 1, 1), (7, 0.0, 45, 0.0, 80, 0.0, 0, 0, 1, 1), (6, 0.0, 55, 0.0, 38, 0.0, 0, 0, 0, 1),
        (9, 0.0, 30, 0.0, 25, 0.0, 0, 0, 0, 1), (8, 0.0, 2, 1.0, 90, 0.0, 0, 0, 1, 1), (10, 0.0, 1, 1.0, 60, 0.0, 0, 0, 1, 1),
        # containers that name themselves article or main
        (4, 0.0, 6, 0.0, 40, 0.0, 0, 1, 1, 1), (9, 0.0, 3, 1.0, 2, 0.0, 0, 1, 1, 1), (1, 0.0, 40, 0.0, 1, 0.0, 0, 1, 0, 1),
        (2, 0.0, 1, 0.0, 1, 0.0, 0, 1, 0, 1), (60, 0.0, 9, 0.0, 80, 0.0, 0, 1, 0, 1), (150, 0.02, 60, 0.0, 12, 0.2, 0, 1, 0, 1),
        (35, 0.3, 50, 0.0, 20, 0.0, 0, 1, 0, 1), (3, 0.0, 90, 0.0, 7, 0.1, 0, 1, 0, 1), (12, 0.0, 4, 1.0, 0, 0.0, 0, 1, 0, 1),
        (6, 0.5, 40, 0.0, 30, 0.0, 0, 1, 0, 1), (3, 1.0, 40, 0.0, 55, 0.0, 0, 1, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1),
        (5, 0.8, 30, 0.0, 3, 0.0, 0, 1, 0, 1), (4, 1.0, 25, 0.0, 0, 0.0, 0, 1, 0, 1), (8, 0.4, 9, 0.0, 12, 0.0, 0, 1, 0, 1),
        (5, 0.0, 1, 1.0, 8, 0.3, 0, 1, 0, 1), (7, 0.0, 5, 1.0, 5, 1.0, 0, 1, 1, 1), (4, 0.2, 8, 0.0, 3, 1.0, 0, 1, 0, 1),
        # containers that name themselves menu, header, footer, sidebar, notice, advert, form or comments
        (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0), (5, 0.0, 3, 0.0, 4, 1.0, 1, 0, 0, 0), (8, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0, 0),
        (30, 0.0, 50, 0.0, 45, 0.0, 1, 0, 0, 0), (70, 0.0, 90, 0.0, 40, 0.0, 1, 0, 0, 0), (120, 0.0, 80, 0.0, 60, 0.0, 1, 1, 0, 0),
        (25, 0.0, 70, 0.0, 65, 0.0, 1, 1, 0, 0), (6, 0.0, 40, 0.0, 50, 0.0, 1, 1, 0, 0), (3, 1.0, 40, 0.0, 2, 1.0, 1, 1, 0, 0),
        (4, 0.0, 30, 0.0, 20, 0.0, 1, 1, 1, 0), (9, 0.0, 1, 1.0, 60, 0.0, 1, 0, 1, 0), (45, 0.1, 6, 0.0, 0, 0.0, 1, 0, 0, 0),
        (2, 0.0, 0, 0.0, 3, 0.0, 1, 0, 0, 0), (15, 0.0, 200, 0.0, 0, 0.0, 1, 0, 0, 0), (50, 0.4, 30, 0.0, 12, 1.0, 1, 1, 0, 0),
        # linked adverts and link lists inside articles
        (6, 1.0, 40, 0.0, 50, 0.0, 1, 1, 0, 0), (12, 1.0, 60, 0.0, 0, 0.0, 1, 1, 0, 0), (4, 0.8, 25, 0.0, 30, 0.1, 1, 1, 0, 0),
        (2, 1.0, 70, 0.0, 9, 0.0, 1, 1, 1, 0), (18, 0.9, 5, 0.0, 80, 0.05, 1, 1, 0, 0), (8, 0.6, 0, 0.0, 20, 0.0, 1, 1, 0, 0),
        # runs of short main lines without names
        (5, 0.0, 6, 0.0, 5, 0.0, 0, 0, 0, 1), (4, 0.0, 5, 0.0, 6, 0.0, 0, 0, 0, 1), (7, 0.0, 7, 0.0, 4, 0.0, 0, 0, 0, 1),
        (6, 0.0, 40, 0.0, 5, 0.0, 0, 0, 0, 1), (8, 0.0, 35, 0.0, 6, 0.0, 0, 0, 0, 1), (5, 0.0, 6, 0.0, 60, 0.0, 0, 0, 0, 1),
        (9, 0.0, 8, 0.0, 6, 0.0, 0, 0, 0, 1), (6, 0.0, 7, 0.0, 1, 1.0, 0, 0, 0, 1), (5, 0.0, 6, 0.0, 2, 1.0, 0, 0, 0, 1),
        (7, 0.0, 8, 0.0, 0, 0.0, 0, 0, 0, 1), (4, 0.0, 6, 0.0, 0, 0.0, 0, 0, 0, 1), (6, 0.0, 2, 1.0, 5, 0.0, 0, 0, 0, 1),
        (5, 0.0, 1, 1.0, 7, 0.0, 0, 0, 0, 1), (10, 0.0, 9, 0.0, 9, 0.0, 0, 0, 0, 1),
        # running text before links
        (40, 0.0, 30, 0.0, 8, 1.0, 0, 0, 0, 1), (90, 0.0, 60, 0.0, 12, 1.0, 0, 0, 0, 1), (30, 0.1, 2, 1.0, 6, 1.0, 0, 0, 0, 1),
        (45, 0.0, 30, 0.0, 7, 1.0, 0, 1, 0, 1), (25, 0.05, 0, 0.0, 6, 1.0, 0, 1, 0, 1), (12, 0.0, 50, 0.0, 9, 1.0, 0, 1, 0, 1),
        (16, 0.0, 20, 0.0, 10, 0.9, 0, 1, 0, 1), (14, 0.0, 25, 0.0, 5, 1.0, 0, 0, 0, 1), (9, 0.0, 20, 0.0, 8, 1.0, 0, 1, 1, 1),
        (40, 0.0, 5, 0.8, 30, 0.0, 0, 0, 0, 1), (20, 0.0, 6, 0.7, 12, 0.0, 0, 1, 0, 1), (15, 0.0, 4, 0.6, 40, 0.0, 0, 0, 0, 1),
        (8, 0.0, 9, 0.75, 25, 0.0, 0, 1, 0, 1), (60, 0.1, 8, 0.9, 7, 0.9, 0, 0, 0, 1), (26, 0.0, 6, 0.85, 9, 0.8, 0, 1, 0, 1),
        (40, 0.0, 5, 0.8, 6, 0.5, 0, 0, 0, 1), (25, 0.0, 8, 0.6, 5, 0.0, 0, 0, 0, 1), (30, 0.0, 6, 0.7, 6, 0.0, 0, 1, 0, 1),
    ],
    dtype=np.float64,
)


def train(table: np.ndarray, depth: int = 10, least: int = 1):
    """A decision tree by Gini impurity: nested (feature, cut, tree up to the cut, tree above it), leaves are 0 or 1."""

    def impurity(y):
        p = y.mean()
        return 2 * p * (1 - p) * len(y)

    def grow(rows, d):
        y = rows[:, -1]
        if d == 0 or len(rows) < 2 * least or y.min() == y.max():
            return int(y.mean() >= 0.5)
        best = None
        for f in range(rows.shape[1] - 1):
            values = np.unique(rows[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                low = rows[:, f] <= cut
                if min(low.sum(), (~low).sum()) >= least:
                    cost = impurity(y[low]) + impurity(y[~low])
                    if best is None or cost < best[0] - 1e-12:
                        best = (cost, f, float(cut))
        if best is None or best[0] >= impurity(y) - 1e-12:
            return int(y.mean() >= 0.5)
        low = rows[:, best[1]] <= best[2]
        return best[1], best[2], grow(rows[low], d - 1), grow(rows[~low], d - 1)

    return grow(table, depth)


@functools.lru_cache(maxsize=1)
def trained():
    return train(LABELLED)


def main_text(page: str, tree=None) -> str:
    """The main blocks in page order, joined by one space; empty if there is none."""
    tree = trained() if tree is None else tree
    found = blocks(page)
    own = [(b.words, b.linked / b.words) for b in found]
    around = [(0, 0.0), *own, (0, 0.0)]
    kept = []
    for i, b in enumerate(found):
        features = (*own[i], *around[i], *around[i + 2], b.other, b.content, b.heading)
        node = tree
        while type(node) is tuple:
            node = node[2] if features[node[0]] <= node[1] else node[3]
        if node:
            kept.append(b.text)
    return " ".join(kept)


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (default: all) of every row, ``text`` (its main text) and ``n_chars`` (code points, long).

    Null and empty pages have empty text.  Added columns replace kept ones of their name; every row is worked on alone.
    """
    keep = list(pages.columns) if keep is None else keep
    tree = trained()

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            texts = [main_text(p or "", tree) for p in b.column(b.schema.get_field_index(html_col)).to_pylist()]
            yield with_columns(b, keep, {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    needed = list(dict.fromkeys([*keep, html_col]))
    return pages.select(*[f"`{c}`" for c in needed]).mapInArrow(batches, schema_with(pages, keep, {"text": "string", "n_chars": "bigint"}))
