"""The main text of web pages, as the maximum-scoring subsequence of their words and tags.

A page is read once, from left to right, into text pieces and tags. A piece knows the elements that it is in: their names, and the words of their classes, ids and roles. Weights of
these come from labelled pages (``labelled_pages``): a logistic regression says how likely the words of a piece are content, so a word scores between 1 and -1; a tag scores below zero, the more so the more
often it stands outside content. The contiguous region whose sum is greatest is found by one scan over running sums. Inside it, pieces that are likelier no content (an advert between two
paragraphs, a form) are left out, and the rest is the text. How much words of no content count against a region is chosen on the labelled pages too: too much would cut a short last paragraph off behind a
long advert, nothing would keep what stands outside the article.

Text is decoded (character references), white space inside a block becomes one space, blocks are trimmed and joined by line feeds; ``br`` counts as white space. Broken markup
is read much as browsers do: unclosed elements end with what they are in, a ``<`` before no letter is text, an unclosed comment, script or style goes to the end, an unclosed quote in a tag ends with that
tag. All of it takes time in proportion to the page.

Null and empty pages give an empty text, as do pages without content; text without any markup is content. Rows that repeat are judged alike; other columns are carried along, whatever their names. Of regions
that score alike the first counts.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.common import shipped
from tablewright.llm.labelled_pages import PAGES

# Elements by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style".split())
#: What browsers don't show as text of the page.
UNSEEN = frozenset("head title template noscript svg math iframe object audio video canvas textarea select option datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
#: A start tag of the key ends an open one of these, unless one of the others was opened since.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+(?=[\s/>"']|$)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Reader:
    """Reads a page into (kind, value) events: "text", "open" (name, attributes), "close"."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def _tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose name ended before ``at``; -1 if there is none."""
        start = at
        while self.quotes:
            stop = _STOP.search(self.page, at)
            if stop is None:
                break
            if stop.group() == ">":
                return stop.start()
            closing = self.page.find(stop.group(), stop.end())
            if closing < 0:
                break
            at = closing + 1
        # A quote that nothing closes: from here on quotes don't count, so no part is looked through twice.
        self.quotes = False
        return self.page.find(">", start)

    def events(self) -> Iterator[tuple[str, object]]:
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            less = page.find("<", at)
            if less < 0:
                less = n
            if less > at:
                yield "text", page[at:less]
            if less >= n - 1:
                if less == n - 1:
                    yield "text", "<"
                return
            if page.startswith("<!--", less):
                end = page.find("-->", less + 2)
                at = n if end < 0 else end + 3
                continue
            closing = page[less + 1] == "/"
            name = _NAME.match(page, less + 1 + closing)
            if name is None:
                if page[less + 1] in "!?/":
                    end = page.find(">", less)
                    at = n if end < 0 else end + 1
                else:
                    yield "text", "<"
                    at = less + 1
                continue
            end = self._tag_end(name.end())
            if end < 0:
                return
            tag, at = name.group().lower(), end + 1
            if closing:
                yield "close", tag
                continue
            yield "open", (tag, page[name.end() : end])
            if tag in RAW:
                close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
                at = n if close is None else close.start()


def _features(tag: str, attributes: str) -> list[str]:
    found = [tag]
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                found.append("#hidden")
            elif name in ("class", "id", "role"):
                found += ["." + w.lower() for w in _WORDS.findall(value)]
    return found


@dataclass
class Piece:
    """Text between two tags, the features of the elements it is in, and the number of its block."""

    text: str
    features: frozenset[str]
    block: int


def read(page: str) -> list[Piece | str]:
    """A page's pieces and tag names in order."""
    out: list[Piece | str] = []
    stack: list[tuple[str, list[str]]] = []
    open_at: dict[str, list[int]] = {}
    held: dict[str, int] = {}
    now: frozenset[str] | None = frozenset()
    block, unseen = 0, 0

    def leave(k: int) -> None:
        nonlocal now, unseen
        tag, features = stack[k]
        if tag:
            for f in features:
                held[f] -= 1
            now, unseen = None, unseen - (tag in UNSEEN)
            stack[k] = ("", [])
            open_at[tag].remove(k) if open_at[tag][-1] != k else open_at[tag].pop()

    def pop_to(k: int) -> None:
        while len(stack) > k:
            leave(len(stack) - 1)
            stack.pop()

    last = lambda tags: max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)
    for kind, value in _Reader(page).events():
        if kind == "text":
            if not unseen:
                if now is None:
                    now = frozenset(f for f, n in held.items() if n)
                out.append(Piece(entities.unescape(value), now, block))
            continue
        tag, attributes = value if kind == "open" else (value, "")
        if tag in BLOCK:
            block += 1
        elif tag == "br":
            out.append(Piece("\n", frozenset(), block))
        out.append(tag)
        if kind == "close":
            if tag in ("html", "body") or not open_at.get(tag):
                continue
            if tag in BLOCK:
                pop_to(open_at[tag][-1])
            else:
                leave(open_at[tag][-1])
            continue
        if tag in VOID or tag in RAW:
            continue
        if tag in BLOCK and (k := last(("p",))) >= 0:
            pop_to(k)
        if tag in ENDS and (k := last(ENDS[tag][0])) > last(ENDS[tag][1]):
            pop_to(k)
        features = _features(tag, attributes)
        open_at.setdefault(tag, []).append(len(stack))
        stack.append((tag, features))
        for f in features:
            held[f] = held.get(f, 0) + 1
        now, unseen = None, unseen + (tag in UNSEEN)
    return out


@dataclass
class Model:
    """Weights of the features of words, how much tags count against a region, and the share at which words of no content do."""

    bias: float
    words: dict[str, float]
    tags: dict[str, float]
    against: float = 1.0
    known: dict[frozenset[str], float] = field(default_factory=dict, repr=False, compare=False)

    def word(self, features: frozenset[str]) -> float:
        """Score of a word, from -1 to 1; above 0 where content is likelier."""
        if features not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            self.known[features] = float(np.tanh((self.bias + sum(self.words.get(f, 0.0) for f in sorted(features))) / 2))
        return self.known[features]


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """(first, last + 1) of the contiguous part with the greatest sum, the first such; empty if no sum is above 0."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    lowest = np.minimum.accumulate(sums)
    gains = sums[1:] - lowest[:-1]
    if not len(gains) or gains.max() <= 0:
        return 0, 0
    last = int(gains.argmax()) + 1
    return int(sums[:last].argmin()), last


def main_text(page: str | None, model: Model) -> str:
    """The main text of a page."""
    items = read(page or "")
    scores = np.zeros(len(items))
    for k, item in enumerate(items):
        if isinstance(item, str):
            scores[k] = -model.against * model.tags.get(item, 0.5)
        elif n := len(item.text.split()):
            one = model.word(item.features)
            scores[k] = n * (one if one > 0 else model.against * one)
    first, last = best_region(scores)
    blocks: dict[int, list[str]] = {}
    for item in items[first:last]:
        if not isinstance(item, str) and (model.word(item.features) > 0 or item.text == "\n"):
            blocks.setdefault(item.block, []).append(item.text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


#: Marks around content in labelled pages.
OPEN, CLOSE = "⟦", "⟧"


def unmarked(page: str) -> str:
    return page.replace(OPEN, "").replace(CLOSE, "")


def _labelled(page: str) -> Iterator[tuple[Piece | str, bool]]:
    """Items of a page, and whether they are in content; a mark may stand before the tags around what it marks."""
    inside = False
    for item in read(page):
        if isinstance(item, str):
            yield item, inside
            continue
        for part in re.split(f"([{OPEN}{CLOSE}])", item.text):
            if part in (OPEN, CLOSE):
                inside = part == OPEN
            elif part:
                yield Piece(part, item.features, item.block), inside


def wanted(page: str) -> str:
    """The text that a labelled page marks."""
    blocks: dict[int, list[str]] = {}
    for item, inside in _labelled(page):
        if inside and not isinstance(item, str):
            blocks.setdefault(item.block, []).append(item.text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def train(pages: list[str] = PAGES, steps: int = 4000, rate: float = 0.5, ridge: float = 3e-4) -> Model:
    """Weights from labelled pages: logistic regression by gradient descent on the driver, every page of one weight; then the share ``against`` by most pages read right, the greatest of equals."""
    rows, labels, weights, tags = [], [], [], {}
    for page in pages:
        of_page = []
        for item, inside in _labelled(page):
            if isinstance(item, str):
                out_in = tags.setdefault(item, [1, 1])
                out_in[inside] += 1
            elif item.text.strip():
                of_page.append((item.features, inside))
        rows += [r for r, _ in of_page]
        labels += [y for _, y in of_page]
        weights += [1 / len(of_page)] * len(of_page)
    names = sorted(set().union(*rows))
    place = {f: k for k, f in enumerate(names)}
    x, y, w = np.zeros((len(rows), len(names) + 1)), np.array(labels, float), np.array(weights)
    x[:, -1] = 1
    for k, r in enumerate(rows):
        x[k, [place[f] for f in r]] = 1
    theta, total = np.zeros(len(names) + 1), w.sum()
    for _ in range(steps):
        wrong = w * (1 / (1 + np.exp(-x @ theta)) - y)
        theta -= rate * (x.T @ wrong / total + ridge * theta)
    model = Model(float(theta[-1]), {f: float(theta[k]) for f, k in place.items()}, {t: a / (a + b) for t, (a, b) in tags.items()})
    right = lambda share: sum(main_text(unmarked(p), Model(model.bias, model.words, model.tags, share)) == wanted(p) for p in pages)
    model.against = max((0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0), key=lambda share: (right(share), share))
    return model


def extracted(pages: DataFrame, model: Model, html: str = "html") -> Column:
    """A column with the main text of ``html``; null gives the empty text."""
    shipped(pages)

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, model) for p in column], dtype=object)

    return texts(F.col(html))
