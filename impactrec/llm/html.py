"""Main text of web pages by a tree-structured graphical model.

Every block element and every run of text of a page is a node that is content or not. A node has
potentials from its features (tag, words in its class and id, links, length, sentences), and every
parent and child have a joint potential. Sum-product messages, from the leaves to the root and back,
give each node's exact marginal; text whose marginal is at least one half is the main text. Weights
are those under which the labels of labelled pages are most likely, found by gradient ascent with the
same messages. Pages of a batch are one forest, and a message step is one array operation per depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from impactrec.llm.words import slices

# Names of HTML elements by their role in a page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark picture q s samp small "
    "source span strike strong sub sup time tt u var wbr "
    "svg g path circle ellipse line polygon polyline rect use defs text tspan "
    "math mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics "
    "annotation".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TAGS = (
    "#text other html body div section article main header footer nav aside h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd "
    "table thead tbody tr td th form fieldset label input button select option blockquote pre figure figcaption "
    "address details summary center dialog menu hr"
).split()
# Beginnings of words in class, id and role attributes, by what they say about a block.
NAME_GROUPS = {
    "content": "article content entry post story body main text prose",
    "menu": "nav menu breadcrumb crumb tabs toc pagination pager skip dropdown",
    "header": "header masthead topbar banner brand logo hero",
    "footer": "footer foot copyright colophon legal contentinfo",
    "side": "sidebar side aside rail widget complementary column",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promoted promotion dfp outbrain taboola",
    "notice": "notice cookie cookies consent gdpr alert warning disclaimer popup modal overlay newsletter subscribe paywall toast",
    "form": "form search login signup signin register contact input",
    "comment": "comment comments reply replies respond disqus discussion feedback reader",
    "extra": "related share sharing social recommended more tags meta byline author follow trending popular",
}

_TAG_ID = {t: i for i, t in enumerate(TAGS)}
_GROUP = {word: 1 << g for g, words in enumerate(NAME_GROUPS.values()) for word in words.split()}
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "body": ("head",), "tbody": ("thead", "tr", "td", "th"),
}
_P_STAYS = frozenset("label input button select option object iframe noscript template textarea".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title)(?![^\s/>])(?:(?<=script)[^>]*|[^>]*(?<!/))>.*?(?:</\1(?![^\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_LABEL = re.compile(r'\bdata-label="([01])"')
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

_LINK_BINS = np.array([0.01, 0.2, 0.5, 0.9])
_LENGTH_BINS = np.array([1, 15, 40, 80, 160, 400, 1200, 5000])
_MARK_BINS = np.array([1, 2, 5, 20])
#: Of each slot of features: how many values it has.
_SLOTS = [len(TAGS), 2 * 5, 2 * 9, 2 * 5, len(TAGS) + 1, *[2] * len(NAME_GROUPS)]
_OFFSETS = np.concatenate([[0], np.cumsum(_SLOTS)])
_SIZE = int(_OFFSETS[-1])


@lru_cache(maxsize=4096)
def _groups(attributes: str) -> int:
    """Which name groups the class, id and role of an element belong to, as bits."""
    bits = 0
    for value in _NAMES.findall(attributes):
        for word in _WORD.findall(value):
            bits |= _GROUP.get(word.lower(), 0)
    return bits


class Forest:
    """The nodes of some pages in document order; parents come before children."""

    def __init__(self):
        self.parent: list[int] = []
        self.tag: list[int] = []
        self.names: list[int] = []
        self.level: list[int] = []
        self.chars: list[int] = []
        self.linked: list[int] = []
        self.marks: list[int] = []
        self.texts: list[str | None] = []
        self.labels: list[int] = []
        self.starts: list[int] = []

    def _node(self, parent: int, tag: int, names: int, label: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.level.append(self.level[parent] + 1 if parent >= 0 else 0)
        self.chars.append(0)
        self.linked.append(0)
        self.marks.append(0)
        self.texts.append(None)
        self.labels.append(label)
        return len(self.parent) - 1

    def add(self, page: str) -> None:
        """Parse a page. Labels of nodes come from ``data-label`` attributes and pass to what is inside."""
        self.starts.append(len(self.parent))
        stack: list[tuple[str, int]] = [("html", self._node(-1, _TAG_ID["html"], 0, 0))]
        run: list[str] = []
        linked, in_link, at = 0, False, 0

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                above = stack[-1][1]
                node = self._node(above, 0, 0, self.labels[above])
                self.texts[node] = text
                self.chars[node] = len(text)
                self.linked[node] = min(linked, len(text))
                self.marks[node] = text.count(". ") + text.count(", ") + text.count("? ") + text.endswith((".", "!", "?"))
            linked = 0

        def words(piece: str) -> None:
            nonlocal linked
            if "&" in piece:
                piece = unescape(piece)
            run.append(piece)
            if in_link:
                linked += len(piece.strip())

        for match in _TOKEN.finditer(page):
            if match.start() > at:
                words(page[at : match.start()])
            at = match.end()
            name = match[3] or match[6]
            if name is None:
                continue
            name = name.lower()
            end = match[2] if match[3] else match[5]
            if name in INLINE:
                if name == "a":
                    in_link = not end
                elif name in ("br", "img", "wbr"):
                    run.append(" ")
                continue
            flush()
            if end:
                in_link = False
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == name:
                        del stack[depth:]
                        break
                continue
            attributes = (match[4] if match[3] else match[7]) or ""
            closes = _CLOSES.get(name, ())
            if stack[-1][0] == "p" and name not in _P_STAYS or stack[-1][0] in closes:
                stack.pop()
                while stack[-1][0] in closes and len(stack) > 1:
                    stack.pop()
            if name == "html":
                continue
            above = stack[-1][1]
            marked = _LABEL.search(attributes) if "data-label" in attributes else None
            label = int(marked[1]) if marked else self.labels[above]
            node = self._node(above, _TAG_ID.get(name, 1), _groups(attributes) if attributes else 0, label)
            if name not in VOID and not attributes.endswith("/"):
                stack.append((name, node))
        if at < len(page):
            words(page[at:])
        flush()

    def arrays(self) -> Arrays:
        parent, level = np.array(self.parent, np.int64), np.array(self.level, np.int64)
        order = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[order], np.arange(level.max(initial=-1) + 2))
        levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]
        tag = np.array(self.tag, np.int64)
        sums = [np.array(x, np.int64) for x in (self.chars, self.linked, self.marks)]
        families = [_families(nodes, parent) for nodes in levels]
        for nodes, (first, above) in zip(reversed(levels[1:]), reversed(families[1:])):
            for total in sums:
                total[above] += np.add.reduceat(total[nodes], first)
        chars, linked, marks = sums
        leaf = (tag == 0).astype(np.int64)
        names = np.array(self.names, np.int64)
        above = np.where(parent >= 0, tag[parent], len(TAGS))
        columns = [
            tag,
            np.searchsorted(_LINK_BINS, linked / np.maximum(chars, 1)) + 5 * leaf,
            np.searchsorted(_LENGTH_BINS, chars, side="right") + 9 * leaf,
            np.where(leaf, 5, np.searchsorted(_MARK_BINS, marks, side="right")),
            above,
            *[(names >> g) & 1 for g in range(len(NAME_GROUPS))],
        ]
        return Arrays(parent, levels, families, np.stack(columns, 1) + _OFFSETS[:-1], leaf)


def _families(nodes: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the children of each parent begin among the nodes of a depth, and these parents."""
    above = parent[nodes]
    first = np.flatnonzero(np.diff(above, prepend=-2))
    return first, above[first]


@dataclass
class Arrays:
    parent: np.ndarray
    levels: list[np.ndarray]  # nodes by depth, siblings together
    families: list[tuple[np.ndarray, np.ndarray]]
    features: np.ndarray
    leaf: np.ndarray


@dataclass
class Model:
    weights: np.ndarray  # by feature: what it adds to the log potential of content
    pairs: np.ndarray  # by kind of child, its state, and the parent's state


def messages(forest: Arrays, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every node, and of every node's state together with its parent's (by sum-product)."""
    n = len(forest.parent)
    belief = np.zeros((n, 2))
    belief[:, 1] = model.weights[forest.features].sum(1)
    pair = model.pairs[forest.leaf]
    up = np.zeros((n, 2))
    for nodes, (first, above) in zip(reversed(forest.levels[1:]), reversed(forest.families[1:])):
        joint = belief[nodes][:, :, None] + pair[nodes]
        up[nodes] = np.logaddexp(joint[:, 0], joint[:, 1])
        belief[above] += np.add.reduceat(up[nodes], first)
    down = np.zeros((n, 2))
    joint_all = np.zeros((n, 2, 2))
    for nodes in forest.levels[1:]:
        above = forest.parent[nodes]
        rest = belief[above] + down[above] - up[nodes]
        joint = pair[nodes] + rest[:, None, :]
        down[nodes] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
        joint_all[nodes] = joint + belief[nodes][:, :, None]
    total = belief + down
    total -= total.max(1, keepdims=True)
    single = np.exp(total)
    single /= single.sum(1, keepdims=True)
    joint_all -= joint_all.max((1, 2), keepdims=True)
    joint_all = np.exp(joint_all)
    return single[:, 1], joint_all / joint_all.sum((1, 2), keepdims=True)


def train(forest: Forest, steps: int = 300, rate: float = 0.1, penalty: float = 2e-3) -> Model:
    """Weights that make the labels of a forest most likely, by gradient ascent (Adam)."""
    arrays, y = forest.arrays(), np.array(forest.labels)
    children = np.flatnonzero(arrays.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (arrays.leaf[children], y[children], y[arrays.parent[children]]), 1)
    model, n = Model(np.zeros(_SIZE), np.zeros((2, 2, 2))), max(1, len(y))
    moments = [(np.zeros(x.shape), np.zeros(x.shape)) for x in (model.weights, model.pairs)]
    for step in range(1, steps + 1):
        single, joint = messages(arrays, model)
        slope = np.zeros(_SIZE)
        for column in arrays.features.T:
            slope += np.bincount(column, weights=y - single, minlength=_SIZE)
        expected = np.stack([joint[children[arrays.leaf[children] == kind]].sum(0) for kind in (0, 1)])
        for values, gradient, (first, second) in zip(
            (model.weights, model.pairs), (slope / n, (seen - expected) / n), moments
        ):
            gradient = gradient - penalty * values / 10
            first += 0.1 * (gradient - first)
            second += 0.01 * (gradient**2 - second)
            values += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return model


def label_by_markup(page: str) -> str | None:
    """A page whose author has marked the article, with that mark as the label; None for others."""
    if len(re.findall(r"<article\b", page, re.I)) != 1:
        return None
    page = re.sub(r"<(nav|aside|footer|form)\b", r'<\1 data-label="0"', page, flags=re.I)
    return re.sub(r"<article\b", '<article data-label="1"', page, flags=re.I)


def fit(pages: DataFrame, examples: Sequence[str], most: int = 300) -> Model:
    """Learn from ``examples``, pages with ``data-label`` attributes, and from at most ``most`` pages of the
    table that mark their article: of the rows, those with the least hash of ``page_id`` and ``html``."""
    known = pages.where(F.col("html").isNotNull() & F.col("page_id").isNotNull()).select("page_id", "html")
    rows = known.orderBy(F.xxhash64("page_id", "html"), "page_id", "html").limit(most).collect()
    forest = Forest()
    for page in examples:
        forest.add(page)
    for row in sorted(rows, key=lambda r: (r["page_id"], r["html"] or "")):
        if marked := label_by_markup(row["html"] or ""):
            forest.add(marked)
    return train(forest)


def extract_pages(pages: Sequence[str], model: Model) -> list[str]:
    """The main text of each page: its content blocks in order, one to a line."""
    forest = Forest()
    for page in pages:
        forest.add(page)
    if not pages:
        return []
    marginals, _ = messages(forest.arrays(), model)
    bounds = [*forest.starts, len(forest.parent)]
    kept = (marginals >= 0.5).tolist()
    return [
        "\n".join(t for t, k in zip(forest.texts[a:b], kept[a:b]) if k and t is not None)
        for a, b in zip(bounds, bounds[1:])
    ]


def extract(pages: DataFrame, model: Model, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """``keep``, ``text`` and ``n_chars`` (code points) for every row.

    The text is empty if there is none, also for a null or empty ``html``. Broken markup is read as
    far as it goes: end tags that match nothing are passed over, elements left open end with the
    page. Scripts, styles, titles and comments are skipped; nothing else is dropped or cut. Equal
    pages get equal texts.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = extract_pages([x or "" for x in batch.column("html").to_pylist()], shared.value)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, "text", "n_chars"],
            )

    schema = pages.select(*keep).schema.add("text", T.StringType()).add("n_chars", T.LongType())
    return pages.select(*keep, "html").mapInArrow(run, schema)
