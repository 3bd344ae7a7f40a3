"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks, the text between two block-level tags.  Each is
described by its tag path (with class, id and role names) and its words, both
hashed to fixed random vectors, and a few proportions; no list of names is read.  A bidirectional LSTM
reads all blocks of a page in order and labels each as main text or not, so a
block is judged in the context of the whole document.

The model is trained here, on pages of the table whose markup names the article
(``article`` or ``main``) and on pages laid out at random from the words of the
table with the usual furniture around and inside the article.  Of these only a
quarter name furniture as pages usually do; half name it by words at random, as
other languages and templates would, and a quarter have no names, so that order,
elements and words must tell.

All work is linear in the page, however deep its elements nest: a path is a node
that knows its parent, and vectors of paths are sums that grow by one node.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from math import log1p
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.sampling import hash_sample

#: Element names with a meaning for the layout of text (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template".split())
BLOCK = frozenset(
    """address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
    section select summary table tbody td textarea tfoot th thead title tr ul""".split()
)
#: A paragraph outside one of these stays open inside it.
HOLDS_P = BLOCK - {"p"}
#: An open element that the start of one of these ends.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements and names of page furniture, for the labels of training pages.
FURNITURE_TAGS = frozenset("nav header footer aside form script style title head button select menu dialog".split())
FURNITURE_NAMES = (
    "ad ads advert advertisement banner promo sponsored sponsor menu navbar navigation breadcrumb breadcrumbs sidebar widget "
    "cookie consent notice popup modal newsletter subscribe signup share social related recommended trending comments comment "
    "reply disqus footer copyright legal login search tags pager pagination toolbar masthead topbar skip"
).split()

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
_NAME = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[^\W\d_]+")
_NAMES_OF_FURNITURE = frozenset(FURNITURE_NAMES)


class Node:
    """An open element with its names; what is said of a path is kept with its last element."""

    __slots__ = ("name", "names", "parent", "depth", "article", "furniture", "shown", "tokens", "whole")

    def __init__(self, name: str, names: tuple[str, ...], parent: Node | None):
        self.name, self.names, self.parent = name, names, parent
        self.depth = parent.depth + 1 if parent else 1
        named = name in ("article", "main")
        #: whether the path has an article, and furniture, by element or name
        self.article = named or bool(parent and parent.article)
        self.furniture = bool(parent and parent.furniture) or (not named and name not in ("body", "html") and (name in FURNITURE_TAGS or not _NAMES_OF_FURNITURE.isdisjoint(names)))
        #: the last element of the path that has a part in its vector, and the parts up to there
        own = name in BLOCK or name == "a"
        self.shown = self if own else parent and parent.shown
        self.tokens = (parent.tokens if parent else 0) + (1 + len(names) if own else 0)
        self.whole: np.ndarray | None = None


@dataclass
class Block:
    """One leaf: its text, its innermost open element, and its characters in links."""

    text: str
    node: Node | None
    linked: int


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page that have text, in order."""
    out: list[Block] = []
    stack: list[Node] = []
    opened: Counter[str] = Counter()  # elements of the stack by name
    text: list[str] = []
    linked = links = 0  # characters in links of this block; open links

    def flush() -> None:
        nonlocal linked
        if not text:
            return
        joined = " ".join("".join(text).split())
        if joined:
            out.append(Block(joined, stack[-1] if stack else None, linked))
        text.clear()
        linked = 0

    def close(names: tuple[str, ...], within: frozenset[str] = frozenset()) -> None:
        nonlocal links
        if not any(opened[n] for n in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].name in names:
                ended = [node.name for node in stack[k:]]
                if not BLOCK.isdisjoint(ended):
                    flush()
                links -= ended.count("a")
                opened.subtract(ended)
                del stack[k:]
                return
            if stack[k].name in within:
                return

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            text.append(plain)
            if links:
                linked += len(plain)

    page, at = page or "", 0
    while (match := _TAG.search(page, at)) is not None:
        say(page[at : match.start()])
        at = match.end()
        name = (match[2] or match[5] or "").lower()
        if not name:
            continue
        if match[1] or match[4]:
            if name in ("p", "br"):
                flush()
            close((name,))
            continue
        if name in BLOCK:
            flush()
            close(("p",), HOLDS_P)
            if name in CLOSES:
                close(CLOSES[name], frozenset(("ul", "ol", "dl", "table", "select", "article", "section", "div")))
        elif name == "br":
            text.append(" ")
        if name in VOID:
            continue
        attributes = match[3] or match[6] or ""
        if name in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        names = tuple(_TOKEN.findall(" ".join("".join(g) for g in _NAME.findall(attributes)).lower())) if "=" in attributes else ()
        links += name == "a"
        stack.append(Node(name, names, stack[-1] if stack else None))
        opened[name] += 1
    say(page[at:])
    flush()
    return out


# -- features

PATH, LEAF, WORDS = 64, 24, 16
OTHER = 10
INPUTS = PATH + LEAF + WORDS + OTHER
WORD_BUCKETS = 4096
HIDDEN = 24


@dataclass
class Featurizer:
    """Hashed random vectors of path parts and words, remembered up to a bound."""

    parts: dict[tuple[str, int], np.ndarray] = field(default_factory=dict)
    words_of: np.ndarray = field(default_factory=lambda: np.random.default_rng(1).choice([-1.0, 1.0], (WORD_BUCKETS, WORDS)).astype(np.float32))

    def vector(self, token: str, size: int) -> np.ndarray:
        if (token, size) not in self.parts:
            if len(self.parts) > 20_000:
                self.parts.clear()
            self.parts[token, size] = np.random.default_rng(crc32(token.encode("utf-8", "surrogatepass"))).choice([-1.0, 1.0], size).astype(np.float32)
        return self.parts[token, size]

    def _own(self, node: Node, size: int) -> np.ndarray:
        return sum((self.vector(f".{x}", size) for x in node.names), self.vector(node.name, size)) if node.names else self.vector(node.name, size)

    def path(self, node: Node | None, into: np.ndarray) -> None:
        """The sum over the path, over the root of its parts, and the vector of its last element."""
        last = node and node.shown
        if not last:
            return
        fresh = []
        at = last
        while at and at.whole is None:
            fresh.append(at)
            at = at.parent and at.parent.shown
        total = at.whole if at else np.zeros(PATH, dtype=np.float32)
        for one in reversed(fresh):
            total = one.whole = total + self._own(one, PATH)
        into[:PATH] = last.whole
        into[:PATH] /= (4 + last.tokens) ** 0.5
        into[PATH : PATH + LEAF] = self._own(last, LEAF)

    def words(self, text: str) -> np.ndarray:
        """The vectors of all words of the block, by bucket, over the root of their number."""
        words = text.lower().encode("utf-8", "surrogatepass").split()
        if len(words) == 1:
            return self.words_of[crc32(words[0]) % WORD_BUCKETS] / 5**0.5
        buckets = np.fromiter(map(crc32, words), dtype=np.uint32, count=len(words)) % WORD_BUCKETS
        if len(words) < WORD_BUCKETS:
            total = self.words_of[buckets].sum(axis=0)
        else:
            total = np.bincount(buckets, minlength=WORD_BUCKETS).astype(np.float32) @ self.words_of
        return np.clip(total / (4 + len(words)) ** 0.5, -3, 3)  # one word over and over is no outlier

    def page(self, found: list[Block]) -> np.ndarray:
        rows = np.zeros((len(found), INPUTS), dtype=np.float32)
        for k, b in enumerate(found):
            n = len(b.text)
            self.path(b.node, rows[k])
            rows[k, PATH + LEAF : -OTHER] = self.words(b.text)
            stops = b.text.count(".") + b.text.count(",")
            rows[k, -OTHER:-4] = (log1p(n) / 4, b.linked / n, min(stops / n * 10, 2), k / len(found), min(b.node.shown.depth if b.node and b.node.shown else 0, 30) / 10, k == 0)
        rows[:, -4:-2], rows[:, -2:] = steps_between(found), beside_heading(found)
        return rows


def steps_between(found: list[Block]) -> np.ndarray:
    """For each block, logarithms of the elements that ended and began since the one before."""
    out, last = np.zeros((len(found), 2), dtype=np.float32), None
    for k, b in enumerate(found):
        old, new = last, b.node and b.node.shown
        while old is not new:
            if new is None or (old is not None and old.depth >= new.depth):
                old, out[k, 0] = old.parent, out[k, 0] + 1
            else:
                new, out[k, 1] = new.parent, out[k, 1] + 1
        last = b.node and b.node.shown
    return np.log1p(out)


def beside_heading(found: list[Block]) -> np.ndarray:
    """For each block, whether the element around the page's first ``h1`` (else ``h2``) is around it too (1 or -1; 0 without such a heading), and how far below that it is."""
    out = np.zeros((len(found), 2), dtype=np.float32)
    heads = [next((b.node for b in found if b.node and b.node.name == h), None) for h in ("h1", "h2")]
    around = next((h.parent for h in heads if h), None)
    if around is None:
        return out
    below: dict[Node | None, float] = {around: 0.0, None: -1.0}
    for k, b in enumerate(found):
        fresh, at = [], b.node and b.node.shown
        while at not in below:
            fresh.append(at)
            at = at.parent
        far = below[at]
        for node in reversed(fresh):
            far = below[node] = far + 1 if far >= 0 else far
        out[k] = (1, min(far, 10) / 5) if far >= 0 else (-1, 0)
    return out


# -- model


@dataclass
class BlockLabeller:
    """One LSTM a direction and a logistic output over both."""

    w: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 3) -> BlockLabeller:
        draw = np.random.default_rng(seed)
        w = {}
        for d in ("f", "b"):
            w[d] = (draw.normal(size=(INPUTS + HIDDEN, 4 * HIDDEN)) / np.sqrt(INPUTS + HIDDEN)).astype(np.float32)
            w[d + "0"] = np.repeat(np.array([0, 1, 0, 0], dtype=np.float32), HIDDEN)  # forget gates begin open
        w["out"] = (draw.normal(size=2 * HIDDEN) / 4).astype(np.float32)
        w["out0"] = np.zeros(1, dtype=np.float32)
        return BlockLabeller(w)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """x: steps x pages x inputs, already in this direction's order; what learning needs of each step is kept."""
        h = c = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
        out, kept = np.zeros((*x.shape[:2], HIDDEN), dtype=np.float32), []
        pushed = x @ self.w[d][:INPUTS] + self.w[d + "0"]
        for t in range(len(x)):
            z = pushed[t] + h @ self.w[d][INPUTS:]
            g = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o, n = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * n
            shown = np.tanh(new)
            kept.append((h, c, i, f, o, n, shown, m))
            c = m * new + (1 - m) * c
            h = m * o * shown + (1 - m) * h
            out[t] = h
        return out, kept

    def _both(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The states of both directions, steps x pages x (2 * HIDDEN), without what learning needs."""
        twice = np.repeat(np.array([1, 1, 1, 2], dtype=np.float32), HIDDEN)  # tanh(v) is 2 / (1 + exp(-2 v)) - 1
        pushed = np.stack([x @ self.w["f"][:INPUTS] + self.w["f0"], x[::-1] @ self.w["b"][:INPUTS] + self.w["b0"]], axis=1) * -twice
        held = None if mask.all() else np.stack([mask, mask[::-1]], axis=1)[:, :, :, None] > 0
        again = np.stack([self.w["f"][INPUTS:], self.w["b"][INPUTS:]]) * -twice
        h = c = np.zeros((2, x.shape[1], HIDDEN), dtype=np.float32)
        out = np.empty((len(x), 2, x.shape[1], HIDDEN), dtype=np.float32)
        with np.errstate(over="ignore"):  # a gate that is shut
            for t in range(len(x)):
                z = np.matmul(h, again)
                z += pushed[t]
                np.exp(z, out=z)
                z += 1
                np.reciprocal(z, out=z)
                new = z[..., HIDDEN : 2 * HIDDEN] * c + z[..., :HIDDEN] * (2 * z[..., 3 * HIDDEN :] - 1)
                shown = z[..., 2 * HIDDEN : 3 * HIDDEN] * np.tanh(new)
                c, h = (new, shown) if held is None else (np.where(held[t], new, c), np.where(held[t], shown, h))
                out[t] = h
        return np.concatenate([out[:, 0], out[::-1, 1]], axis=2)

    def forward(self, x: np.ndarray, mask: np.ndarray, learning: bool = True):
        if not learning:
            both = self._both(x, mask)
            return 1 / (1 + np.exp(-(both @ self.w["out"] + self.w["out0"]))), both, [], []
        f, kept_f = self._run(x, mask, "f")
        b, kept_b = self._run(x[::-1], mask[::-1], "b")
        both = np.concatenate([f, b[::-1]], axis=2)
        return 1 / (1 + np.exp(-(both @ self.w["out"] + self.w["out0"]))), both, kept_f, kept_b

    def _back(self, x: np.ndarray, d_out: np.ndarray, kept: list, d: str) -> dict[str, np.ndarray]:
        d_h = d_c = np.zeros_like(d_out[0])
        d_z = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
        before = np.stack([k[0] for k in kept])
        for t in range(len(x) - 1, -1, -1):
            _, c, i, f, o, n, tc, m = kept[t]
            d_h = d_h + d_out[t]
            e = d_h * m
            d_new = d_c * m + e * o * (1 - tc * tc)
            d_z[t] = np.concatenate([d_new * n * i * (1 - i), d_new * c * f * (1 - f), e * tc * o * (1 - o), d_new * i * (1 - n * n)], axis=1)
            d_c = d_new * f + d_c * (1 - m)
            d_h = d_z[t] @ self.w[d][INPUTS:].T + d_h * (1 - m)
        flat = d_z.reshape(-1, 4 * HIDDEN)
        return {d: np.concatenate([x.reshape(-1, INPUTS).T @ flat, before.reshape(-1, HIDDEN).T @ flat]), d + "0": flat.sum(axis=0)}

    def gradients(self, x: np.ndarray, mask: np.ndarray, gold: np.ndarray) -> dict[str, np.ndarray]:
        p, both, kept_f, kept_b = self.forward(x, mask)
        d = (p - gold) * mask / mask.sum()
        d_both = d[:, :, None] * self.w["out"]
        out = self._back(x, d_both[:, :, :HIDDEN], kept_f, "f") | self._back(x[::-1], d_both[::-1, :, HIDDEN:], kept_b, "b")
        return out | {"out": np.tensordot(both, d, axes=([0, 1], [0, 1])), "out0": d.sum(keepdims=True).ravel()}

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """A probability of main text for each block; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            longest = len(pages[order[-1]])
            together = max(1, min(128, 40_000 // longest))
            chosen, order = order[-together:], order[:-together]
            x, mask = _padded([pages[k] for k in chosen])
            p = self.forward(x, mask, learning=False)[0]
            for j, k in enumerate(chosen):
                out[k] = p[: len(pages[k]), j]
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, mask = np.zeros((longest, len(pages), INPUTS), dtype=np.float32), np.zeros((longest, len(pages)), dtype=np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


# -- training

#: Bound of the learning sample, in pages, and the pages laid out at random.
SAMPLE_PAGES = 300
LAID_OUT = 1500
#: How often a run of a sampled page counts for one layout.
TAUGHT_TIMES = 2
#: Blocks of a sampled page that training reads at once, how many such runs of a page it takes, and how many of its words layouts may use.
TRAIN_BLOCKS, TRAIN_RUNS, TRAIN_WORDS = 120, 3, 1000


def markup_labels(found: list[Block]) -> list[int] | None:
    """1 for blocks of a named article outside furniture; None if no article is named."""
    if not any(b.node and b.node.article for b in found):
        return None
    return [int(bool(b.node) and b.node.article and not b.node.furniture) for b in found]


def lay_out(words: list[str], draw: np.random.Generator, kind: str | None = None) -> tuple[list[Block], list[int]]:
    """A page of random words with furniture around and inside its article.

    ``kind`` says what names are: ``usual``, random ``words``, or ``none``; drawn if not given.
    """
    out, labels = [], []
    # names as pages usually have them, words in their place (the same for the same name all over the page), or none
    kind = kind or ("usual", "words", "words", "none")[int(draw.integers(4))]
    other: dict[str, tuple[str, ...]] = {}

    def given(names: tuple[str, ...]) -> tuple[str, ...]:
        if kind == "usual" or not names:
            return names
        if kind == "none":
            return ()
        for n in names:
            if n not in other:
                other[n] = tuple(_TOKEN.findall(words[int(draw.integers(len(words)))].lower()))[:1] if draw.random() < 0.8 else ()
        return tuple(x for n in names for x in other[n])

    def text(low: int, high: int) -> str:
        return " ".join(words[i] for i in draw.integers(0, len(words), int(draw.integers(low, high + 1))))

    shared: dict[tuple, Node] = {}

    def add(path: tuple, label: int, low: int, high: int, link: float = 0.0, own: int = 1) -> None:
        """A block; the last ``own`` elements of its path are its own, the others those of earlier blocks with the same path."""
        t, node = text(low, high), None
        for k, (n, names) in enumerate(path):
            if k >= len(path) - own:
                node = Node(n, given(names), node)
            else:
                node = shared.setdefault(path[: k + 1], Node(n, given(names), node))
        out.append(Block(t, node, int(len(t) * link)))
        labels.append(label)

    def pick(*options):
        return options[int(draw.integers(len(options)))]

    top = pick(*[(("html", ()), ("body", ()))] * 4, (("body", ()),), ())  # these tags may be left out
    bare = draw.random() < 0.15  # nothing but the article
    if not bare and draw.random() < 0.8:
        add((*top[:-1], *((("head", ()),) if top else ()), ("title", ())), 0, 3, 12)
    wrap = pick((), (("div", ("wrapper",)),), (("div", ("page", "container")),))

    def furniture(base: tuple) -> None:
        name = FURNITURE_NAMES[int(draw.integers(len(FURNITURE_NAMES)))]
        kind = int(draw.integers(6))
        box = (*base, (pick("div", "div", "section", "aside", "ul"), (name, *pick((), ("box",), ("inner",)))))
        if kind == 0:
            for _ in range(int(draw.integers(2, 9))):
                add((*base, pick(("nav", ()), ("nav", ("main",)), ("div", ("menu",)), ("header", ())), ("ul", ()), ("li", ())), 0, 1, 3, 1.0)
        elif kind == 1:
            for _ in range(int(draw.integers(1, 4))):
                add((*base, (pick("aside", "header", "footer", "form"), pick((), (name,))), (pick("p", "div", "h3", "label"), ())), 0, 1, 40, pick(0.0, 0.0, 1.0))
        elif kind == 2:
            comments = (*base, (pick("section", "div", "ol"), pick(("comments",), ("comment", "list"), ("disqus",), ("reader", "comments"))))
            for _ in range(int(draw.integers(1, 6)) if draw.random() < 0.9 else int(draw.integers(10, 40))):
                add((*comments, pick(("div", ("comment",)), ("li", ("comment",)), ("article", ("comment",))), ("p", ())), 0, 3, 60, own=2)
        elif kind == 3:
            add((*base, ("form", ()), (pick("button", "label", "select", "div"), ())), 0, 1, 12)
        else:
            for _ in range(int(draw.integers(1, 4))):
                add(pick(box, (*box, ("p", ())), (*box, ("div", ())), (*box, ("li", ()))), 0, 1, 50, pick(0.0, 0.0, 1.0))

    for _ in range(0 if bare else int(draw.integers(0, 4))):
        furniture((*top, *wrap))
    body = (*top, *wrap, *pick((("article", ()),), (("main", ()),), (("main", ()), ("article", ())), (("article", ("post",)),), (("div", ("content",)),), (("div", ("article", "body")),), (("div", ("entry", "content")),), (("div", ("post", "text")),)))
    if draw.random() < (0.4 if bare else 0.75):
        add((*body, (pick("h1", "h2"), ())), 1, 2, 14)
    longest = pick(120, 120, 120, 60, 12)
    for _ in range(int(draw.integers(1, 14)) if draw.random() < 0.9 else int(draw.integers(20, 80))):
        add((*body, *pick(*[(("p", ()),)] * 6, (("ul", ()), ("li", ())), (("blockquote", ()), ("p", ())), (("pre", ()),), (("h2", ()),), (("h3", ()),), (("table", ()), ("tr", ()), ("td", ())), (("div", ()),), (("section", ()), ("p", ())), (("figure", ()), ("figcaption", ())))), 1, 1, longest, pick(0.0, 0.0, 0.0, 0.2))
        if draw.random() < 0.08 and not bare:
            furniture(body)
    for _ in range(0 if bare else int(draw.integers(0, 4))):
        furniture(pick((*top, *wrap), (*top, *wrap), body))
    if draw.random() < 0.8 and not bare:
        add((*top, *wrap, *pick((("footer", ()),), (("div", ("footer",)),))), 0, 1, 30)
    return out, labels


def page_lesson(page: str, featurizer: Featurizer) -> tuple[list[tuple[np.ndarray, list[int]]], list[str]]:
    """What one page teaches: runs of blocks with their labels, if its markup gives any, and words; bounded for a page of any length."""
    found = blocks(page)
    words = [w[:40] for b in found for w in b.text.split()[:50]][:TRAIN_WORDS]
    labels = markup_labels(found)
    if not labels:
        return [], words
    rows, starts = featurizer.page(found), range(0, len(found), TRAIN_BLOCKS)
    chosen = sorted({starts[i * (len(starts) - 1) // max(1, TRAIN_RUNS - 1)] for i in range(TRAIN_RUNS)})  # the first, the last, and between
    return [(rows[k : k + TRAIN_BLOCKS], labels[k : k + TRAIN_BLOCKS]) for k in chosen], words


def fit_labeller(lessons: list[tuple[list[tuple[np.ndarray, list[int]]], list[str]]], rounds: int = 1400, size: int = 24, rate: float = 0.01, seed: int = 11) -> BlockLabeller:
    """Train on the lessons of pages and on random layouts of their words; deterministic for a seed."""
    draw, featurizer, model = np.random.default_rng(seed), Featurizer(), BlockLabeller.fresh()
    cases = [case for taught, _ in lessons for case in taught] * TAUGHT_TIMES
    words = [w for _, said in lessons for w in said]
    for _ in range(LAID_OUT):
        found, labels = lay_out(words or ["word"], draw)
        cases.append((featurizer.page(found), labels))
    first, second = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
    cases.sort(key=lambda c: len(c[1]))
    for step in range(1, rounds + 1):
        start = int(draw.integers(-size // 2, len(cases) - size // 2))  # cases of like length together
        chosen = cases[max(0, start) : max(1, start + size)]
        x, mask = _padded([c[0] for c in chosen])
        gold = np.zeros(mask.shape, dtype=np.float32)
        for k, (_, labels) in enumerate(chosen):
            gold[: len(labels), k] = labels
        pace = rate * (1 - 0.9 * step / rounds)
        for k, g in model.gradients(x, mask, gold).items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            model.w[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def learn_blocks(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> BlockLabeller:
    """Fit on at most ``SAMPLE_PAGES`` pages, chosen by a hash of the id.

    Of pages that share an id the least counts.  The tasks that hold the pages make
    the features; the driver gets those of at most ``TRAIN_RUNS * TRAIN_BLOCKS``
    blocks and ``TRAIN_WORDS`` words of a page, never the page.
    """

    def run(batches):
        featurizer = Featurizer()
        for batch in batches:
            rows = []
            for i, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                taught, words = page_lesson(page.as_py(), featurizer)
                rows.append((i, [x.ravel() for x, _ in taught], [y for _, y in taught], words))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (batch.schema.field(0).type, pa.list_(pa.list_(pa.float32())), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "features", "labels", "words"])

    rows = df.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where("length(html) > 0")
    chosen = hash_sample(rows.select("id"), SAMPLE_PAGES)
    pages = rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("html").alias("html"))
    kind = pages.schema["id"].dataType.simpleString()
    taught = pages.mapInArrow(run, f"id {kind}, features array<array<float>>, labels array<array<int>>, words array<string>").toArrow().to_pylist()
    taught.sort(key=lambda r: r["id"])
    return fit_labeller([([(np.array(x, dtype=np.float32).reshape(-1, INPUTS), y) for x, y in zip(r["features"], r["labels"], strict=True)], r["words"]) for r in taught])


def extract_text(df: DataFrame, model: BlockLabeller, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``id``, the columns of ``keep``, ``text``, ``n_chars``, ``n_blocks`` and ``n_main`` for every row.

    ``text`` joins the main blocks in page order by one newline.  A null or empty
    page, and one without main text, has an empty text; null ids and repeated rows
    stay; an empty table gives an empty result; further columns are ignored.  Time
    and memory are in proportion to the page, also where elements nest by the
    hundred thousand.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches):
        featurizer = Featurizer()
        for batch in batches:
            pages = batch.column(batch.num_columns - 1)
            texts, total, main = [], [], []
            for at in range(0, len(pages), 256):
                found = [blocks(p) for p in pages[at : at + 256].to_pylist()]
                for b, p in zip(found, sent.value.label([featurizer.page(b) for b in found]), strict=True):
                    chosen = [x.text for x, q in zip(b, p, strict=True) if q >= 0.5]
                    texts.append("\n".join(chosen))
                    total.append(len(b))
                    main.append(len(chosen))
            made = [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(total, pa.int64()), pa.array(main, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "text", "n_chars", "n_blocks", "n_main"])

    picked = df.select(F.col(id_col), *keep, F.col(html_col).alias("__html"))
    shown = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{shown}, text string, n_chars long, n_blocks long, n_main long")
