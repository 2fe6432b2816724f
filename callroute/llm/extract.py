"""HTML extraction: the main text of a page by a tree-structured graphical model over its nodes.

Every element and text of a page is a node that is main text or not. What a
node looks like gives its own odds (a logistic regression on tag, class and
id words, and length); parents and children pull each other by learned
potentials. Messages go up the tree and down again (sum-product), which gives
exact marginals; texts of at least even odds are the main text.
"""

from __future__ import annotations

import html
import math
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .labelled_pages import PAGES

# Fixed values of HTML: elements without an end, with raw content, and those that end a line of text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg".split())
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea "
    "tfoot th thead title tr ul".split()
)
#: An element whose start ends an open one of these, up to an element of the second set.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_SHUTS_P = _BLOCK - {"br", "td", "th", "tr", "li", "dd", "dt", "body", "html", "head", "tbody", "thead", "tfoot", "option", "caption", "title", "button", "legend"}

# a quote opens a value only after the = of an attribute; any other is a sign like the rest, and the tag ends at the next >
_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)?+)?+)*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ROOT, _NODE_TEXT = "#root", "#text"
_KINDS = ("text", "inline", "block")


class Page:
    """Nodes of a page in order, parents before children: tag, parent, attributes or text."""

    def __init__(self, source: str):
        self.tag, self.parent, self.data = [_ROOT], [-1], [""]
        stack, at = [0], 0
        while at < len(source):
            m = _MARK.search(source, at)
            if m is None:
                self.text(source[at:], stack[-1])
                break
            if m.start() > at:
                self.text(source[at : m.start()], stack[-1])
            at = m.end()
            name = m[2] and m[2].lower()
            if not name:
                continue
            if m[1]:
                depth = len(stack) - 1
                while depth and self.tag[stack[depth]] != name:
                    depth -= 1
                if depth:
                    del stack[depth:]
                continue
            self.make_room(name, stack)
            node = self.add(name, stack[-1], m[3])
            closed = m[3].endswith("/")
            if name in _RAW and not (closed and name == "svg"):  # of these, only an svg can close itself
                end = _raw_end(name).search(source, at)
                at = end.end() if end else len(source)
            elif name not in _VOID and not closed:
                stack.append(node)

    def make_room(self, name: str, stack: list[int]) -> None:
        """End the open elements that an element of this name cannot be in."""
        tag = self.tag
        if name in _ENDS:
            shut, until = _ENDS[name]
            for depth in range(len(stack) - 1, 0, -1):
                if tag[stack[depth]] in until:
                    break
                if tag[stack[depth]] in shut:
                    del stack[depth:]
                    break
        elif name in _SHUTS_P:
            for depth in range(len(stack) - 1, 0, -1):
                if tag[stack[depth]] == "p":
                    del stack[depth:]
                    break
                if tag[stack[depth]] in _SHUTS_P:
                    break

    def add(self, tag: str, parent: int, data: str) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.data.append(data)
        return len(self.tag) - 1

    def text(self, raw: str, parent: int) -> None:
        if "&" in raw:
            raw = html.unescape(raw)
        self.add(_NODE_TEXT, parent, raw)


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*(?:>|\Z)", re.I)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}


def features(tag: str, raw: str, above: str, length: int) -> list[str]:
    """What a node's own odds are made of."""
    if tag == _NODE_TEXT:
        return [f"text in {above}", f"length {min(8, length.bit_length())}"]
    out = []
    if raw and "=" in raw:
        a = _attributes(raw)
        for word in {w.lower() for k in ("class", "id", "role") for w in _WORD.findall(a.get(k, ""))}:
            out += [f"word {word}", f"stem {word[:5]}"] if len(word) > 5 else [f"word {word}"]
    return out


def _kind(tag: str) -> int:
    return 0 if tag == _NODE_TEXT else 2 if tag in _BLOCK else 1


def _sort(tag: str, named: bool) -> str:
    """What has a chance of its own: a text, a tag, and a tag with class or id words."""
    return f"{tag}." if named and tag != _NODE_TEXT else tag


class Model:
    """Weights of a node's features; by tag, the chance of main text under a parent that is none or is."""

    def __init__(self, weights: dict[str, float], chances: dict[str, tuple[float, float]], root: float):
        self.weights, self.chances, self.root = weights, chances, root
        self.own: dict[tuple, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"own": {}}

    def node(self, tag: str, raw: str, above: str, length: int) -> tuple[float, float, float]:
        """Own odds of a node, and its chances under a parent that is no main text and one that is."""
        key = (tag, raw) if tag != _NODE_TEXT else (tag, above, min(8, length.bit_length()))
        found = self.own.get(key)
        if found is None:
            own = features(tag, raw, above, length)
            chance = self.chances.get(_sort(tag, bool(own))) or self.chances.get(tag) or self.chances[_KINDS[_kind(tag)]]
            found = (sum(self.weights.get(f, 0.0) for f in own), *chance)
            if len(self.own) < 50_000:
                self.own[key] = found
        return found

    def marginals(self, page: Page) -> list[float]:
        """Log odds of every node, all messages of the tree taken in."""
        n, tag, parent = len(page.tag), page.tag, page.parent
        belief = [0.0] * n
        belief[0] = self.root
        chance = [(0.0, 0.0)] * n
        for i in range(1, n):
            belief[i], *chance[i] = self.node(tag[i], page.data[i], tag[parent[i]], len(page.data[i].strip()) if tag[i] == _NODE_TEXT else 0)
        sent = [0.0] * n
        exp, log = math.exp, math.log
        for i in range(n - 1, 0, -1):  # up: children before parents
            under0, under1 = chance[i]
            e = exp(min(30.0, max(-30.0, belief[i])))
            sent[i] = log((1 - under1 + under1 * e) / (1 - under0 + under0 * e))
            belief[parent[i]] += sent[i]
        for i in range(1, n):  # down: parents before children
            under0, under1 = chance[i]
            e = exp(min(30.0, max(-30.0, belief[parent[i]] - sent[i])))
            belief[i] += log((under0 + under1 * e) / (1 - under0 + (1 - under1) * e))
        return belief

    def extract(self, source: str) -> str:
        page = Page(source)
        belief = self.marginals(page)
        blocks, line = [], []
        chain: list[int] = []
        for i in range(1, len(page.tag)):
            tag = page.tag[i]
            # an element that has ended since the last node: did its end or this start break the line?
            above = page.parent[i]
            while chain and chain[-1] != above:
                if page.tag[chain.pop()] in _BLOCK:
                    blocks.append("".join(line))
                    line = []
            if tag == _NODE_TEXT:
                if belief[i] >= 0:
                    line.append(page.data[i])
                continue
            if tag in _BLOCK:
                blocks.append("".join(line))
                line = []
            chain.append(i)
        blocks.append("".join(line))
        return " ".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def train(labelled: list[str], rounds: int = 400, rate: float = 1.0, ridge: float = 0.003, doubt: float = 0.4) -> Model:
    """Fit the model to labelled pages (see ``labelled_pages``).

    Chances are counted by tag, leaning by ``doubt`` on those of the tag's
    kind; the weights say how a node's looks change the chance it has by its
    tag and its parent. A page that begins with ``<!--main-->`` is main text
    at its root.
    """
    rows, labels, given = [], [], []
    counts = {k: np.full((2, 2), 0.02) for k in _KINDS}
    for source in labelled:
        page = Page(source)
        label = [int(source.startswith("<!--main-->"))] + [0] * (len(page.tag) - 1)
        for i in range(1, len(page.tag)):
            own = _attributes(page.data[i]) if page.tag[i] != _NODE_TEXT else {}
            label[i] = 0 if "data-skip" in own else 1 if "data-main" in own else label[page.parent[i]]
            if page.tag[i] in _RAW:
                label[i] = 0
            raw = re.sub(r"\s*data-(main|skip)", "", page.data[i]) if own else page.data[i]
            rows.append(features(page.tag[i], raw, page.tag[page.parent[i]], len(raw.strip())))
            kind = _sort(page.tag[i], bool(rows[-1]))
            for name in (kind, _KINDS[_kind(page.tag[i])]):
                counts.setdefault(name, np.zeros((2, 2)))[label[page.parent[i]], label[i]] += 1
            labels.append(label[i])
            given.append((kind, label[page.parent[i]]))
    kinds = {k: counts[k][:, 1] / counts[k].sum(axis=1) for k in _KINDS}
    chances = {t: (c[:, 1] + doubt * kinds.get(t, kinds[_KINDS[_kind(t.rstrip("."))]])) / (c.sum(axis=1) + doubt) for t, c in counts.items()}
    names = sorted({f for r in rows for f in r})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [at[f] for f in r]] = 1
    prior = np.array([chances[t][p] for t, p in given])
    prior = np.log(prior / (1 - prior))
    y, w = np.array(labels), np.zeros(len(names))
    for _ in range(rounds):
        w -= rate * (x.T @ (1 / (1 + np.exp(-x @ w - prior)) - y) / len(y) * 8 + ridge * w)
    roots = sum(p.startswith("<!--main-->") for p in labelled)
    return Model(dict(zip(names, w.tolist(), strict=True)), {t: tuple(c.tolist()) for t, c in chances.items()}, math.log((roots + 0.5) / (len(labelled) - roots + 0.5)))


def _extract(model: Model, names: list[str]):
    def run(batches):
        for batch in batches:
            texts = [model.extract(t.as_py()) for t in common.texts_of(batch, "_html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, "_text"])

    return run


def main_text(pages: DataFrame, source: str = "html", keep: list[str] | None = None, labelled: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (by default all but the source) and ``_text``, the main text of every row.

    Character references are decoded; white space in a block becomes one
    space, blocks are joined by one space. Null or empty html, and a page
    without main text, give an empty text. Broken markup is read as far as it
    goes; depth and length have no limit but memory. Every row, repeated ones
    too, is worked on its own. Columns ``_text`` and ``_html`` clash and are
    refused.
    """
    common.ship(pages.sparkSession)
    names = keep or [c for c in pages.columns if c != source]
    if clash := {"_text", "_html"} & set(names):
        raise ValueError(f"reserved column names: {sorted(clash)}")
    kept = pages.select(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    rows = pages.select(*names, F.col(source).alias("_html"))
    return rows.mapInArrow(_extract(train(labelled or PAGES), names), f"{fields}, _text string")
