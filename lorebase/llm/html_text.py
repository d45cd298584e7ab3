"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks. A classifier, learned from pages whose markup names the article, gives each block a
capacity to one of two terminals; neighbouring blocks, and blocks with the containers around them, are tied by
smoothness edges. A minimum cut, found by maximum flow, parts content from boilerplate.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import map_rows, settle

SCHEMA = "page_id bigint, url string, text string, n_chars bigint"

# Names of HTML elements, as the HTML standard has them.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th"
    " thead tr ul".split()
)
RAW_TAGS = frozenset("script style noscript template textarea select button option svg iframe object canvas audio video title".split())
#: Of these everything up to the end tag, or the page's end, is no markup.
OPAQUE_TAGS = frozenset("script style textarea title".split())
LIST_TAGS = frozenset("ul ol menu dl table".split())
#: An opening tag of the key ends an open element named in the value.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
FRAMES = frozenset("article main body".split())  # an end tag of another element does not reach out of these
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figcaption".split())
ITEM_TAGS = frozenset("li dt dd td th".split())

# Elements, and words in class, id and role, that tell of what stands beside the text or of the text.
OUTSIDE_TAGS = frozenset("nav aside footer form menu dialog search dir".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion promoted banner nav navbar navigation"
    " menu menubar breadcrumb breadcrumbs sidebar footer masthead topbar toolbar cookie cookies consent gdpr notice notices"
    " notification alert popup modal overlay comment comments commentlist reply replies respond disqus discussion share sharing"
    " social related recommended recommendations newsletter subscribe subscription signup login search pagination pager widget"
    " widgets tags skip contentinfo complementary dialog copyright legal disclaimer".split()
)
INSIDE_WORDS = frozenset("article content entry post story maincontent articlebody main body text".split())
#: Words that turn a name into one for the layout around, as in has-sidebar or sidebar-wrap.
LAYOUT_WORDS = frozenset("no has with without is not open closed on off wrap wrapper layout container page above below left right".split())

_NEXT = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|$)""", re.I)
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Characters within which a tag's quoted attributes are followed, and within which they are once MANY tags of a page
#: did not end there; then, and in longer tags, the next > ends the tag.
_TAG_END, _SHORT_TAG_END, MANY = 16_384, 256, 100
_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass
class Node:
    """A container element: what its own name and attributes say."""

    tag: str
    parent: int
    outside: float = 0.0  # how much they speak for boilerplate, from 0 to 1
    inside: float = 0.0  # and for content
    hidden: bool = False
    article: bool = False  # whether it is, or lies in, an article or main element
    group: int = -1  # the list or table that it is, or lies in


@dataclass
class Block:
    parent: int
    pieces: list[str] = field(default_factory=list)
    size: int = 0  # characters
    linked: int = 0  # of them within links


#: What a block's capacity is made of; see `Model`.
FEATURES = ("length", "links", "sentence", "rights", "text element", "list item", "outside names", "inside names")


@dataclass(frozen=True)
class Model:
    """Weights in nats of FEATURES and, last, the constant; weight of an article element; smoothness weights.

    The weights here are what is believed before pages are seen; `fit` moves them. The article element's weight is not
    learned, as it names the pages that are learned from.
    """

    weights: tuple[float, ...] = (0.8, -4.0, 0.6, -2.0, 0.6, -0.4, -4.0, 1.0, -0.9)
    article: float = 2.5
    side: float = 1.2  # between neighbouring blocks with the same parent or grandparent
    step: float = 0.6  # between neighbouring blocks elsewhere
    up: float = 0.8  # between a block and its container
    above: float = 0.4  # between a container and the one around it
    contrast: float = 1.5  # how fast edges weaken where the names of the two sides' containers differ


def _names(attrs: str) -> tuple[float, float, bool]:
    """What class, id and role say for boilerplate and for content, and whether the element is hidden."""
    outside = inside = 0.0
    hidden = False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.strip().lower() == "true"
        elif name == "style":
            hidden |= _HIDING.search(value) is not None
        else:
            for token in value.split()[:50]:
                words = _WORD.findall(_CAMEL.sub(" ", token).lower())
                if any(w in OUTSIDE_WORDS for w in words):
                    outside = max(outside, 0.25 if any(w in LAYOUT_WORDS for w in words) else 1.0)
                elif any(w in INSIDE_WORDS for w in words):
                    inside = 1.0
    return outside, inside, hidden


class Parser:
    """Containers and text blocks of a page, in page order, in one pass.

    Unclosed and misnested elements are taken as browsers mostly do. Every step takes constant time on average: open
    elements are found by name, and what is known to be missing in the rest of the page is not searched again.
    """

    def __init__(self, page: str):
        self.page, self.nodes, self.blocks = page, [Node("", -1)], []
        self.stack, self.open = [0], {}  # open containers, and by tag their places in the stack
        self.current: Block | None = None
        self.in_link = False
        self.lower: str | None = None
        self.missing: set[str] = set()
        self._run()

    def _add(self, raw: str) -> None:
        if not raw or (self.current is None and raw.isspace()):
            return
        if self.current is None:
            self.current = Block(self.stack[-1])
            self.blocks.append(self.current)
        text = html.unescape(raw) if "&" in raw else raw
        self.current.pieces.append(text)
        self.current.size += len(text)
        if self.in_link:
            self.current.linked += len(text)

    def _run(self) -> None:
        page, at, text, n = self.page, 0, 0, len(self.page)
        last, unclosed = page.rfind(">"), 0
        while (m := _NEXT.search(page, at)) is not None:
            start = m.start()
            if m[0] == "<!--":
                self._add(page[text:start])
                end = page.find("-->", start + 2) if "-->" not in self.missing else -1
                if end < 0:
                    self.missing.add("-->")
                    text = n  # a comment that never ends
                    break
                at = text = end + 3
                continue
            if start > last:
                break  # no tag ends after this: text
            if m[0] in ("<!", "<?"):
                end = page.find(">", start) + 1
            else:
                q = _QUOTED.match(page, start + 1, min(n, start + (_TAG_END if unclosed < MANY else _SHORT_TAG_END)))
                unclosed += q is None
                end = q.end() if q else page.find(">", start) + 1
            self._add(page[text:start])
            at = text = end
            if m[0] not in ("<!", "<?"):
                at = text = self._tag(start, end)
        self._add(page[text:])

    def _tag(self, start: int, end: int) -> int:
        """Take the tag of page[start:end]; where the text after it begins."""
        closing = self.page[start + 1] == "/"
        name = _NAME.match(self.page, start + 1 + closing, end)[0]
        tag, attrs = name.lower(), self.page[start + 1 + closing + len(name) : end - 1]
        if tag in RAW_TAGS:
            self._add(" ")
            return end if closing or (attrs.endswith("/") and tag not in OPAQUE_TAGS) else self._skip(tag, end)
        if tag == "a":
            self.in_link = not closing
        elif tag == "br":
            self._add(" ")
        elif tag in BLOCK_TAGS:
            self.current = None
            if closing:
                self._close(tag)
            elif tag != "hr":
                self._open(tag, attrs)
        return end

    def _skip(self, tag: str, at: int) -> int:
        """Where the element's end tag ends; without one, the page's end for an opaque element, else here."""
        if tag not in self.missing:
            if self.lower is None:
                self.lower = self.page.translate(_LOWER)
            end = self.lower.find(f"</{tag}", at)
            end = self.page.find(">", end) if end >= 0 else -1
            if end >= 0:
                return end + 1
            self.missing.add(tag)
        return len(self.page) if tag in OPAQUE_TAGS else at

    def _pop(self, place: int) -> None:
        """Close the containers from a place of the stack on."""
        for k in self.stack[place:]:
            self.open[self.nodes[k].tag].pop()
        del self.stack[place:]

    def _innermost(self, tags) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def _close(self, tag: str) -> None:
        place = self._innermost((tag,))
        if place and (tag in FRAMES or tag == "html" or place > self._innermost(FRAMES)):
            self._pop(place)
            self.in_link = False

    def _open(self, tag: str, attrs: str) -> None:
        if self.nodes[self.stack[-1]].tag == "p":
            self._pop(len(self.stack) - 1)
        if tag in CLOSES and (place := self._innermost(CLOSES[tag])) > self._innermost(LIST_TAGS):
            first = min(self.open[t][-1] for t in CLOSES[tag] if self.open.get(t) and self.open[t][-1] > self._innermost(LIST_TAGS)) if tag == "tr" else place
            self._pop(first)
        around = self.nodes[self.stack[-1]]
        node = Node(tag, self.stack[-1], article=around.article, group=around.group)
        if attrs.strip() and tag not in ("html", "body"):
            node.outside, node.inside, node.hidden = _names(attrs)
        if tag in OUTSIDE_TAGS or (tag == "header" and not around.article):
            node.outside = 1.0
        node.article |= tag in ("article", "main")
        self.nodes.append(node)
        if tag in LIST_TAGS:
            node.group = len(self.nodes) - 1
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(len(self.nodes) - 1)


def text_of(block: Block) -> str:
    """The block's text, every run of white space one space, trimmed."""
    return " ".join("".join(block.pieces).split())


@dataclass
class Page:
    """A page's blocks that hold text, with what their surroundings say of each."""

    nodes: list[Node]
    blocks: list[Block]
    texts: list[str]
    outside: list[float]  # of each container, its own and its ancestors' names together, 2 at most
    features: list[tuple[int, ...]]  # of each block, in whole steps, so that there are few different ones

    @classmethod
    def read(cls, page: str) -> Page:
        parsed = Parser(page)
        nodes = parsed.nodes
        kept = [(b, t) for b in parsed.blocks if (t := text_of(b))]
        blocks, texts = [b for b, _ in kept], [t for _, t in kept]
        words = [t.count(" ") + 1 for t in texts]
        links = [min(1.0, b.linked / max(1, b.size)) for b in blocks]
        plain = [round(w * (1 - x)) for w, x in zip(words, links, strict=True)]
        weigh_frames(plain, texts, blocks, nodes)
        outside, inside, listed = [0.0] * len(nodes), [0.0] * len(nodes), [0] * len(nodes)
        for k in range(1, len(nodes)):
            x = nodes[k]
            outside[k] = min(2.0, outside[x.parent] + x.outside + 2.0 * x.hidden)
            inside[k] = max(inside[x.parent], x.inside)
        for b, w in zip(blocks, plain, strict=True):
            if nodes[b.parent].group >= 0:
                listed[nodes[b.parent].group] += w
        found = []
        for b, t, w, x in zip(blocks, texts, plain, links, strict=True):
            node = nodes[b.parent]
            item = node.tag in ITEM_TAGS and node.group >= 0
            length = max(w, listed[node.group]) if item else w  # of an item that of the whole list
            rights = "©" in t or "all rights reserved" in t.lower()
            last = t[-1] in ".!?:\"”»…"
            found.append((min(6, (1 + length).bit_length() - 1), round(4 * x), int(last), int(rights), int(node.tag in TEXT_TAGS), int(item), round(4 * outside[b.parent]), round(inside[b.parent])))
        return cls(nodes, blocks, texts, outside, found)


STEPS = np.array([0.5, 0.25, 1, 1, 1, 1, 0.25, 1])  # what one step of each feature counts


def weigh_frames(plain: list[int], texts: list[str], blocks: list[Block], nodes: list[Node], most: float = 0.1, least: int = 15) -> None:
    """Weaken what speaks against containers that frame the page's text, as a form or a div.has-sidebar around it.

    Words outside links count, in blocks of some length. A container with over half of the page's is judged by what
    there is beside it, in no other such container: where that is under `most` of its own words, what speaks against
    it shrinks in proportion, to none if nothing else is there. Hidden elements and navs are never frames.
    """
    own, free = [0] * len(nodes), [0] * len(nodes)
    for b, t, w in zip(blocks, texts, plain, strict=True):
        if w > 3 or (w > 1 and t[-1] in ".!?"):
            own[b.parent] += w
            free[b.parent] += w
    for k in range(len(nodes) - 1, 0, -1):
        own[nodes[k].parent] += own[k]
        if not nodes[k].outside and not nodes[k].hidden:
            free[nodes[k].parent] += free[k]
    around = [free[0]] * len(nodes)  # the most that is free in a judged container around a node
    for k in range(1, len(nodes)):
        x = nodes[k]
        beside = around[x.parent]
        against = x.outside > 0 or x.hidden
        around[k] = max(beside, free[k]) if against else beside
        if against and not x.hidden and x.tag != "nav" and own[k] >= least and 2 * own[k] > own[0]:
            x.outside *= min(1.0, beside / (most * own[k]))


def smoothness(page: Page, model: Model) -> list[tuple[int, int, float]]:
    """Edges between blocks (numbered from 0) and containers (numbered on from the blocks)."""
    blocks, nodes, n = page.blocks, page.nodes, len(page.blocks)
    edges = []
    for i in range(n - 1):
        a, b = blocks[i].parent, blocks[i + 1].parent
        near = a == b or nodes[a].parent == nodes[b].parent
        unlike = abs(page.outside[a] - page.outside[b])
        edges.append((i, i + 1, (model.side if near else model.step) * math.exp(-model.contrast * unlike)))
    edges += [(i, n + b.parent, model.up) for i, b in enumerate(blocks)]
    for k in range(1, len(nodes)):
        p = nodes[k].parent
        edges.append((n + k, n + p, model.above * math.exp(-model.contrast * (page.outside[k] - page.outside[p]))))
    return edges


def minimum_cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it lies on the source's side of a minimum cut.

    score > 0 is a capacity from the source, < 0 one to the sink. A node whose own capacity is no less than all
    its edges together lies on that side of some minimum cut, so it is settled first and its edges become
    capacities of its neighbours. Maximum flow, by blocking flows over layers, decides the nodes that remain.
    """
    n, unit = len(score), 1 << 20
    own = [round(s * unit) for s in score]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            near[a][b] = near[b][a] = near[a].get(b, 0) + round(w * unit)
    rest = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        v = todo.popleft()
        if side[v] is None and abs(own[v]) >= rest[v]:
            side[v] = own[v] > 0
            for u, w in near[v].items():
                if side[u] is None:
                    own[u] += w if side[v] else -w
                    rest[u] -= w
                    todo.append(u)
    free = [v for v in range(n) if side[v] is None]
    if free:
        reached = _flow({v: {u: w for u, w in near[v].items() if side[u] is None} for v in free}, own)
        for v in free:
            side[v] = v in reached
    return [bool(s) for s in side]


def _flow(left: dict[int, dict[int, int]], own: list[int]) -> set[int]:
    """Nodes that the source still reaches when the flow is maximal. left: remaining capacities, changed here.

    own > 0 comes from the source, own < 0 goes to the sink; both are kept in `excess` and `need`.
    """
    excess, need = {v: own[v] for v in left if own[v] > 0}, {v: -own[v] for v in left if own[v] < 0}
    while True:
        layer, todo = dict.fromkeys(excess, 0), deque(excess)
        while todo:
            v = todo.popleft()
            for u, w in left[v].items():
                if w and u not in layer:
                    layer[u] = layer[v] + 1
                    todo.append(u)
        if not any(v in layer for v in need):
            return set(layer)
        ways, tried = {v: list(left[v]) for v in layer}, dict.fromkeys(layer, 0)
        for start in list(excess):
            path = [start]
            while path:
                v = path[-1]
                if v in need:
                    some = min(excess[start], need[v], *(left[a][b] for a, b in zip(path, path[1:])))
                    for a, b in zip(path, path[1:]):
                        left[a][b] -= some
                        left[b][a] += some
                    excess[start] -= some
                    need[v] -= some
                    if not need[v]:
                        del need[v]
                    if not excess[start]:
                        del excess[start]
                        break
                    full = next((i for i, (a, b) in enumerate(zip(path, path[1:])) if not left[a][b]), len(path))
                    del path[full + 1 :]
                    continue
                while tried[v] < len(ways[v]):
                    u = ways[v][tried[v]]
                    if left[v][u] and layer.get(u) == layer[v] + 1:
                        path.append(u)
                        break
                    tried[v] += 1
                else:
                    path.pop()
                    if path:
                        tried[path[-1]] += 1


def costs(page: Page, model: Model) -> list[float]:
    """Evidence in nats that a block is content; below zero, that it is boilerplate."""
    w = STEPS * model.weights[:-1]
    logits = np.array(page.features, dtype=float).reshape(-1, len(FEATURES)) @ w + model.weights[-1]
    return [float(x) + model.article * page.nodes[b.parent].article for x, b in zip(logits, page.blocks, strict=True)]


def label(page: Page, model: Model) -> list[bool]:
    """Whether each block is content."""
    return minimum_cut(costs(page, model) + [0.0] * len(page.nodes), smoothness(page, model))[: len(page.blocks)]


def main_text(page: str | None, model: Model = Model()) -> str:
    """The page's main text; empty if there is none."""
    if not page:
        return ""
    read = Page.read(page)
    return " ".join(t for t, c in zip(read.texts, label(read, model), strict=True) if c)


def taught(page: str | None) -> Iterator[tuple[int, ...]]:
    """Features and label of each block of a page that has an article or main element: whether it lies in it.

    The article's own parts named for boilerplate are none of its content. Pages without such an element give nothing.
    """
    read = Page.read(page or "")
    if any(x.article for x in read.nodes):
        for b, x in zip(read.blocks, read.features, strict=True):
            yield (*x, int(read.nodes[b.parent].article and read.outside[b.parent] < 0.5))


def fit(pages: DataFrame, most: int = 1000, trust: float = 0.02) -> Model:
    """Learn the blocks' costs from at most `most` pages, those whose ids hash lowest, as far as their markup labels them.

    Labels are what the pages themselves say: what lies in an article or main element is content, what lies outside
    is not. What comes to the driver is how often each combination of the features' few steps was seen under each
    label, so no more than there are combinations. `trust` is how strongly the weights of `Model`, believed
    beforehand, hold against what is seen; without labelled pages they stay as they are.
    """
    ids = pages.select("page_id").filter("page_id IS NOT NULL").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most)
    sample = pages.select("page_id", "html").join(F.broadcast(settle(ids, "page-ids")), "page_id")  # at most `most` ids
    one = sample.groupBy("page_id").agg(F.min_by("html", F.struct(F.xxhash64("html"), "html")).alias("html"))
    names = [f"x{i}" for i in range(len(FEATURES))] + ["content"]

    def start():
        def work(bodies):
            rows = [x for b in bodies for x in taught(b)]
            return list(zip(*rows)) if rows else [[] for _ in names]

        return work

    seen = map_rows(one.select("html"), ", ".join(f"{n} int" for n in names), start).groupBy(*names).count().orderBy(*names).collect()
    believed = Model()
    if len({r.content for r in seen}) < 2:
        return believed
    x, y, n = np.array([tuple(r)[:-2] for r in seen]) * STEPS, np.array([float(r.content) for r in seen]), np.array([float(r["count"]) for r in seen])
    return Model(weights=tuple(weighted_logistic(x, y, n, np.array(believed.weights), trust * n.sum())))


def weighted_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, believed: np.ndarray, hold: float, rounds: int = 50) -> list[float]:
    """Weights, the last one the constant, that fit rows counted n times, drawn towards `believed` with strength `hold`."""
    x, w = np.hstack([x, np.ones((len(x), 1))]), believed.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gram = (x * (n * p * (1 - p))[:, None]).T @ x + hold * np.eye(len(w))
        step = np.linalg.solve(gram, x.T @ (n * (y - p)) - hold * (w - believed))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """A row for each page: page_id, url, text, n_chars (code points of the text). Without a model it is learned from the pages.

    Null html counts as empty and gives an empty text. Null ids and urls stay null, repeated rows give repeated
    rows, an empty table an empty one; other columns are ignored. One pass without a shuffle, after the fit.
    """
    model = fit(pages) if model is None else model

    def start():
        def work(ids, urls, bodies):
            texts = [main_text(b, model) for b in bodies]
            return ids, urls, texts, [len(t) for t in texts]

        return work

    return map_rows(pages.select("page_id", "url", "html"), SCHEMA, start)
