"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded from the root down."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed template".split())
#: Elements that stay inside a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var img br wbr".split())
#: What a start tag ends first: the open elements of the first set, looked for up to one of the second.
P_ENDERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
IMPLIED = {
    name: (frozenset(ends.split()), frozenset(until.split()))
    for name, ends, until in (("li", "li", "ul ol menu"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("tr", "tr td th", "table"), ("td", "td th", "tr table"), ("th", "td th", "tr table"), ("option", "option", "select"))
}
SCOPE = frozenset("html body article section div main td th table button".split())
P_ALONE, PAGE, INLINE_ENDS = frozenset(("p",)), frozenset(("html", "body")), P_ENDERS | SCOPE
SKIPPED = frozenset("script style noscript iframe template textarea xmp noembed head title".split())
COMMENT_END = re.compile("--!?>")
NAME = re.compile(r"[A-Za-z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTR = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TOKEN = re.compile(r"[a-z]+")
ATTR_IN_TAG = re.compile(r"\s(?:class|id)=(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+)")


@dataclass(slots=True)
class Node:
    tag: str
    attrs: str = ""
    parent: int = -1
    children: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)


class Scanner:
    """Cuts a page into markup from left to right; no part of the page is searched more than a few times."""

    def __init__(self, page: str):
        self.page = page
        self.quoted = True

    def end(self, at: int) -> int:
        """Where the ``>`` stands that ends a tag whose name ends at ``at``, outside quotation marks; -1 without one.

        A quotation mark that nothing closes is no quotation mark, and from there on none is heeded.
        """
        place = at
        while self.quoted:
            found = STOP.search(self.page, place)
            if not found:
                return -1
            if found.group() == ">":
                return found.start()
            place = self.page.find(found.group(), found.end()) + 1
            self.quoted = place > 0
        return self.page.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, closing, attributes) of the next markup; no name for comments and the like.

        What the page's end cuts off is markup up to the end, as for a browser. None if there is no more.
        """
        page = self.page
        while (start := page.find("<", at)) >= 0:
            sign = page[start + 1 : start + 2]
            if page.startswith("!--", start + 1):
                found = COMMENT_END.search(page, start + 4)
                return start, found.end() if found else len(page), "", False, ""
            closing = sign == "/"
            name = NAME.match(page, start + 1 + closing)
            if name:
                end = self.end(name.end())
                if end < 0:
                    return start, len(page), "", False, ""
                return start, end + 1, name.group().lower(), closing, page[name.end() : end]
            if sign in ("!", "?") or closing:
                end = page.find(">", start + 2)
                return start, end + 1 or len(page), "", False, ""
            at = start + 1
        return None


def parse(page: str) -> list[Node]:
    """The page's tree in document order; texts are nodes named #text, kept in their place among their siblings."""
    nodes = [Node("#root")]
    stack = [0]
    opened: dict[str, list[int]] = {}

    def put(tag: str, attrs: str = "") -> int:
        nodes.append(Node(tag, attrs, stack[-1]))
        nodes[stack[-1]].children.append(len(nodes) - 1)
        return len(nodes) - 1

    def add_text(text: str) -> None:
        if text:
            held = nodes[stack[-1]].children
            if held and nodes[held[-1]].tag == "#text":
                nodes[held[-1]].text.append(text)
            else:
                nodes[put("#text")].text.append(text)

    def close(names: frozenset[str], until: frozenset[str]) -> None:
        """Ends the innermost open element of ``names`` with all in it, unless one of ``until`` stands between."""
        depth = max((opened[n][-1] for n in names if opened.get(n)), default=0)
        if not depth or depth < len(stack) - 1 and max((opened[n][-1] for n in until if opened.get(n)), default=0) > depth:
            return
        while len(stack) > depth:
            opened[nodes[stack.pop()].tag].pop()

    scanner, at = Scanner(page), 0
    while found := scanner.next(at):
        start, end, name, closing, attrs = found
        add_text(page[at:start])
        at = end
        if not name:
            continue
        if closing:
            close(frozenset((name,)), INLINE_ENDS if name in INLINE else PAGE if name not in PAGE else frozenset())
            continue
        if name in P_ENDERS:
            close(P_ALONE, SCOPE)
        if name in IMPLIED:
            close(*IMPLIED[name])
        if name in RAW and name != "template":
            last = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            put(name, attrs)
            at = page.find(">", last.start()) + 1 or len(page) if last else len(page)
            continue
        node = put(name, attrs)
        if name not in VOID and not (attrs.rstrip().endswith("/") and name in ("svg", "path")):
            stack.append(node)
            opened.setdefault(name, []).append(len(stack) - 1)
    add_text(page[at:])
    return nodes


@dataclass(slots=True)
class Block:
    """A node of the decoded tree: an element that holds blocks, or a run of text (a leaf)."""

    tag: str
    parent: int
    tokens: frozenset[str]
    depth: int
    place: int
    text: str = ""
    links: int = 0
    tags: int = 0
    children: list[int] = field(default_factory=list)


def blocks(nodes: list[Node]) -> list[Block]:
    """Block elements in page order, with each run of inline content as a leaf; scripts, styles and the head are left out."""
    inline_only: dict[int, bool] = {}
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        inline_only[i] = node.tag == "#text" or (node.tag in INLINE and all(inline_only[c] for c in node.children))
    out = [Block("#root", -1, frozenset(), 0, 0)]
    # Depth first, without recursion: pages may nest deeply.
    runs: dict[int, list[str]] = {}
    todo: list[tuple[int, int, bool]] = [(c, 0, False) for c in reversed(nodes[0].children)]

    def flush(owner: int) -> None:
        run = runs.pop(owner, None)
        if run is None:
            return
        text = " ".join(html.unescape("".join(run[0])).split())
        if text:
            out.append(Block("#text", owner, out[owner].tokens, out[owner].depth + 1, len(out[owner].children), text, min(run[1], len(text)), run[2]))
            out[owner].children.append(len(out) - 1)

    def gather(i: int, run: list, linked: bool) -> None:
        stack = [(i, linked)]
        while stack:
            j, inside = stack.pop()
            node = nodes[j]
            if node.tag == "#text":
                piece = "".join(node.text)
                run[0].append(piece)
                if inside:
                    run[1] += len(piece.strip())
            elif node.tag in ("br", "wbr", "img"):
                run[0].append(" " if node.tag != "wbr" else "")
                run[2] += 1
            else:
                run[2] += 1
                stack += [(c, inside or node.tag == "a") for c in reversed(node.children)]

    while todo:
        i, owner, leave = todo.pop()
        if leave:
            flush(owner)
            continue
        node = nodes[i]
        if node.tag in SKIPPED:
            flush(owner)
            continue
        if inline_only[i]:
            gather(i, runs.setdefault(owner, [[], 0, 0]), False)
            continue
        flush(owner)
        tokens = frozenset(t for m in ATTR.finditer(node.attrs) for t in TOKEN.findall((m.group(2) or m.group(3) or m.group(4) or "").lower())) if node.attrs else frozenset()
        out.append(Block(node.tag, owner, tokens, out[owner].depth + 1, len(out[owner].children)))
        own = len(out) - 1
        out[owner].children.append(own)
        todo.append((i, own, True))
        todo += [(c, own, False) for c in reversed(node.children)]
    flush(0)
    return out


GOOD = frozenset("article content main post entry story body text blog page news prose document".split())
BAD = {
    "nav": "nav menu navbar breadcrumb breadcrumbs navigation pagination pager toc topbar",
    "foot": "footer foot copyright bottom colophon legal",
    "head": "header banner masthead top logo site",
    "side": "sidebar side aside widget rail related recommended popular trending more",
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo promotion banner dfp adsense",
    "note": "cookie cookies consent notice gdpr popup modal alert newsletter subscribe signup overlay",
    "talk": "comment comments reply replies discussion disqus respond thread",
    "share": "share sharing social follow tags tag meta byline author",
    "form": "form search login contact",
}
TAGS = ("#text", "p", "div", "article", "main", "section", "nav", "header", "footer", "aside", "ul", "ol", "li", "form", "h1", "h2", "h3", "table", "td", "blockquote", "pre", "figure", "dl", "body", "button", "select", "fieldset")
BAD_SETS = [frozenset(v.split()) for v in BAD.values()]
TAG_PLACES = {t: k for k, t in enumerate(TAGS)}
BAD_TAGS = ("nav", "header", "footer", "aside", "form", "button", "select")


def features(tree: list[Block]) -> np.ndarray:
    """Of each block: its tag and tokens, those above it, depth, subtree size and density, and its siblings'."""
    n = len(tree)
    text, links, tags, leaves, stops = ([0.0] * n for _ in range(5))
    for i in range(n - 1, -1, -1):
        b = tree[i]
        if b.tag == "#text":
            text[i], links[i], tags[i], leaves[i] = len(b.text), b.links, b.tags, 1.0
            stops[i] = sum(map(b.text.count, ".,;!?"))
        tags[i] += 1
        p = b.parent
        if p >= 0:
            text[p] += text[i]
            links[p] += links[i]
            tags[p] += tags[i]
            leaves[p] += leaves[i]
            stops[p] += stops[i]
    kinds = 1 + len(BAD_SETS)
    x = np.zeros((n, 14 + len(TAGS) + 2 * kinds + len(BAD_TAGS) + 2), dtype=np.float32)
    parents, depth, place, count, before, after = ([0] * n for _ in range(6))
    at, up = 14 + len(TAGS), 14 + len(TAGS) + kinds
    marked = [False] * n
    for i, b in enumerate(tree):
        p = b.parent
        siblings = tree[p].children if p >= 0 else [0]
        parents[i], depth[i], place[i], count[i] = max(p, 0), b.depth, b.place, len(siblings)
        before[i] = siblings[b.place - 1] if b.place else i
        after[i] = siblings[b.place + 1] if b.place + 1 < len(siblings) else i
        if b.tag in TAG_PLACES:
            x[i, 14 + TAG_PLACES[b.tag]] = 1
        if p >= 0 and marked[p]:
            x[i, up:-1] = x[p, up:-1]
            marked[i] = True
        if b.tokens:
            own = [float(not b.tokens.isdisjoint(s)) for s in (GOOD, *BAD_SETS)]
            if any(own):
                x[i, at:up] = own
                x[i, up : up + kinds] = np.maximum(x[i, up : up + kinds], own)
                marked[i] = True
        if b.tag in BAD_TAGS:
            x[i, up + kinds + BAD_TAGS.index(b.tag)] = 1
            marked[i] = True
        elif b.tag in ("article", "main"):
            x[i, -2] = 1
            marked[i] = True
        x[i, -1] = p >= 0 and tree[p].tag == "body"
    t, c, own_place = np.array(text), np.array(count, dtype=float), np.arange(n)
    before, after = np.array(before), np.array(after)
    log = np.log1p(t)
    x[:, 0], x[:, 1], x[:, 2], x[:, 3], x[:, 4] = depth, c, place, place / c, log
    x[:, 5], x[:, 6], x[:, 7] = t / max(1.0, text[0]), t / np.maximum(1.0, t[parents]), links / np.maximum(1.0, t)
    x[:, 8], x[:, 9], x[:, 10] = t / (1 + np.array(tags)), t / np.maximum(1.0, leaves), stops / np.maximum(1.0, t)
    x[:, 11], x[:, 12], x[:, 13] = np.where(before == own_place, -1, log[before]), np.where(after == own_place, -1, log[after]), leaves
    return x


@dataclass
class Trees:
    """Boosted regression trees as arrays: node k splits feature[k] at cut[k], else holds value[k]."""

    start: float
    feature: list[np.ndarray]
    cut: list[np.ndarray]
    value: list[np.ndarray]
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.25, ridge: float = 1.0, bins: int = 24) -> Trees:
    """Gradient boosting of the logistic loss, with second-order gains over histograms (over sums for two-valued features)."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    edges = [np.array([(e[0] + c.max()) / 2]) if len(e) == 1 and c.max() > e[0] else np.array([(c.min() + c.max()) / 2]) if len(np.unique(c)) == 2 else e for e, c in zip(edges, x.T, strict=True)]
    wide = [f for f, e in enumerate(edges) if len(e) > 1]
    flags = [f for f, e in enumerate(edges) if len(e) == 1 and x[:, f].max() > e[0]]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in wide], axis=1)
    above = np.stack([x[:, f] > edges[f][0] for f in flags], axis=1).astype(np.float32)
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin = np.full(len(x), start)
    model = Trees(start, [], [], [], depth)
    cells = bins + 1
    flat = binned + np.arange(len(wide)) * cells
    worth = lambda g, h: g**2 / (h + ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        size = (1 << depth + 1) - 1
        feature, cut, value = np.zeros(size, dtype=np.int64), np.full(size, np.inf), np.zeros(size)
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            here = np.flatnonzero(node >= first)
            local = node[here] - first
            sums = np.stack([np.bincount(local, v[here], minlength=width) for v in (g, h)])
            cell = (flat[here] + local[:, None] * len(wide) * cells).ravel()
            left = np.stack([np.bincount(cell, np.repeat(v[here], len(wide)), minlength=width * len(wide) * cells) for v in (g, h)])
            left = left.reshape(2, width, len(wide), cells).cumsum(3)
            spread = np.zeros((len(x), 2 * width), dtype=np.float32)
            spread[here, local], spread[here, local + width] = g[here], h[here]
            right = (above.T @ spread).astype(float)
            for k in range(width):
                at = here[local == k]
                if len(at) < 20:
                    continue
                tg, th = sums[:, k]
                gain = worth(*left[:, k]) + worth(tg - left[0, k], th - left[1, k])
                flag_gain = worth(right[:, k], right[:, k + width]) + worth(tg - right[:, k], th - right[:, k + width])
                f, b = np.unravel_index(np.argmax(gain), gain.shape)
                least = worth(tg, th) + 1e-6
                if flag_gain.max(initial=-1.0) > gain[f, b]:
                    f = int(np.argmax(flag_gain))
                    if flag_gain[f] > least:
                        feature[first + k], cut[first + k] = flags[f], edges[flags[f]][0]
                        node[at] = 2 * (first + k) + 1 + (above[at, f] > 0)
                elif gain[f, b] > least and b < len(edges[wide[f]]):
                    feature[first + k], cut[first + k] = wide[f], edges[wide[f]][b]
                    node[at] = 2 * (first + k) + 1 + (binned[at, f] > b)
        # Rows that stop early go down the left side, where an infinite cut sends them when the tree is used.
        for _ in range(depth):
            early = node < (1 << depth) - 1
            node[early] = 2 * node[early] + 1
        sums = np.bincount(node, g, minlength=size), np.bincount(node, h, minlength=size)
        value = rate * sums[0] / (sums[1] + ridge)
        margin += value[node]
        model.feature.append(feature)
        model.cut.append(cut)
        model.value.append(value)
    return model


class PageMaker:
    """Labelled training pages of many layouts; words whose text starts with ``MAIN`` belong to the main text."""

    MAIN = "①"

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        parts = ["an", "be", "cor", "di", "el", "fu", "gra", "hi", "ing", "jo", "ka", "lu", "mon", "ne", "or", "pa", "qui", "ra", "ste", "tu", "ver", "wa", "xi", "yo", "za"]
        self.words = ["".join(self.rng.choice(parts, self.rng.integers(1, 4))) for _ in range(600)]

    def pick(self, *options: str) -> str:
        return options[self.rng.integers(len(options))]

    def say(self, low: int, high: int, main: bool) -> str:
        n = int(self.rng.integers(low, high + 1))
        words = [self.words[i] for i in self.rng.integers(0, len(self.words), n)]
        for i in range(n):
            if self.rng.random() < 0.12:
                words[i] += self.pick(".", ",", ".", "?", "!")
        if self.rng.random() < 0.8:
            words[-1] += "."
        return (self.MAIN if main else "") + " ".join(words)

    def links(self, low: int, high: int) -> str:
        return "".join(f'<li><a href="/x">{self.say(1, 3, False)}</a></li>' for _ in range(self.rng.integers(low, high + 1)))

    def boiler(self) -> str:
        """A block that is no main text; some have names that say nothing, or none."""
        made, r = self.named_boiler(), self.rng.random()
        if r < 0.1:
            return ATTR_IN_TAG.sub("", made)
        return ATTR_IN_TAG.sub(lambda m: f' class="{self.pick(*self.words[:200])}"', made) if r < 0.2 else made

    def named_boiler(self) -> str:
        kind = int(self.rng.integers(13))
        s = self.say
        if kind == 0:
            return f"<nav><ul>{self.links(3, 9)}</ul></nav>"
        if kind == 1:
            return f'<div class="{self.pick("menu", "navbar", "nav-links", "breadcrumbs")}"><ul>{self.links(2, 8)}</ul></div>'
        if kind == 2:
            return f'<header{self.pick("", " class=site-header", " id=top")}><a href="/">{s(1, 4, False)}</a>{self.pick("", f"<p>{s(3, 9, False)}</p>", f"<h1>{s(1, 4, False)}</h1>")}</header>'
        if kind == 3:
            return f"<footer>{self.pick('&copy; ', '')}{s(3, 25, False)}{self.pick('', f'<p>{s(4, 30, False)}</p>', f'<ul>{self.links(2, 6)}</ul>')}</footer>"
        if kind == 4:
            return f'<aside{self.pick("", " class=sidebar")}><h3>{s(1, 4, False)}</h3><p>{s(5, 40, False)}</p><ul>{self.links(0, 5)}</ul></aside>'
        if kind == 5:
            return f'<div class="{self.pick("sidebar", "widget", "related-posts", "popular")}"><h3>{s(1, 4, False)}</h3>{self.pick(f"<ul>{self.links(2, 8)}</ul>", f"<p>{s(5, 50, False)}</p>")}</div>'
        if kind in (6, 7):
            return f'<div class="{self.pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot")}">{self.pick(s(3, 40, False), f"<p>{s(5, 40, False)}</p>", f"<a href=/a>{s(3, 20, False)}</a>")}</div>'
        if kind == 8:
            return f'<div class="{self.pick("cookie-notice", "cookie-banner", "newsletter", "notice", "popup", "subscribe", "gdpr consent")}"><p>{s(6, 50, False)}</p>{self.pick("", "<button>" + s(1, 2, False) + "</button>")}</div>'
        if kind == 9:
            return f'<form action="/s"{self.pick("", " class=search", " id=login-form")}><label>{s(1, 4, False)}</label><input name=q>{self.pick("", f"<p>{s(4, 20, False)}</p>")}<button>{s(1, 2, False)}</button></form>'
        if kind == 10:
            inner = "".join(self.pick(f'<div class="comment"><b>{s(1, 2, False)}</b><p>{s(4, 60, False)}</p></div>', f'<li class="comment-body"><p>{s(4, 60, False)}</p></li>') for _ in range(self.rng.integers(1, 7)))
            return f'<{(t := self.pick("section", "div"))} {self.pick("id", "class")}="comments"><h3>{s(1, 3, False)}</h3>{inner}</{t}>'
        if kind == 11:
            return f'<div class="{self.pick("share", "social-links", "tags", "share-buttons")}">{self.pick(f"<ul>{self.links(2, 5)}</ul>", f"<a href=/t>{s(1, 2, False)}</a> <a href=/f>{s(1, 2, False)}</a>")}</div>'
        return f"<script>var t='{s(2, 8, False)}';</script><style>p{{margin:0}}</style>"

    def paragraph(self) -> str:
        s, r = self.say, self.rng.random()
        if r < 0.62:
            return f"<p>{s(1, 140, True)}{self.pick('</p>', '</p>', '')}"
        if r < 0.72:
            return f"<p><b>{s(1, 60, True)}<br><p>{s(1, 80, True)}</p>"
        if r < 0.80:
            return f"<{(h := self.pick('h2', 'h3'))}>{s(1, 9, True)}</{h}>"
        if r < 0.86:
            return "<ul>" + "".join(f"<li>{s(2, 25, True)}</li>" for _ in range(self.rng.integers(1, 6))) + "</ul>"
        if r < 0.90:
            return f"<blockquote>{self.pick(s(5, 50, True), f'<p>{s(5, 50, True)}</p>')}</blockquote>"
        if r < 0.94:
            return f"<p>{s(5, 60, True)} <a href=/y>{s(1, 4, False)}</a> {s(2, 30, False)}</p>"
        if r < 0.97:
            return "<table>" + "".join(f"<tr><td>{s(1, 6, True)}</td><td>{s(1, 6, True)}</td></tr>" for _ in range(self.rng.integers(1, 5))) + "</table>"
        return f"<pre>{s(3, 40, True)}</pre>"

    def page(self) -> str:
        inside = [self.pick(f"<h1>{self.say(1, 14, True)}</h1>", f"<h1>{self.say(1, 14, True)}</h1>", "")]
        for _ in range(self.rng.integers(1, 16)):
            inside.append(self.paragraph())
            if self.rng.random() < 0.06:
                inside.append(self.boiler())
        if self.rng.random() < 0.15:
            inside.append(self.boiler())
        opening, closing = {
            0: ("<article>", "</article>"), 1: ("<main>", "</main>"), 2: (f'<div class="{self.pick("content", "post", "entry-content", "article-body", "story")}">', "</div>"),
            3: ('<div id="main"><div class="inner">', "</div></div>"), 4: ("<main><article>", "</article></main>"), 5: ("<section class='post'>", "</section>"), 6: ("<div>", "</div>"), 7: (f'<div class="{self.pick(*self.words[:200])}">', "</div>"),
        }[int(self.rng.choice([0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 7]))]
        before = "".join(self.boiler() for _ in range(self.rng.integers(0, 5)))
        after = "".join(self.boiler() for _ in range(self.rng.integers(0, 5)))
        whole = f"<!DOCTYPE html><html><head><title>{self.say(1, 9, False)}</title></head><body>{before}{opening}{''.join(inside)}{closing}{after}</body></html>"
        if self.rng.random() < 0.15:
            whole = whole[: int(len(whole) * self.rng.uniform(0.4, 1))]
        return whole


def labelled_page(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a made page's blocks: 1 where the block or one below it has main text."""
    tree = blocks(parse(page))
    labels = np.array([float(PageMaker.MAIN in b.text) for b in tree])
    for b in tree:
        b.text = b.text.replace(PageMaker.MAIN, "")
    for i in range(len(tree) - 1, 0, -1):
        labels[tree[i].parent] = max(labels[tree[i].parent], labels[i])
    return features(tree), labels


@lru_cache(maxsize=4)
def train(pages: int = 700, seed: int = 5) -> Trees:
    """Fits the trees to made pages, once in a driver's life; the same seed gives the same model."""
    maker = PageMaker(seed)
    made = [labelled_page(maker.page()) for _ in range(pages)]
    return boost(np.concatenate([x for x, _ in made]), np.concatenate([y for _, y in made]))


def decode(tree: list[Block], margin: np.ndarray) -> list[int]:
    """Leaves that are kept by the likeliest labels in which nothing is kept below what is dropped.

    A block's log-odds count for keeping it. A kept block's worth is its own and what is worth keeping below;
    what is worth less than nothing is dropped as a whole.
    """
    worth = margin.clip(-12, 12).copy()
    for i in range(len(tree) - 1, 0, -1):
        if worth[i] > 0:
            worth[tree[i].parent] += worth[i]
    kept = np.zeros(len(tree), dtype=bool)
    kept[0] = True
    for i in range(1, len(tree)):
        # The page's frame is no choice: whatever is kept lies in it.
        kept[i] = kept[tree[i].parent] and (worth[i] > 0 or tree[i].tag in ("html", "body"))
    return [i for i in range(len(tree)) if kept[i] and tree[i].tag == "#text"]


def extract(pages: DataFrame, model: Trees | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` with text and n_chars of each whole page.

    Null, empty and textless pages give an empty text; rows are independent, so repeated rows repeat and an
    empty table gives none. Columns of the frame that are not in ``keep`` are ignored, whatever their names.
    """
    model = model or train()
    chosen = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), "text string", "n_chars long"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            htmls = batch.column(len(keep)).to_pylist()
            held: list[list[Block]] = []
            for number, page in enumerate(htmls, 1):
                held.append(blocks(parse(page or "")))
                # Trees meet in one matrix, so far as its size has a bound.
                if sum(map(len, held)) < 20_000 and number < len(htmls):
                    continue
                margin = model.margin(np.concatenate([features(t) for t in held]))
                place = 0
                for tree in held:
                    texts.append(" ".join(tree[i].text for i in decode(tree, margin[place : place + len(tree)])))
                    place += len(tree)
                held = []
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return chosen.mapInArrow(work, schema)
