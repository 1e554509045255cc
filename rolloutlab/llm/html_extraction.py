"""Main text of web pages by boosted trees over DOM nodes, decoded along the tree.

Block elements are nodes; their features are the tag, categories of their
attribute tokens and of their ancestors', depth, subtree text and link
density, and how they compare with their siblings. Gradient-boosted trees give
each node the chance that it is main text. Decoding then picks the best
consistent labelling: below a node that is out everything is out, below one
that is in a part may be out (an advert in an article), and a wrapper may be
neither. The trees are fitted on generated pages, so no page of the input is
needed for that.
"""

from __future__ import annotations

import bisect
import functools
import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element and token categories.
SCRIPTS = "script style"
ENCLOSED = "template title textarea svg iframe noscript"
CONTROLS = "select button canvas object"
CLOSES_ITSELF = "svg iframe object canvas template"
BLOCKS = ("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
          "header hr li main menu nav ol p pre section summary table tbody thead tfoot tr td th ul caption")
KINDS = {
    "p": "p", "heading": "h1 h2 h3 h4 h5 h6", "item": "li dd dt", "list": "ul ol dl menu dir", "cell": "td th tr", "table": "table tbody thead tfoot caption",
    "div": "div center details", "section": "section", "article": "article main", "nav": "nav", "aside": "aside", "header": "header", "footer": "footer address",
    "form": "form fieldset dialog", "quote": "blockquote pre", "figure": "figure figcaption", "root": "html body",
}
TOKENS = {
    "nav": "nav navigation navbar menu menus breadcrumb breadcrumbs pager pagination toc tabs skip",
    "header": "header head masthead banner top topbar logo branding",
    "footer": "footer foot copyright legal bottom colophon imprint",
    "side": "sidebar side aside rail widget widgets related recommended trending popular more teaser teasers",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner dfp",
    "notice": "notice cookie cookies consent gdpr alert modal popup overlay newsletter subscribe subscription paywall signup warning disclaimer",
    "form": "form login search signin register input",
    "comment": "comment comments commentlist disqus reply replies discussion respond reviews",
    "social": "share sharing social follow tweet facebook",
    "meta": "meta byline tags tag date author bio category",
    "main": "content article main post entry story body text hentry page articlebody",
}
KIND_OF = {t: i for i, ts in enumerate(KINDS.values()) for t in ts.split()}
TOKEN_OF: dict[str, list[int]] = {}
for _i, _ts in enumerate(TOKENS.values()):
    for _t in _ts.split():
        TOKEN_OF.setdefault(_t, []).append(_i)
BLOCK = frozenset(BLOCKS.split())
VOID = frozenset("hr".split())
CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"),
          "th": ("td th", "tr table"), "tbody": ("tr td th thead tbody tfoot", "table"), "thead": ("tr td th thead tbody", "table"), "tfoot": ("tr td th thead tbody", "table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-z][^\s/>]*+)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-z][^\s/>]*+)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.I | re.S)
#: Where an element whose text counts for nothing ends: its end tag, or what shows that it was never closed.
STOPS = {t: re.compile(rf"<(/)?{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in ENCLOSED.split()}
STOPS |= {t: re.compile(rf"<(?:(/){t}|{t}|/?(?:{'|'.join(BLOCKS.split())}))(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in CONTROLS.split()}
STOPS |= {t: re.compile(rf"<(/){t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in SCRIPTS.split()}
ENDLESS, ITSELF = frozenset(SCRIPTS.split()), frozenset(CLOSES_ITSELF.split())
ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
GAP = re.compile(r"\s+")
#: What generated pages say of a node.
LABEL = re.compile(r'\s*data-y="[01]"')


@dataclass
class Page:
    """Nodes in page order; ``runs`` are the texts directly in nodes, in page order, as (node, text)."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)
    links: list[int] = field(default_factory=list)


def parse(source: str) -> Page:
    """A forgiving reading: block elements open nodes, implied ends are honoured, stray ends ignored.

    Scripts and styles run to their end tag or the end of the page. Other
    elements whose text counts for nothing (vector images, frames, titles,
    controls and so on) end at their end tag; where that is missing, another
    of the kind begins first or, in controls, a block does, only the tag goes
    and the text after it stays. A frame or image closed in its own tag is
    empty. Names count whole: button-group is no button.
    """
    page = Page(["html"], [-1], [""], [], [0])
    stack, inside, at = [0], 0, 0
    places: list[tuple[int, int]] = []  # of every run: how many nodes were open or done by then, and how much of it is a link's

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            decoded = html.unescape(raw) if "&" in raw else raw
            page.runs.append((stack[-1], decoded))
            places.append((len(page.tags), len(decoded) if inside else 0))
        elif raw:
            page.runs.append((stack[-1], " "))
            places.append((len(page.tags), 0))

    while m := MARKUP.search(source, at):
        text(source[at: m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, ends = tag.lower(), m[1] or m[4]
        if tag in STOPS:
            if not ends and not (tag in ITSELF and m[0].endswith("/>")):
                stop = STOPS[tag].search(source, at)
                if stop and stop[1]:
                    at = stop.end()
                elif tag in ENDLESS:
                    at = len(source)
            continue
        if ends:
            if tag == "a":
                inside = 0
            elif tag in BLOCK:
                for k in range(len(stack) - 1, 0, -1):
                    if page.tags[stack[k]] == tag:
                        del stack[k:]
                        inside = 0
                        break
        elif tag == "a":
            inside = 1
        elif tag == "br":
            page.runs.append((stack[-1], " "))
            places.append((len(page.tags), 0))
        elif tag in BLOCK and tag != "html":
            if page.tags[stack[-1]] == "p" or (tag[0] == "h" and len(tag) == 2 and KIND_OF.get(page.tags[stack[-1]]) == 1):
                stack.pop()
            if tag in CLOSES:
                ends, bounds = CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    name = page.tags[stack[k]]
                    if name in bounds:
                        break
                    if name in ends:
                        del stack[k:]
                        if tag not in ("tr", "tbody", "thead", "tfoot"):
                            break
            page.tags.append(tag)
            page.parents.append(stack[-1])
            page.attributes.append(m[3] or "")
            page.links.append(0)
            if tag not in VOID:
                stack.append(len(page.tags) - 1)
    text(source[at:])
    return with_loose_text(page, places)


def with_loose_text(page: Page, places: list[tuple[int, int]]) -> Page:
    """The page with a paragraph of its own around each text that stands beside blocks, so that only nodes with nothing below have text."""
    above = set(page.parents[1:])
    added: list[tuple[int, int]] = []  # (node before which it stands, its parent)
    owner: list[int] = []  # of every run: its node, or -1 - k for the k-th added
    last = None
    for (node, run), (place, _) in zip(page.runs, places, strict=True):
        if node not in above:
            owner.append(node)
        elif last == (node, place):
            owner.append(-len(added))
        elif run.isspace():
            owner.append(node)
            continue
        else:
            added.append((place, node))
            owner.append(-len(added))
        last = (node, place)
    n = len(page.tags)
    starts = [p for p, _ in added]
    moved = [i + bisect.bisect_right(starts, i) for i in range(n)]
    at_added = [p + k for k, p in enumerate(starts)]
    total = n + len(added)
    out = Page([""] * total, [-1] * total, [""] * total, [], [0] * total)
    for i in range(n):
        out.tags[moved[i]], out.attributes[moved[i]] = page.tags[i], page.attributes[i]
        out.parents[moved[i]] = moved[page.parents[i]] if i else -1
    for k, (_, node) in enumerate(added):
        told = LABEL.search(page.attributes[node])
        out.tags[at_added[k]], out.parents[at_added[k]], out.attributes[at_added[k]] = "p", moved[node], told[0] if told else ""
    for who, (_, run), (_, linked) in zip(owner, page.runs, places, strict=True):
        to = moved[who] if who >= 0 else at_added[-who - 1]
        out.runs.append((to, run))
        out.links[to] += linked
    return out


@functools.lru_cache(maxsize=4096)
def token_flags(attributes: str) -> tuple[int, ...]:
    """Which token categories the attributes hold."""
    found: set[int] = set()
    for m in ATTRIBUTE.finditer(attributes):
        for t in SPLIT_TOKENS.findall(m[1] or m[2] or m[3] or ""):
            found.update(TOKEN_OF.get(t.lower(), ()))
    return tuple(sorted(found))


N_KINDS, N_TOKENS, N_NUMBERS = len(KINDS), len(TOKENS), 24
WIDTH = 2 * (N_KINDS + N_TOKENS) + N_NUMBERS


def features(page: Page) -> np.ndarray:
    """One row per node: kind, tokens, the ancestors' kinds and tokens, and numbers of the subtree and the siblings."""
    n = len(page.tags)
    out = np.zeros((n, WIDTH), dtype=np.float32)
    own, stops = np.zeros(n), np.zeros(n)
    for node, run in page.runs:
        own[node] += len(run)
        stops[node] += run.count(". ") + run.count(",") + run.endswith(".")
    links = np.array(page.links, dtype=float)
    total, linked, marks, nodes = own.copy(), links.copy(), stops.copy(), np.ones(n)
    depth, children, place = np.zeros(n), np.zeros(n), np.zeros(n)
    shapes = Counter((page.parents[i], page.tags[i], page.attributes[i]) for i in range(1, n))
    alike, wide, most = np.ones(n), np.zeros(n), np.zeros(n)
    last: dict[int, int] = {}
    before, after = np.full(n, -1), np.full(n, -1)
    for i in range(1, n):
        p = page.parents[i]
        depth[i] = depth[p] + 1
        place[i] = children[p]
        children[p] += 1
        alike[i] = shapes[p, page.tags[i], page.attributes[i]]
        wide[p] += page.tags[i] in ("div", "section", "li", "article", "dd")
        if p in last:
            before[i], after[last[p]] = last[p], i
        last[p] = i
        row, up = out[i], out[p]
        half = N_KINDS + N_TOKENS
        row[half: 2 * half] = np.maximum(up[half: 2 * half], up[:half])
        row[KIND_OF.get(page.tags[i], 6)] = 1
        for t in token_flags(page.attributes[i]):
            row[N_KINDS + t] = 1
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        total[p] += total[i]
        linked[p] += linked[i]
        marks[p] += marks[i]
        nodes[p] += nodes[i]
        most[p] = max(most[p], total[i])
    parents = np.maximum(np.array(page.parents), 0)
    density = linked / np.maximum(total, 1)
    begin = np.concatenate([[0], np.cumsum(own)[:-1]])
    numbers = np.column_stack([
        depth, children, place, children[parents], np.log1p(total), np.log1p(own), density, total / nodes, marks / np.maximum(total, 1) * 100,
        total / np.maximum(total[parents], 1), total / max(total[0], 1), begin / max(own.sum(), 1), np.log1p(nodes),
        np.where(before >= 0, np.log1p(total[before]), -1), np.where(before >= 0, density[before], -1),
        np.where(after >= 0, np.log1p(total[after]), -1), np.where(after >= 0, density[after], -1), density[parents],
        # how many siblings look alike, what the parent is made of, and how the text is spread below and among the parent's
        alike, alike[parents], wide[parents] / np.maximum(children[parents], 1), total / np.maximum(children, 1) / max(total[0], 1), most / np.maximum(total, 1), total / np.maximum(most[parents], 1),
    ])
    out[:, -N_NUMBERS:] = numbers
    return out


class Boosted:
    """Gradient-boosted regression trees on the logistic loss, grown level by level on binned features."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: int = 10):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least
        self.base = 0.0
        self.splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
        n, width = x.shape
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            size = 2**self.depth - 1
            which, cut_at = np.zeros(size, dtype=np.int64), np.full(size, np.inf)
            node = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                local = node - first
                best = np.full(count, 1e-6)
                for f in range(width):
                    if not len(edges[f]):
                        continue
                    k = len(edges[f]) + 1
                    slot = local * k + binned[:, f]
                    gs = np.bincount(slot, g, count * k).reshape(count, k).cumsum(axis=1)
                    hs = np.bincount(slot, h, count * k).reshape(count, k).cumsum(axis=1)
                    ns = np.bincount(slot, minlength=count * k).reshape(count, k).cumsum(axis=1)
                    ga, ha, na = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (ga - gs)**2 / (ha - hs + self.ridge) - ga**2 / (ha + self.ridge)
                    gain = np.where((ns >= self.least) & (na - ns >= self.least), gain, 0)[:, :-1]
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(count), at]
                    for c in np.flatnonzero(top > best):
                        best[c] = top[c]
                        which[first + c], cut_at[first + c] = f, edges[f][at[c]]
                node = 2 * node + 1 + (x[np.arange(n), which[node]] > cut_at[node])
            leaf = node - size
            values = -self.rate * np.bincount(leaf, g, size + 1) / (np.bincount(leaf, h, size + 1) + self.ridge)
            score = score + values[leaf]
            self.splits.append((which, cut_at, values))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for which, cut_at, values in self.splits:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, which[node]] > cut_at[node])
            score += values[node - len(which)]
        return 1 / (1 + np.exp(-score))


def decode(page: Page, chance: np.ndarray) -> np.ndarray:
    """Which nodes are in, by the most likely labelling in which nothing below an out node is in.

    A node with others below may be neither, which says nothing of it: it has
    no text of its own, and what is below may be main text.
    """
    n = len(page.tags)
    p = np.clip(chance, 1e-6, 1 - 1e-6)
    yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
    out, in_, mixed = no[:], yes[:], [0.0] * n
    leaf = [True] * n
    for i in range(n - 1, 0, -1):
        if leaf[i]:
            mixed[i] = -math.inf
        q = page.parents[i]
        leaf[q] = False
        out[q] += out[i]
        in_[q] += max(in_[i], out[i])
        mixed[q] += max(in_[i], out[i], mixed[i])
    state = [0] * n  # 0 out, 1 in, 2 neither
    state[0] = 2 if n > 1 else 1
    for i in range(1, n):
        above = state[page.parents[i]]
        if above == 1:
            state[i] = 1 if in_[i] >= out[i] else 0
        elif above == 2:
            best = max(in_[i], out[i], mixed[i])
            state[i] = 1 if in_[i] == best else 2 if mixed[i] == best else 0
    return np.array(state) == 1


def assemble(page: Page, kept: np.ndarray) -> str:
    """The text of kept nodes: one line per block, in page order; a block that holds others is split by them."""
    lines: list[str] = []
    held: list[str] = []
    at = -1
    for node, run in page.runs:
        if not kept[node]:
            continue
        if node != at:
            lines.append("".join(held))
            held, at = [], node
        held.append(run)
    lines.append("".join(held))
    clean = (GAP.sub(" ", x).strip() for x in lines)
    return "\n".join(x for x in clean if x)


# ---- generated pages -------------------------------------------------------

STYLES = {
    "nav": ("nav", "div class=main-nav", "ul class=menu", "div id=navbar", "div class=breadcrumbs"), "header": ("header", "div id=header", "div class=masthead"),
    "footer": ("footer", "div class=footer", "div id=colophon"), "side": ("aside", "div class=sidebar", "div id=rail", "div class=related-posts"),
    "ad": ("div class=ad", "div id=ad-slot", "div class=sponsored", "aside class=advert", "div class=promo"),
    "notice": ("div class=cookie-notice", "div class=alert", "div id=newsletter", "section class=notice"),
    "form": ("form", "form class=login", "div class=search-form"), "comment": ("section id=comments", "div class=comments", "ol class=commentlist"),
    "main": ("article", "main", "div class=content", "div id=article-body", "div class=post", "section class=story", "div"),
}


#: Of the generated pages, the share whose names tell nothing.
STRANGE = 0.4


def generated_page(rng: np.random.Generator, strange: bool | None = None) -> str:
    """A page with labels in data-y attributes: 1 for main text, 0 for the rest.

    On a strange page containers have no telling tag, and a made-up class or
    none: only the tree and the text tell what they are.
    """
    letters = "etaoinshrdlucmfwyp"
    strange = rng.random() < STRANGE if strange is None else strange
    made_up: dict[str, str] = {}

    def words(low: int, high: int) -> str:
        ws = ["".join(letters[k] for k in rng.integers(0, len(letters), rng.integers(1, 10))) for _ in range(rng.integers(low, high + 1))]
        ws = [w + ("." if rng.random() < 0.08 else "," if rng.random() < 0.06 else "") for w in ws]
        return " ".join(ws).capitalize() + "."

    def tag(style: str, inner: str, y: int) -> str:
        if strange and style.split()[0] not in ("p", "li", "ul"):
            if style not in made_up:
                name = "".join(letters[k] for k in rng.integers(0, len(letters), 7))
                made_up[style] = "div" if rng.random() < 0.4 else f"{'div' if rng.random() < 0.8 else 'section'} class={name}x"
            style = made_up[style]
        name = style.split()[0]
        more = " " + style.split(" ", 1)[1].replace("=", '="') + '"' if " " in style else ""
        return f'<{name}{more} data-y="{y}">{inner}</{name}>'

    def pick(kind: str) -> str:
        return str(rng.choice(STYLES[kind]))

    def links(n: int) -> str:
        items = [f'<a href="/{k}">{words(1, 3)[:-1]}</a>' for k in range(n)]
        if rng.random() < 0.7:
            return '<ul data-y="0">' + "".join(f'<li data-y="0">{x}</li>' for x in items) + "</ul>"
        return " | ".join(items)

    def paragraph() -> str:
        inner = words(*((1, 6), (8, 40), (30, 120))[rng.integers(3)])
        form = rng.random()
        if form < 0.15:
            inner = inner.replace(" ", ' <a href="/x">link</a> ', 1)
        if form > 0.85:
            return f'<p data-y="1"><b>{inner}<br>'
        return f'<p data-y="1">{inner}' + ("</p>" if rng.random() < 0.9 else "")

    def boiler(kind: str) -> str:
        style = pick(kind)
        if kind in ("nav", "side") and rng.random() < 0.8:
            inner = links(int(rng.integers(3, 9)))
            if rng.random() < 0.4:
                inner = f'<h3 data-y="0">{words(1, 3)[:-1]}</h3>{inner}'
        elif kind == "comment":
            one = "div class=comment" if rng.random() < 0.6 else "li"
            signed = rng.random() < 0.5
            inner = "".join(tag(one, (tag("div class=meta", words(1, 2)[:-1], 0) if signed else "") + tag("p", words(3, 40), 0), 0) for _ in range(rng.integers(2 if strange else 1, 6)))
        elif kind == "form":
            inner = f"{words(1, 4)} <input name=q> <label>{words(1, 3)}</label>"
        elif kind == "footer":
            inner = f"&copy; example.org &middot; {words(2, 12)}" if rng.random() < 0.6 else links(4)
        else:
            inner = words(3, 25)
            inner = tag("p", inner, 0) if rng.random() < 0.4 else inner
        return tag(style, inner, 0)

    title = words(3, 12)
    parts = [f'<h1 data-y="1">{title}</h1>' if rng.random() < 0.8 else ""]
    loose = rng.random() < 0.4  # text beside the blocks, in the container itself
    for _ in range(rng.integers(1, 12)):
        form = rng.random()
        if loose and rng.random() < 0.4:
            parts.append(f"{words(8, 60)}{'<br>' if rng.random() < 0.5 else ''}")
        elif form < 0.7:
            parts.append(paragraph())
        elif form < 0.75:
            parts.append(f'<ul data-y="1"><li data-y="1">{words(2, 15)}<ul data-y="1"><li data-y="1">{words(2, 12)}</li></ul></li><li data-y="1">{words(2, 15)}</li></ul>')
        elif form < 0.8:
            parts.append(f'<h2 data-y="1">{words(2, 7)}</h2>')
        elif form < 0.85:
            parts.append('<ul data-y="1">' + "".join(f'<li data-y="1">{words(2, 15)}</li>' for _ in range(rng.integers(2, 6))) + "</ul>")
        elif form < 0.88:
            parts.append(f'<blockquote data-y="1">{words(8, 40)}</blockquote>')
        elif form < 0.91:
            parts.append('<table data-y="1">' + "".join(f'<tr data-y="1"><td data-y="1">{words(1, 3)}</td><td data-y="1">{words(1, 3)}</td></tr>' for _ in range(3)) + "</table>")
        else:
            parts.append(boiler(str(rng.choice(["ad", "notice", "side", "form"]))))
    if rng.random() < 0.25:
        parts.append(boiler("comment"))
    body = tag(pick("main"), "".join(parts), 1)
    head = [boiler(k) for k in ("notice", "header", "nav", "ad", "form") if rng.random() < 0.5]
    tail = [boiler(k) for k in ("side", "ad", "comment", "form", "nav", "footer") if rng.random() < 0.5]
    rng.shuffle(head)
    page = "".join(head) + body + "".join(tail)
    for _ in range(rng.integers(0, 3)):
        page = f'<div class="wrapper" data-y="0">{page}</div>'
    return f"<html><head><title>{title}</title></head><body>{page}</body></html>"


@functools.lru_cache(maxsize=2)
def trained(pages: int = 700, seed: int = 41) -> Boosted:
    """Trees fitted on ``pages`` generated pages."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        page = parse(generated_page(rng))
        told = np.array(['data-y="' in a for a in page.attributes])
        ys.append(np.array(['data-y="1"' in a for a in page.attributes])[told])
        page.attributes = [LABEL.sub("", a) for a in page.attributes]  # what is learnt is no feature
        xs.append(features(page)[told])
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def main_texts(sources: list[str | None], model: Boosted) -> list[str]:
    out: list[str] = []
    for s in range(0, len(sources), 256):
        pages = [parse(x or "") for x in sources[s: s + 256]]
        rows = [features(p) for p in pages]
        chance = model.predict(np.concatenate(rows))
        at = 0
        for page in pages:
            n = len(page.tags)
            out.append(assemble(page, decode(page, chance[at: at + n])))
            at += n
    return out


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A null or empty page gives an empty text; one without block elements all
    its text. Character references are decoded in text runs, white space in a
    block becomes one space, blocks are joined by line breaks. Repeated rows
    stay rows; extra columns are left out; empty input gives no rows.
    """
    fitted = model or trained()

    @F.pandas_udf("string")
    def of(sources: pd.Series) -> pd.Series:
        return pd.Series(main_texts(sources.tolist(), fitted))

    out = pages.select("page_id", "url", of("html").alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
