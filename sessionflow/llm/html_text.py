"""Main text of web pages: a tree-structured graphical model over the DOM.

Every block element of a page is a node with a hidden label, content or not.
Its own signs (tag, names, role, text and link density) give a node potential
and each parent-child edge a compatibility by the child's kind. Sum-product
messages run from the leaves to the root and back, so a node's marginal
weighs the whole tree; the text blocks of nodes with a content marginal over
one half are the main text. The potentials are fitted on labelled pages,
which :func:`labelled_pages` lays out from rules with varying structure, names
and text (no corpus is needed, and none is read for it).

Semantics: a null or empty page has the empty text. Broken markup is read as
browsers do where it matters: end tags may be missing or stray, a paragraph
ends where a block begins, raw elements end at their end tag or the page's
end. Character references are decoded; white space within a block becomes one
space (also ``br``); blocks join in page order with a line feed. Pages of any
length are read whole; repeated rows give repeated results.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes svg template select option canvas audio video".split())
BLOCK = frozenset(
    "html body article section nav aside header footer main div p ul ol li dl dt dd table caption thead "
    "tbody tfoot tr td th form fieldset figure figcaption blockquote pre address details summary menu "
    "dialog h1 h2 h3 h4 h5 h6 hr center label button legend search hgroup head".split()
)
#: What an open paragraph ends at.
_ENDS_P = BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "label", "button", "legend", "summary"}
#: A start tag ends open elements of these kinds, up to the nearest container.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
# Names and roles that tell what an element is for.
_AWAY = (
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner "
    "nav navbar navigation menu sidebar side rail footer foot header masthead topbar cookie cookies consent "
    "gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup share sharing "
    "social comment comments commentlist respond reply replies disqus discussion related recommended "
    "recommendations trending popular breadcrumb breadcrumbs pagination pager login signin search form "
    "widget toolbar legal copyright disclaimer tags meta skip paywall outbrain taboola byline print"
).split()
_HERE = "content article post entry story main body text prose maincontent articlebody postbody".split()
_ROLES_AWAY = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
_ROLES_HERE = {"main", "article"}
_KINDS = (
    {"nav", "aside", "footer", "form", "menu", "dialog", "button", "label", "fieldset", "legend", "search", "address"},
    {"header", "hgroup"},
    {"article", "main"},
    {"p", "blockquote", "pre", "dd", "dt", "dl", "figure", "figcaption", "td", "th", "table", "tr", "tbody", "thead", "caption"},
    {"h1", "h2", "h3", "h4", "h5", "h6"},
    {"ul", "ol", "li"},
    {"section", "div", "center", "details", "summary"},
)
N_KINDS = len(_KINDS) + 1
_KIND = {tag: i for i, tags in enumerate(_KINDS) for tag in tags}
N_FEATURES = N_KINDS + 17
_NAME = re.compile(r"[a-z]+")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_START = re.compile(r"""<([a-zA-Z][^\s/>]*)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>""")
_START_PLAIN = re.compile(r"<([a-zA-Z][^\s/>]*)([^>]*)>")
_END = re.compile(r"</([a-zA-Z][^\s/>]*)[^>]*>?")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "attrs", "chars", "links", "stops", "blocks", "label")

    def __init__(self, tag: str, parent: int, attrs: str):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.chars = self.links = self.stops = self.blocks = 0
        self.label = None


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): kind is "text", "start" or "end". Linear time."""
    at, n, quoted = 0, len(page), True
    low = None
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield "text", page[at:lt], ""
        if lt >= n:
            return
        nxt = page[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        if nxt == "/":
            m = _END.match(page, lt)
            if m:
                yield "end", m[1].lower(), ""
                at = m.end()
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        m = (_START if quoted else _START_PLAIN).match(page, lt) if nxt.isalpha() else None
        if m is None and nxt.isalpha() and quoted:
            quoted = False  # an attribute that never ends: from here a tag ends at the next >
            m = _START_PLAIN.match(page, lt)
        if m is None:
            if nxt.isalpha():
                return  # a tag cut off by the page's end
            yield "text", "<", ""
            at = lt + 1
            continue
        name = m[1].lower()
        at = m.end()
        yield "start", name, m[2]
        if name in RAW:
            low = low if low is not None else page.lower()
            end = low.find(f"</{name}", at)
            if len(low) != n:  # lower case changed the length: search as written
                found = re.compile(f"</{name}", re.I).search(page, at)
                end = found.start() if found else -1
            gt = page.find(">", end) if end >= 0 else -1
            at = n if gt < 0 else gt + 1


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes in page order (a parent before its children) and text blocks."""
    nodes = [Node("", -1, "")]
    stack: list[tuple[str, int]] = [("", 0)]  # open elements with their nearest block node
    blocks: list[tuple[int, str]] = []
    run: list[str] = []
    linked = links = 0

    def flush():
        nonlocal links
        if run:
            text = " ".join(html_lib.unescape("".join(run)).split())
            if text:
                node = nodes[stack[-1][1]]
                node.chars += len(text)
                node.links += min(links, len(text))
                node.stops += sum(text.count(c) for c in ".!?,;")
                node.blocks += 1
                blocks.append((stack[-1][1], text))
            run.clear()
        links = 0

    # places on the stack of the open elements of each name, and of all blocks:
    # an end tag finds its element without a walk, however deep the page is
    places: dict[str, list[int]] = {}
    blocks_open: list[int] = []

    def close(to: int):
        nonlocal linked
        while len(stack) > to:
            tag = stack[-1][0]
            if tag in BLOCK:
                flush()
                blocks_open.pop()
            places[tag].pop()
            linked -= tag == "a"
            stack.pop()

    def last(name: str) -> int:
        open_ones = places.get(name)
        return open_ones[-1] if open_ones else 0

    for kind, name, rest in tokens(page):
        if kind == "text":
            run.append(name)
            if linked:
                links += len(name)
        elif kind == "end":
            at = last(name)
            # a stray inline end tag does not close a block
            if at and (name in BLOCK or not blocks_open or at > blocks_open[-1]):
                close(at)
        elif name in RAW:
            run.append(" ")
        elif name in VOID:
            if name == "hr":
                flush()
            run.append(" ")
        else:
            if name in _ENDS_P and blocks_open and stack[blocks_open[-1]][0] == "p":
                close(blocks_open[-1])
            if name in _IMPLIED:
                ends, within = _IMPLIED[name]
                container = max(map(last, within))
                # the outermost element behind the container that has to end
                behind = [places[x][bisect_right(places[x], container)] for x in ends if last(x) > container]
                if behind:
                    close(min(behind))
            places.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                flush()
                blocks_open.append(len(stack))
                nodes.append(Node(name, stack[-1][1], rest))
                stack.append((name, len(nodes) - 1))
            else:
                stack.append((name, stack[-1][1]))
                linked += name == "a"
    close(1)
    flush()
    return nodes, blocks


def node_features(nodes: list[Node]) -> np.ndarray:
    """One row of signs per node."""
    n = len(nodes)
    x = np.zeros((n, N_FEATURES))
    total = np.array([[v.chars, v.links, v.stops, v.blocks] for v in nodes], float)
    for i in range(n - 1, 0, -1):
        total[nodes[i].parent] += total[i]
    page = max(1.0, total[0, 0])
    for i, v in enumerate(nodes):
        row = x[i]
        row[_KIND.get(v.tag, N_KINDS - 1)] = 1
        k = N_KINDS
        if v.attrs:
            for m in _ATTRIBUTE.finditer(v.attrs):
                key, value = m[1].lower(), m[2].strip("\"'")
                if key in ("class", "id", "aria-label"):
                    names = set(_NAME.findall(_CAMEL.sub(" ", value).lower()))
                    row[k] = max(row[k], float(not names.isdisjoint(_AWAY_SET)))
                    row[k + 1] = max(row[k + 1], float(not names.isdisjoint(_HERE_SET)))
                elif key == "role":
                    row[k + 2] = float(value.lower() in _ROLES_AWAY)
                    row[k + 3] = float(value.lower() in _ROLES_HERE)
                elif key == "style":
                    row[k + 4] = float("display:none" in value.replace(" ", "").lower())
            if re.search(r"(?<![\w-])hidden(?![\w=-])", v.attrs):
                row[k + 4] = 1.0
        chars, links, stops, many = total[i]
        row[k + 5] = links / chars if chars else 0.0
        row[k + 6] = math.log1p(chars) / 8
        row[k + 7] = min(1.0, 20 * stops / chars) if chars else 0.0
        row[k + 8] = chars / page
        row[k + 9] = math.log1p(chars / many) / 6 if many else 0.0
        row[k + 10] = float(v.blocks > 0)
        row[k + 11] = float(v.blocks > 0 and v.links > 0.6 * v.chars)
        row[k + 12] = float(0 < v.chars < 40)
        row[k + 13] = float(v.chars >= 120)
        row[k + 14] = float(v.tag == "h1")
        row[k + 15] = float(v.tag in ("html", "body", ""))
        row[k + 16] = 1.0
    return x


_AWAY_SET, _HERE_SET = frozenset(_AWAY), frozenset(_HERE)


#: Labels of a node: away (no content in it), content, frame (holds content among others).
AWAY, CONTENT, FRAME = range(3)


@dataclass
class Model:
    weights: np.ndarray  # (features, labels) node potentials
    edges: list  # [kind of child][label of parent][label of child] compatibility

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content per node, by messages up and down the tree.

        Beliefs are rescaled at every step, so deep and wide trees neither
        over- nor underflow.
        """
        score = node_features(nodes) @ self.weights
        score = np.exp(np.clip(score - score.max(1, keepdims=True), -30, 0)).tolist()
        n = len(nodes)
        sent: list = [None] * n  # messages from each node to its parent
        for i in range(n - 1, 0, -1):
            a, b, c = score[i]  # own potential times the children's messages
            e0, e1, e2 = self.edges[_KIND.get(nodes[i].tag, N_KINDS - 1)]
            x = e0[0] * a + e0[1] * b + e0[2] * c
            y = e1[0] * a + e1[1] * b + e1[2] * c
            z = e2[0] * a + e2[1] * b + e2[2] * c
            total = x + y + z
            m = sent[i] = (max(x / total, 1e-9), max(y / total, 1e-9), max(z / total, 1e-9))
            s = score[nodes[i].parent]
            s[0], s[1], s[2] = s[0] * m[0], s[1] * m[1], s[2] * m[2]
            total = s[0] + s[1] + s[2]
            s[0], s[1], s[2] = s[0] / total, s[1] / total, s[2] / total
        out = [0.0] * n
        for i in range(n):
            s = score[i]
            if i:
                up, m = score[nodes[i].parent], sent[i]
                a, b, c = up[0] / m[0], up[1] / m[1], up[2] / m[2]
                e0, e1, e2 = self.edges[_KIND.get(nodes[i].tag, N_KINDS - 1)]
                x = s[0] * (a * e0[0] + b * e1[0] + c * e2[0])
                y = s[1] * (a * e0[1] + b * e1[1] + c * e2[1])
                z = s[2] * (a * e0[2] + b * e1[2] + c * e2[2])
                total = x + y + z
                s[0], s[1], s[2] = x / total, y / total, z / total
            out[i] = s[1] / (s[0] + s[1] + s[2])
        return out

    def extract(self, page: str | None) -> str:
        nodes, blocks = parse(page or "")
        if not blocks:
            return ""
        p = self.marginals(nodes)
        return "\n".join(text for node, text in blocks if p[node] > 0.5)


def labelled_pages(n: int = 500, seed: int = 11) -> Iterator[str]:
    """Pages whose content elements carry the attribute ``data-content``.

    Layouts vary: sectioning elements or plain ``div``, names of parts, their
    order, missing end tags, short and long paragraphs, long reader comments,
    adverts and notices inside the article.
    """
    r = random.Random(seed)
    away = [w for w in _AWAY if w not in ("print", "side", "foot", "meta", "form")]

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(1, 9))) for _ in range(r.randint(a, b)))

    def sentence(a: int = 3, b: int = 25) -> str:
        return words(a, b).capitalize() + r.choice(["."] * 8 + ["!", "?", ""])

    def para() -> str:
        return " ".join(sentence() for _ in range(r.choice([1, 1, 2, 4, 8])))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k))

    def named(tag: str, inside: str, *names: str) -> str:
        key = r.choice(["class", "class", "id"])
        return f'<{tag} {key}="{r.choice(names)}">{inside}</{tag}>'

    def part() -> str:
        """Something that is not content."""
        kind = r.randrange(10)
        if kind == 0:
            return r.choice(["<nav>{}</nav>", '<div class="menu">{}</div>', '<div role="navigation">{}</div>']).format(f"<ul>{links(r.randint(2, 9))}</ul>")
        if kind == 1:
            return named(r.choice(["div", "section", "aside"]), para(), "ad", "ads", "advert", "sponsored", "ad-slot", "promo-box", "banner")
        if kind == 2:
            return r.choice(["<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="right-rail">{}</div>']).format(f"<h3>{words(1, 3)}</h3><ul>{links(4)}</ul><p>{sentence()}</p>")
        if kind == 3:
            return named("div", f"<p>{para()}</p><button>{words(1, 2)}</button>", "cookie-notice", "consent", "notice", "gdpr", "popup", "alert")
        if kind == 4:
            return r.choice(["<form>{}</form>", '<div class="newsletter"><form>{}</form></div>']).format(f"<label>{words(1, 4)}</label><input><p>{sentence()}</p>")
        if kind == 5:
            many = "".join(r.choice(["<li>{}</li>", '<div class="comment"><p>{}</p></div>', "<p>{}</p>", "<article><h4>x</h4><p>{}</p></article>"]).format(para()) for _ in range(r.randint(1, 6)))
            return named(r.choice(["section", "div"]), f"<h3>{words(1, 2)}</h3>{many}", "comments", "comment-list", "discussion", "replies", "reader-comments")
        if kind == 6:
            return named("div", f"<ul>{links(3)}</ul>", "share", "social", "related", "breadcrumbs", "tags", "pagination")
        if kind == 7:
            return named(r.choice(["div", "section", "ul"]), r.choice([para(), f"<p>{para()}</p>", f"<li>{words(2, 6)}</li>"]), *away)
        if kind == 8:
            return f"<header><a href='/'>{words(1, 3)}</a><p>{words(2, 7)}</p></header>"
        return r.choice(["<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="site-footer">{}</div>']).format(r.choice(["&copy; {}", "{}", "<p>{}</p>"]).format(sentence()))

    def content() -> str:
        kind = r.randrange(12)
        if kind < 7:
            text = para()
            if r.random() < 0.2:
                text = f"<a href='#'>{words(1, 4)}</a> {text}"
            return f"<p data-content>{text}" + ("</p>" if r.random() < 0.8 else "")
        if kind == 7:
            return f"<h{r.randint(2, 4)} data-content>{words(1, 6)}</h2>"
        if kind == 8:
            return f"<ul data-content>{''.join(f'<li data-content>{sentence()}</li>' for _ in range(r.randint(1, 5)))}</ul>"
        if kind == 9:
            return f"<blockquote data-content><p data-content>{para()}</p></blockquote>"
        if kind == 10:
            rows = "".join(f"<tr data-content><td data-content>{words(1, 3)}</td><td data-content>{words(1, 3)}</td></tr>" for _ in range(2))
            return f"<table data-content>{rows}</table>"
        return r.choice(["<pre data-content>{}</pre>", "<figure data-content><figcaption data-content>{}</figcaption></figure>", "<div data-content>{}</div>"]).format(sentence())

    for _ in range(n):
        title = f"<h1 data-content>{words(1, 9)}</h1>"
        if r.random() < 0.2:
            title = f"<header data-content>{title}</header>"
        inside = "".join(part() if r.random() < 0.06 else content() for _ in range(r.choice([1, 2, 5, 12])))
        if r.random() < 0.3:
            inside += part()
        holder = r.choice(
            ["<article data-content>{}</article>"] * 3 + ["<main data-content>{}</main>", "<main data-content><article data-content>{}</article></main>"]
            + [f'<div data-content {r.choice(["class", "id"])}="{c}">{{}}</div>' for c in ("content", "post-body", "entry-content", "main", "articleBody", "story")]
            + ["<div data-content>{}</div>", "<section data-content>{}</section>", "{}"]
        )
        before = "".join(part() for _ in range(r.randint(0, 4)))
        after = "".join(part() for _ in range(r.randint(0, 4)))
        body = before + holder.format(title + inside) + after
        if r.random() < 0.3:
            body = f'<div class="{r.choice(["wrapper", "container", "page", "row"])}">{body}</div>'
        if r.random() < 0.03:
            yield f"<body data-content>{para()}"
            continue
        if r.random() < 0.1:
            yield r.choice(["<p data-content>{}", "{}"]).format(para())
            continue
        yield f"<html><head><title>x</title></head><body>{body}" + ("</body></html>" if r.random() < 0.9 else "")


def labels_of(nodes: list[Node]) -> np.ndarray:
    """Label per node of a labelled page."""
    y = np.array([CONTENT if "data-content" in v.attrs else AWAY for v in nodes])
    if nodes[0].blocks:  # text without any element
        y[0] = CONTENT
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        if y[i] != AWAY and y[p] == AWAY:
            y[p] = FRAME
    return y


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fit(pages: Iterator[str], l2: float = 0.05, steps: int = 120, rate: float = 0.1) -> Model:
    """Node and edge potentials that make the labels of whole pages likeliest.

    The gradient is what the labels show less what the messages expect, over
    the nodes of all pages at once, one tree level after another.
    """
    xs, labels, kinds, parents, depths, n = [], [], [], [], [], 0
    for page in pages:
        nodes, _ = parse(page)
        depth = [0] * len(nodes)
        for i, v in enumerate(nodes[1:], 1):
            depth[i] = depth[v.parent] + 1
        xs.append(node_features(nodes))
        labels.append(labels_of(nodes))
        kinds += [_KIND.get(v.tag, N_KINDS - 1) for v in nodes]
        parents += [n + max(v.parent, 0) for v in nodes]
        depths += depth
        n += len(nodes)
    x, label = np.concatenate(xs), np.concatenate(labels)
    kind, parent, depth = np.array(kinds), np.array(parents), np.array(depths)
    levels = [np.nonzero(depth == d)[0] for d in range(depth.max() + 1)]
    below = np.nonzero(depth > 0)[0]
    y = np.eye(3)[label]
    shown = np.zeros((N_KINDS, 3, 3))
    np.add.at(shown, (kind[below], label[parent[below]], label[below]), 1)
    params = [np.zeros((x.shape[1], 3)), np.zeros((N_KINDS, 3, 3))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        w, edges = params
        belief = x @ w
        sent = np.zeros((n, 3))
        for at in reversed(levels[1:]):
            sent[at] = _log_sum(edges[kind[at]] + belief[at][:, None, :], 2)
            np.add.at(belief, parent[at], sent[at])
        joint = np.zeros((n, 3, 3))
        full = belief.copy()
        for at in levels[1:]:
            above = (full[parent[at]] - sent[at])[:, :, None] + edges[kind[at]]
            joint[at] = above + belief[at][:, None, :]
            full[at] = _log_sum(joint[at], 1)
        p = np.exp(full - _log_sum(full, 1)[:, None])
        pairs = np.exp(joint[below] - _log_sum(_log_sum(joint[below], 2), 1)[:, None, None])
        expected = np.zeros_like(shown)
        np.add.at(expected, kind[below], pairs)
        gradients = [x.T @ (p - y) + l2 * w, expected - shown + l2 * edges]
        for q, g, m, v in zip(params, gradients, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(params[0], np.exp(params[1]).tolist())


@lru_cache(maxsize=1)
def default_model() -> Model:
    return fit(labelled_pages())


def extract(model: Model, page: Column) -> Column:
    """Main text of a column of pages; empty if none."""

    @F.pandas_udf(T.StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([model.extract(p) for p in part], index=part.index, dtype="object")

    return run(page)


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``."""
    texts = pages.select(
        "page_id", "url", extract(model or default_model(), F.col("html")).alias("text")
    )
    return texts.withColumn("n_chars", F.length("text").cast("long"))
