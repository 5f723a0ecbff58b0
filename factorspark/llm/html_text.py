"""Main text of web pages by a tree-structured model: content marginals of DOM nodes by sum-product messages."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import small_batches

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
#: A start tag of the key closes these open elements, unless one of the fences lies between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "body": ("head",)}
FENCES = frozenset("ul ol dl table select article section aside nav div form body".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-label)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PART = re.compile(r"[a-z]+")


@dataclass
class Node:
    """An element that isn't inline, or a run of text in one (tag "#text")."""

    tag: str
    parent: int
    hints: tuple[str, ...] = ()
    text: str = ""
    linked: int = 0
    children: list[int] = field(default_factory=list)


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents before children; node 0 is the root.

    Broken markup is mended as browsers do in the common cases: missing ends are implied, stray ends ignored, an
    unclosed raw element or comment takes the rest of the page.
    """
    nodes = [Node("#root", -1)]
    stack: list[tuple[str, int]] = [("#root", 0)]     # open elements with the node that holds them
    run: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                at = stack[-1][1]
                nodes[at].children.append(len(nodes))
                nodes.append(Node("#text", at, (), text, min(linked, len(text))))
        linked = 0

    def close(k: int) -> None:
        nonlocal links
        for tag, _ in stack[k:]:
            links -= tag == "a"
        if any(tag not in INLINE for tag, _ in stack[k:]):
            flush()
        del stack[k:]

    def words(raw: str) -> None:
        nonlocal linked
        if raw:
            if "&" in raw:
                raw = html.unescape(raw)
            run.append(raw)
            if links:
                linked += len(raw.strip())

    end, size = 0, len(page)
    while end < size:
        m = TAG.search(page, end)
        if m is None:
            words(page[end:])
            break
        words(page[end:m.start()])
        end = m.end()
        tag = m[2].lower() if m[2] else None
        if tag is None:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break                              # an inline end doesn't close a block
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, end)
            end = stop.start() if stop else size
            continue
        if tag not in INLINE:
            for k in range(len(stack) - 1, 0, -1):     # a block closes an open paragraph
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        for k in range(len(stack) - 1, 0, -1) if tag in CLOSES else ():
            if stack[k][0] in CLOSES[tag]:
                close(k)
                break
            if stack[k][0] in FENCES:
                break
        if tag == "br":
            run.append(" ")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in INLINE:
            links += tag == "a"
            stack.append((tag, stack[-1][1]))
            continue
        flush()
        hints = []
        for a in ATTR.finditer(m[3]) if m[3] else ():
            value = (a[2] or a[3] or a[4] or "").lower()
            hints += [f"{a[1].lower()}"] if a[1].lower() == "hidden" else PART.findall(value)
        at = stack[-1][1]
        nodes[at].children.append(len(nodes))
        nodes.append(Node(tag, at, tuple(dict.fromkeys(hints))))
        if not m[3].rstrip().endswith("/") or tag not in ("path", "rect", "circle"):
            stack.append((tag, len(nodes) - 1))
    flush()
    return nodes


def leaf_features(node: Node) -> tuple[str, ...]:
    n = len(node.text)
    share = node.linked / n if n else 0
    size = min(n.bit_length(), 10)
    ends = node.text[-1] in ".!?\"'»”" if n else False
    return (f"size={size}", f"link={'none' if share == 0 else 'some' if share < 0.5 else 'most'}", f"ends={ends}",
            f"link={share >= 0.5}&long={n > 80}")


def node_features(node: Node) -> tuple[str, ...]:
    if node.tag == "#text":
        return leaf_features(node)
    return (f"tag={node.tag}", f"tag={node.tag}&plain={not node.hints}", *[f"hint={h}" for h in node.hints])


def kind(node: Node) -> str:
    """What the tables of parent and child tell apart."""
    return node.tag if node.tag in KINDS else "other"


KINDS = frozenset("#text article main section div p ul ol li nav aside header footer form h1 h2 h3 table blockquote".split())


@dataclass
class Model:
    """Log-odds of features for a node's own potential, and log-potentials of (parent, child) states by the child's kind."""

    bias: float
    weights: dict[str, float]
    edges: dict[str, tuple]
    own: dict[tuple, float] = field(default_factory=dict)

    def potential(self, node: Node) -> float:
        if node.tag == "#text":
            return self.bias + sum(self.weights.get(f, 0.0) for f in leaf_features(node))
        key = (node.tag, node.hints)
        if key not in self.own:
            if len(self.own) > 100_000:
                self.own.clear()
            self.own[key] = self.bias + sum(self.weights.get(f, 0.0) for f in node_features(node))
        return self.own[key]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Log-odds that each node is content: messages from the leaves up to the root and back down."""
        table = [self.edges[kind(n)] for n in nodes]
        own = [self.potential(n) for n in nodes]
        belief = own[:]                  # own potential and the messages of the children, as log-odds
        up = [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            (a, b), (c, d) = table[i]    # (parent 0: child 0, 1), (parent 1: child 0, 1)
            x = belief[i]
            up[i] = _lse(c, d + x) - _lse(a, b + x)
            belief[nodes[i].parent] += up[i]
        out = belief[:]
        for i in range(1, len(nodes)):
            (a, b), (c, d) = table[i]
            x = out[nodes[i].parent] - up[i]
            out[i] = belief[i] + _lse(b, d + x) - _lse(a, c + x)
        return out


def _lse(a: float, b: float) -> float:
    return a + _log1pexp(b - a)


def _log1pexp(x: float) -> float:
    return x if x > 35 else float(np.log1p(np.exp(x))) if x > -35 else 0.0


# ---- labelled pages ----

MARK = "x-main"
_WORDS = "time river paper house light value story field music water people market garden summer window letter school number".split()


def labelled_pages(count: int = 240, seed: int = 3) -> list[str]:
    """Pages put together from common layouts by rule; an ``itemprop`` of ``x-main`` labels each content block.

    ``_labelled`` reads the marks and takes them away before any feature is made.
    """
    rng = np.random.default_rng(seed)

    def pick(items):
        return items[int(rng.integers(len(items)))]

    def words(low: int, high: int) -> str:
        return " ".join(pick(_WORDS) for _ in range(int(rng.integers(low, high))))

    def sentence(low: int = 6, high: int = 40) -> str:
        return words(low, high).capitalize() + pick([".", ".", ".", "", "!"])

    def links(low: int, high: int) -> str:
        return "".join(f"<li><a href='/'>{words(1, 4)}</a></li>" for _ in range(int(rng.integers(low, high))))

    def content() -> str:
        def one() -> str:
            k = int(rng.integers(12))
            if k == 0:
                return f"<ul itemprop='{MARK}'>" + "".join(f"<li itemprop='{MARK}'>{sentence(2, 20)}</li>" for _ in range(3)) + "</ul>"
            if k == 1:
                return f"<h2 itemprop='{MARK}'>{words(2, 7).capitalize()}</h2>"
            if k == 2:
                return f"<blockquote itemprop='{MARK}'><p itemprop='{MARK}'>{sentence()}</p></blockquote>"
            if k == 3:
                return (f"<table itemprop='{MARK}'><tr itemprop='{MARK}'><td itemprop='{MARK}'>{words(1, 4)}</td>"
                        f"<td itemprop='{MARK}'>{words(1, 4)}</td></tr></table>")
            if k == 4:
                return f"<p itemprop='{MARK}'>{sentence(1, 4)}</p>"
            if k == 5:
                return f"<div itemprop='{MARK}'>{sentence()} {sentence()}</div>"
            if k == 6:
                return f"<pre itemprop='{MARK}'>{sentence()}</pre>"
            return f"<p itemprop='{MARK}'>" + " ".join(pick([sentence(), f"<a href='/'>{words(1, 3)}</a> {sentence()}"]) for _ in range(int(rng.integers(1, 7)))) + "</p>"
        title = f"<h1 itemprop='{MARK}'>{words(2, 9).capitalize()}</h1>" if rng.random() < 0.8 else ""
        return title + "".join(one() + (noise() if rng.random() < 0.06 else "") for _ in range(int(rng.integers(1, 9))))

    def noise() -> str:
        """Blocks that stand around or inside an article without being part of it."""
        return pick([
            lambda: f"<nav{pick(['', ' class=menu', ' class=breadcrumb'])}><ul>{links(2, 9)}</ul></nav>",
            lambda: f"<ul class='{pick(['menu', 'nav', 'breadcrumbs', 'share', 'tags', 'pagination'])}'>{links(2, 8)}</ul>",
            lambda: f"<div class='{pick(['menu', 'navbar', 'navigation', 'breadcrumb'])}'><ul>{links(2, 9)}</ul></div>",
            lambda: f"<header{pick(['', ' class=site-header', ' class=top'])}><h1>{words(1, 3)}</h1><p>{sentence(3, 9)}</p></header>",
            lambda: f"<div id='{pick(['header', 'masthead', 'banner', 'top'])}'><h1>{words(1, 3)}</h1><p>{sentence(3, 9)}</p></div>",
            lambda: f"<footer>{pick([sentence(4, 20), f'<p>{sentence(4, 20)}</p>'])}<ul>{links(0, 5)}</ul></footer>",
            lambda: f"<div class='{pick(['footer', 'copyright', 'legal', 'imprint', 'credits'])}'><p>{sentence(4, 25)}</p></div>",
            lambda: f"<aside{pick(['', ' class=sidebar'])}><h3>{words(1, 4)}</h3><p>{sentence()}</p><ul>{links(0, 6)}</ul></aside>",
            lambda: f"<div class='{pick(['sidebar', 'widget', 'related', 'recommended', 'teaser', 'promo'])}'><h3>{words(1, 4)}</h3><p>{sentence()}</p></div>",
            lambda: f"<div class='{pick(['ad', 'ads', 'advert', 'advertisement', 'sponsored', 'banner'])}'>{pick([sentence(), f'<p>{sentence()}</p>'])}</div>",
            lambda: f"<section class='{pick(['ad', 'promo', 'related', 'newsletter', 'sponsor'])}'><h2>{words(1, 4)}</h2><p>{sentence()}</p></section>",
            lambda: f"<div class='{pick(['cookie', 'cookie-notice', 'consent', 'notice', 'gdpr', 'alert', 'popup'])}'><p>{sentence(5, 40)}</p></div>",
            lambda: f"<div role='{pick(['alert', 'dialog', 'navigation', 'banner', 'contentinfo', 'complementary', 'search'])}'><p>{sentence(5, 30)}</p></div>",
            lambda: f"<form{pick(['', ' class=search', ' id=login'])}><p>{sentence(2, 15)}</p><label>{words(1, 3)}</label><button>{words(1, 2)}</button></form>",
            lambda: f"<form><div>{sentence(2, 15)}</div><select><option>{words(1, 2)}<option>{words(1, 2)}</select></form>",
            lambda: f"<{pick(['div', 'section'])} {pick(['id', 'class'])}='{pick(['comments', 'comment-list', 'responses', 'discussion', 'disqus'])}'><h2>{words(1, 3)}</h2>"
                    + "".join(f"<{t} class=comment><p>{sentence()}</p></{t}>" for t in [pick(["div", "article", "li"])] * int(rng.integers(1, 4))) + "</div></section>",
            lambda: f"<ol class='{pick(['comments', 'commentlist'])}'><li class=comment><div class=comment-body><p>{sentence()}</p><p>{sentence()}</p></div></li></ol>",
            lambda: f"<div class='{pick(['share', 'social', 'meta', 'byline', 'tags', 'newsletter', 'subscribe'])}'>{words(1, 8)}</div>",
        ])()

    def page() -> str:
        inner = content()
        body = pick([
            lambda: f"<article itemprop='{MARK}'>{inner}</article>",
            lambda: f"<main itemprop='{MARK}'><article itemprop='{MARK}'>{inner}</article></main>",
            lambda: f"<main itemprop='{MARK}'>{inner}</main>",
            lambda: f"<div itemprop='{MARK}' class='{pick(['content', 'post', 'entry', 'article', 'story', 'text', 'body', 'main'])}'>{inner}</div>",
            lambda: f"<div itemprop='{MARK}' id='{pick(['content', 'main', 'article', 'story'])}'><div itemprop='{MARK}' class='{pick(['post-content', 'entry-content', 'article-body', 'text'])}'>{inner}</div></div>",
            lambda: f"<section itemprop='{MARK}'>{inner}</section>",
            lambda: f"<article itemprop='{MARK}'><div itemprop='{MARK}'>{inner}</div></article>",
            lambda: f"<div itemprop='{MARK}'>{inner}</div>",
        ])()
        around = [noise() for _ in range(int(rng.integers(1, 5)))], [noise() for _ in range(int(rng.integers(1, 5)))]
        wrap = pick([("", ""), ("<div class=container>", "</div>"), ("<div id=page><div class=wrapper>", "</div></div>")])
        return f"<html><body>{''.join(around[0])}{wrap[0]}{body}{noise() if rng.random() < 0.4 else ''}{wrap[1]}{''.join(around[1])}</body></html>"
    return [page() for _ in range(count)]


def _labelled(page: str) -> tuple[list[Node], list[int]]:
    """Nodes and labels: an element is content if it is marked, a text if its element is. The marks are taken away."""
    nodes = parse(page)
    label = [0] * len(nodes)
    for i, n in enumerate(nodes):
        if n.tag == "#text":
            label[i] = label[n.parent]
        elif {"x", "main"} <= set(n.hints):
            label[i] = 1
            n.hints = tuple(h for h in n.hints if h not in ("x", "main"))
    return nodes, label


def semantic_labels(nodes: list[Node]) -> list[int] | None:
    """Labels of a page that says which part is its article; None if it doesn't say so once."""
    mains = [i for i, n in enumerate(nodes) if n.tag == "article"] or [i for i, n in enumerate(nodes) if n.tag == "main"]
    if len(mains) != 1:
        return None
    label = [0] * len(nodes)
    for i, n in enumerate(nodes):
        if i == mains[0] or i and label[n.parent] and n.tag not in ("nav", "aside", "form", "footer", "header"):
            label[i] = 1
    return label


def fit(pages: list[tuple[list[Node], list[int]]], rounds: int = 300, ridge: float = 0.3) -> Model:
    """Logistic regression for the nodes' own potentials, smoothed counts for the tables of parent and child."""
    counts: dict[str, np.ndarray] = {k: np.ones((2, 2)) for k in [*sorted(KINDS), "other"]}
    seen: dict[tuple[str, ...], list[int]] = {}        # nodes with the same features are one row with two counts
    for nodes, label in pages:
        for i, n in enumerate(nodes[1:], 1):
            counts[kind(n)][label[n.parent], label[i]] += 1
            seen.setdefault(node_features(n), [0, 0])[label[i]] += 1
    names = {f: k for k, f in enumerate(dict.fromkeys(f for row in seen for f in row))}
    x = np.zeros((len(seen), len(names)))
    for k, row in enumerate(seen):
        x[k, [names[f] for f in row]] = 1
    tally = np.array(list(seen.values()), float).reshape(-1, 2)
    total = max(tally.sum(), 1)
    w, bias = np.zeros(len(names)), 0.0
    for _ in range(rounds):
        gap = tally.sum(axis=1) / (1 + np.exp(-(x @ w + bias))) - tally[:, 1]
        w -= (x.T @ gap + ridge * w) / total * 20
        bias -= gap.sum() / total
    base = (tally.sum(axis=0) + 1) / (total + 2)
    # P(child | parent) over the child's base rate: own potentials already hold the latter
    edges = {k: np.log(c / c.sum(axis=1, keepdims=True) / base) for k, c in counts.items()}
    return Model(float(bias), {f: float(w[k]) for f, k in names.items()}, {k: tuple(map(tuple, e)) for k, e in edges.items()})


def train(pages: DataFrame | None = None, html_column: str = "html", rows: int = 300) -> Model:
    """Train on the labelled layouts and on about ``rows`` pages of the table that mark their one article themselves."""
    taught = [_labelled(page) for page in labelled_pages()]
    if pages is not None:
        n = pages.count()
        share = int(1_000_000 * min(1.0, rows / max(n, 1)))
        some = pages.where(F.pmod(F.xxhash64(html_column), F.lit(1_000_000)) < share).select(html_column).toPandas()[html_column]
        for page in sorted(p for p in some if p):
            nodes = parse(page)
            label = semantic_labels(nodes)
            if label:
                taught.append((nodes, label))
    return fit(taught)


def main_text(page: str | None, model: Model) -> str:
    """Content blocks in page order, joined by an empty line; white space inside a block is one space."""
    nodes = parse(page or "")
    if len(nodes) == 1:
        return ""
    odds = model.marginals(nodes)
    return "\n\n".join(n.text for n, x in zip(nodes, odds) if n.tag == "#text" and x > 0)


def extractor(spark, model: Model):
    """A column function html -> main text (null and empty pages: empty)."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def extract(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in parts:
            yield pd.Series([main_text(p, sent.value) for p in pages], dtype=object)
    return extract
