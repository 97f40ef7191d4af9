"""Main text of web pages by a tree-structured graphical model over the DOM."""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed weights; labelled training pages; passes of training.
WEIGHTS, PAGES, PASSES = 1 << 14, 600, 12

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<([a-zA-Z][^\s/>]*)([^>]*)>?", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
# Fixed values of HTML: elements without content, with raw text, without visible text, inline ones, and those that an opening tag ends.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("template select optgroup option datalist button annotation".split())
_RAW_TEXT = frozenset("script style textarea title iframe xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img object canvas audio video select optgroup option datalist button math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace mpadded mphantom mtable mtr mtd semantics annotation svg g text tspan path".split())
_BLOCK_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


@dataclass
class Node:
    """A block element, or a run of text inside one (tag '#text')."""

    tag: str
    parent: int
    names: tuple[str, ...] = ()
    text: list[str] = field(default_factory=list)
    linked: int = 0


def parse(source: str) -> list[Node]:
    """The block elements and text runs of a page in page order, each after its parent; node 0 is the page."""
    nodes = [Node("#page", -1)]
    # open elements: (tag, node of the enclosing block, text depth inside links, hidden)
    stack: list[tuple[str, int]] = [("#page", 0)]
    places: dict[str, list[int]] = {}  # where in the stack elements of a tag are
    run = -1  # the text run that takes more text, if any
    links = 0
    hidden = 0
    at, end = 0, len(source)

    def say(text: str) -> None:
        nonlocal run
        if hidden or not text:
            return
        if run < 0:
            if not text.strip():
                return
            nodes.append(Node("#text", stack[-1][1]))
            run = len(nodes) - 1
        nodes[run].text.append(text)
        if links:
            nodes[run].linked += len(text.strip())

    def close(tag: str, scope: set[str] | frozenset[str] = frozenset()) -> None:
        """End the innermost element of a tag and all in it, unless one of the tags of scope is open inside it."""
        nonlocal run, links, hidden
        if not places.get(tag):
            return
        k = places[tag][-1]
        if any(places[s][-1] > k for s in scope if places.get(s)):
            return
        for t, _ in stack[k:]:
            places[t].pop()
            links -= t == "a"
            hidden -= t in _RAW
            if t not in _INLINE:
                run = -1
        del stack[k:]

    def enter(tag: str, node: int) -> None:
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, node))

    while at < end:
        m = _TOKEN.search(source, at)
        if not m:
            say(entities.unescape(source[at:]))
            break
        if m.start() > at:
            say(entities.unescape(source[at : m.start()]))
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                say(" ")
            elif tag in _INLINE:
                close(tag, _BLOCK_CLOSES_P)
            elif tag not in _VOID:
                close(tag)
            continue
        tag, attrs = (m[2], m[3]) if m[2] else (m[4], m[5])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            say(" ")
            continue
        if tag in _VOID:
            if tag not in _INLINE:
                run = -1
            continue
        if tag in _RAW_TEXT:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            closing = source.find(">", stop.start()) if stop else -1
            at = (closing + 1 or end) if stop else end
            if tag not in ("script", "style"):
                run = -1
            continue
        if tag in _BLOCK_CLOSES_P:
            close("p", {"table", "button"})
        if tag in _SAME:
            for other in _SAME[tag]:
                close(other, _SCOPE[tag])
        if (attrs or "").rstrip().endswith("/") and tag not in _INLINE:
            run = -1
            continue
        if tag in _INLINE:
            enter(tag, stack[-1][1])
            links += tag == "a"
            hidden += tag in _RAW
            continue
        run = -1
        if tag in ("html", "body", "head"):  # they say nothing: what they hold belongs to the page
            continue
        names: list[str] = []
        if attrs:
            for a in _ATTR.finditer(attrs):
                key = a[1].lower()
                value = entities.unescape(a[2] or a[3] or a[4] or "")
                if key in ("class", "id", "role", "itemprop"):
                    names += [x for x in _NAME.findall(value.lower())]
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    names.append("#hidden")
        nodes.append(Node(tag, stack[-1][1], tuple(names)))
        enter(tag, len(nodes) - 1)
        hidden += tag in _RAW
    return nodes


# Words in class, id and role that tell page furniture and content apart; features besides the names themselves.
_FURNITURE = frozenset("nav menu header footer sidebar side aside widget banner ad ads advert advertisement promo sponsor sponsored cookie cookies consent notice alert popup modal overlay newsletter subscribe signup share social related recommended more breadcrumb breadcrumbs pagination pager comment comments reply replies respond disqus form search login toolbar masthead copyright legal disclaimer tags meta byline hidden teaser outbrain taboola".split())
_CONTENT = frozenset("article content main post entry story body text prose blog hentry page markdown".split())


def features(nodes: list[Node]) -> list[list[str]]:
    """Names of the features of each node."""
    sizes, linked, blocks = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    texts = [_SPACE.sub(" ", "".join(n.text)).strip() if n.tag == "#text" else "" for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        n = nodes[i]
        if n.tag == "#text":
            sizes[i], linked[i], blocks[i] = len(texts[i]), min(n.linked, len(texts[i])), 1
        sizes[n.parent] += sizes[i]
        linked[n.parent] += linked[i]
        blocks[n.parent] += blocks[i]
    out = []
    for i, n in enumerate(nodes):
        share = linked[i] / sizes[i] if sizes[i] else 0
        if n.tag == "#text":
            t = texts[i]
            up = nodes[n.parent]
            f = ["text", f"text.in={up.tag}", f"text.links={round(share * 3)}", f"text.size={min(6, int(math.log2(len(t) + 1) / 1.5))}"]
            if re.search(r"[.!?:;,。！？]", t):
                f.append("text.signs")
            if t[:1] == "©" or re.search(r"©|\ball rights reserved\b|\bcopyright\b", t.lower()):
                f.append("text.rights")
        else:
            f = ["block", f"tag={n.tag}", f"links={round(share * 3)}", f"mean={min(8, int(math.log2(sizes[i] / (blocks[i] or 1) + 1)))}"]
            told = set(n.names)
            f += [f"name={x}" for x in told]
            f += ["furniture"] if told & _FURNITURE else ["content"] if told & _CONTENT else []
            if "#hidden" in told:
                f.append("hidden")
        out.append(f)
    return out


def _ids(names: list[list[str]]) -> list[list[int]]:
    return [[zlib.crc32(x.encode()) % WEIGHTS for x in f] for f in names]


@dataclass
class TreeModel:
    """Unary weights for label 1 (content) and potentials (parent label, child label) for text and for block children."""

    weights: np.ndarray
    edges: np.ndarray  # 2 kinds x 2 x 2


def beliefs(unary: list[float], parents: list[int], kinds: list[int], edges: np.ndarray, pairs: bool = False):
    """P(label 1) of every node by sum-product: messages upward, then downward; nodes come after their parents.

    With pairs also the expected count of each (kind, parent label, child label).
    """
    m = np.exp(edges).tolist()
    n = len(unary)
    own = [math.exp(max(-20.0, min(20.0, u))) for u in unary]
    up = [1.0] * n  # message to the parent, as odds
    inner = own[:]  # own odds times messages of the children
    for i in range(n - 1, 0, -1):
        e, x = m[kinds[i]], min(1e15, max(1e-15, inner[i]))
        up[i] = (e[1][0] + e[1][1] * x) / (e[0][0] + e[0][1] * x)
        p = parents[i]
        inner[p] = min(1e15, max(1e-15, inner[p] * up[i]))
    full = inner[:]
    counts = np.zeros((2, 2, 2))
    for i in range(1, n):
        e = m[kinds[i]]
        rest = min(1e15, max(1e-15, full[parents[i]] / up[i]))
        down = (e[0][1] + e[1][1] * rest) / (e[0][0] + e[1][0] * rest)
        full[i] = min(1e15, max(1e-15, inner[i] * down))
        if pairs:
            c = np.array([[e[0][0], e[0][1] * inner[i]], [e[1][0] * rest, e[1][1] * rest * inner[i]]])
            counts[kinds[i]] += c / c.sum()
    p = [x / (1 + x) for x in full]
    return (p, counts) if pairs else p


def training_pages(n: int = PAGES, seed: int = 7) -> list[tuple[list[Node], list[int]]]:
    """Labelled pages: random layouts in which the nodes of the article carry the mark data-y in their names (taken out here)."""
    rng = random.Random(seed)
    syllables = "an be co da el fi ga ho in ju ka lo mi no or pe qu ra si ta un ve wa xi yo zu".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def words(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(rng.randint(lo, hi)))

    def sentence() -> str:
        return words(3, 16).capitalize() + rng.choice(".....?!")

    def para(lo: int = 1, hi: int = 5) -> str:
        return " ".join(sentence() for _ in range(rng.randint(lo, hi)))

    def menu() -> str:
        items = "".join(f'<li><a href="/{word()}">{words(1, 2)}</a></li>' for _ in range(rng.randint(2, 8)))
        return f"<ul>{items}</ul>" if rng.random() < 0.7 else "".join(f'<a href="#">{words(1, 2)}</a> | ' for _ in range(5))

    def furniture() -> str:
        kind = rng.randrange(12)
        name = lambda *x: f' {rng.choice(("class", "id"))}="{rng.choice(x)}"'
        small = rng.choice((para(1, 2), words(2, 6), para(1, 3)))
        return [
            lambda: f"<nav>{menu()}</nav>",
            lambda: f"<div{name('menu', 'navbar', 'main-nav', 'breadcrumbs', 'top-menu', 'navigation')}>{menu()}</div>",
            lambda: f"<aside{name('sidebar', 'widget-area', 'related')}><h3>{words(1, 3)}</h3>{menu()}<p>{para(1, 2)}</p></aside>",
            lambda: f"<div{name('ad', 'ads', 'advert', 'ad-banner', 'sponsored', 'promo', 'advertisement')}>{small}</div>",
            lambda: f"<div{name('cookie-notice', 'cookie-banner', 'consent', 'notice', 'alert', 'gdpr-notice')}><p>{para(1, 3)}</p></div>",
            lambda: f"<section{name('comments', 'comment-list', 'respond', 'comment-section', 'disqus-comments')}><h2>{words(1, 2)}</h2>" + "".join(f'<div class="comment"><b>{word()}</b><p>{para(1, 3)}</p></div>' for _ in range(rng.randint(1, 4))) + "</section>",
            lambda: f"<form{name('search', 'newsletter', 'login', 'signup')}><label>{words(1, 3)}</label><input><p>{para(1, 1)}</p></form>",
            lambda: f"<div{name('sidebar', 'side', 'widget', 'sidebar-right')}><h4>{words(1, 3)}</h4><p>{para(1, 3)}</p>{menu()}</div>",
            lambda: f"<div{name('related', 'recommended', 'more-stories', 'related-posts')}><h3>{words(1, 3)}</h3>{menu()}</div>",
            lambda: f"<div{name('share', 'social', 'social-share', 'newsletter', 'subscribe', 'popup')}>{small}</div>",
            lambda: f"<ol{name('comments', 'commentlist')}>" + "".join(f"<li>{para(1, 3)}</li>" for _ in range(rng.randint(1, 4))) + "</ol>",
            lambda: f"<div{name('byline', 'meta', 'tags', 'post-meta', 'pagination')}>{words(2, 5)}</div>",
        ][kind]()

    def y(tag: str, inner: str, extra: str = "") -> str:
        return f'<{tag} role="yyy{extra}">{inner}</{tag}>'

    def body() -> str:
        parts = [y("h1", words(2, 8))] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 9)):
            r = rng.random()
            if r < 0.66:
                text = para()
                if rng.random() < 0.2:
                    text = text.replace(" ", f' <a href="/{word()}">{word()}</a> ', 1)
                parts.append(y("p", rng.choice(("", "<b>")) + text))
            elif r < 0.74:
                parts.append(y("h2", words(1, 6)))
            elif r < 0.82:
                parts.append(y("ul", "".join(y("li", rng.choice((words(1, 6), para(1, 2)))) for _ in range(rng.randint(2, 5)))))
            elif r < 0.88:
                parts.append(y("blockquote", y("p", para(1, 3))))
            elif r < 0.92:
                parts.append(y("table", y("tr", y("td", words(1, 3)) + y("td", words(1, 4)))))
            elif r < 0.95:
                parts.append(y("pre", words(2, 10)))
            elif r < 0.98:
                parts.append(y("p", words(1, 4)))
            else:
                parts.append(y("div", para(1, 4)))
            if rng.random() < 0.08:
                parts.append(furniture())
        return "".join(parts)

    out = []
    for _ in range(n):
        box = rng.randrange(10)
        inner = body()
        name = rng.choice(("content", "main", "post", "entry-content", "article-body", "story", "post-content", "text"))
        main = [
            lambda: y("article", inner),
            lambda: f"<main>{y('article', inner)}{furniture() if rng.random() < 0.3 else ''}</main>",
            lambda: y("main", inner),
            lambda: f'<div role="yyy" class="{name}">{inner}</div>',
            lambda: f'<div id="wrapper">{furniture()}<div role="yyy" class="{name}">{inner}</div>{furniture()}</div>',
            lambda: y("section", inner, " article"),
            lambda: f'<article role="yyy" class="{name}">{inner}</article>',
            lambda: inner,
            lambda: y("div", inner),
            lambda: y("p", para(1, 6)) + inner if rng.random() < 0.5 else f'<div role="yyy" class="{word()}">{para(1, 6)}</div>',
        ][box]()
        top = "".join(furniture() for _ in range(rng.randint(0, 3)))
        low = "".join(furniture() for _ in range(rng.randint(0, 3)))
        head = f"<header><h2>{words(1, 3)}</h2>{menu() if rng.random() < 0.5 else words(2, 6)}</header>" if rng.random() < 0.6 else f'<div class="{rng.choice(("header", "site-header", "masthead", "banner"))}">{words(1, 4)}</div>'
        foot = f"<footer>{rng.choice(('&copy; ', ''))}{para(1, 2)}{menu() if rng.random() < 0.3 else ''}</footer>" if rng.random() < 0.7 else f'<div class="{rng.choice(("footer", "site-footer", "copyright"))}"><p>&copy; {para(1, 2)}</p></div>'
        if rng.random() < 0.12:
            head = top = low = foot = ""
        nodes = parse(f"<html><head><title>{words(2, 5)}</title></head><body>{head}{top}{main}{low}{foot}</body></html>")
        labels = []
        for i, node in enumerate(nodes):
            labels.append(int("yyy" in node.names if node.tag != "#text" else "yyy" in nodes[node.parent].names and labels[node.parent] == 1))
            if node.tag == "#text":
                labels[i] = labels[node.parent]
        for node in nodes:
            node.names = tuple(x for x in node.names if x != "yyy")
        out.append((nodes, labels))
    return out


def train(pages: list[tuple[list[Node], list[int]]] | None = None, passes: int = PASSES) -> TreeModel:
    """Gradient ascent on the conditional likelihood of the labels of labelled pages (PAGES made-up ones by default)."""
    pages = training_pages() if pages is None else pages
    model = TreeModel(np.zeros(WEIGHTS), np.zeros((2, 2, 2)))
    squares, e_squares = np.full(WEIGHTS, 1e-2), np.full((2, 2, 2), 1e-2)
    ready = []
    for nodes, labels in pages:
        ids = _ids(features(nodes))
        of = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        told = np.zeros((2, 2, 2))
        for i in range(1, len(nodes)):
            told[int(nodes[i].tag != "#text"), labels[nodes[i].parent], labels[i]] += 1
        ready.append((np.array([x for f in ids for x in f]), of, [n.parent for n in nodes], [int(n.tag != "#text") for n in nodes], np.array(labels), told))
    rng = np.random.default_rng(3)
    for _ in range(passes):
        for k in rng.permutation(len(ready)):
            flat, of, parents, kinds, y, told = ready[k]
            unary = np.bincount(of, model.weights[flat], len(y))
            p, counts = beliefs(unary.tolist(), parents, kinds, model.edges, pairs=True)
            g = np.bincount(flat, (y - np.array(p))[of], WEIGHTS)
            at = np.unique(flat)
            g = g[at] - 0.002 * model.weights[at]
            squares[at] += g * g
            model.weights[at] += 0.5 * g / np.sqrt(squares[at])
            ge = told - counts - 0.01 * model.edges
            e_squares += ge * ge
            model.edges += 0.3 * ge / np.sqrt(e_squares)
    return model


@functools.cache
def default_model() -> TreeModel:
    """The model of the made-up pages, fitted once in a driver's life."""
    return train()


def main_text(source: str, model: TreeModel, cache: dict[str, float] | None = None) -> tuple[str, float]:
    """The content blocks of a page joined by newlines, and the mean marginal of its text runs that were kept."""
    nodes = parse(source)
    cache = {} if cache is None else cache
    unary = []
    for names in features(nodes):
        total = 0.0
        for x in names:
            v = cache.get(x)
            if v is None:
                if len(cache) > 200_000:
                    cache.clear()
                v = cache[x] = float(model.weights[zlib.crc32(x.encode()) % WEIGHTS])
            total += v
        unary.append(total)
    p = beliefs(unary, [n.parent for n in nodes], [int(n.tag != "#text") for n in nodes], model.edges)
    kept, sure = [], 0.0
    for n, q in zip(nodes, p, strict=True):
        if n.tag == "#text" and q > 0.5:
            text = _SPACE.sub(" ", "".join(n.text)).strip()
            if text:
                kept.append(text)
                sure += q
    return "\n".join(kept), sure / len(kept) if kept else 0.0


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """Add text (main text), n_chars (its code points) and sureness to pages, whose html goes; one row per row.

    Null and empty html give an empty text.  Pages are independent: repeated rows, ties and nulls in other columns change nothing; an empty
    table gives an empty result; columns of pages with names of added columns give way.
    """
    model = default_model() if model is None else model
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.drop("text", "n_chars", "sureness")
    kept = [f for f in rows.schema if f.name != "html"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "text string, n_chars long, sureness double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = shared.value, {}
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                found = [main_text(x.as_py() or "", m, cache) for x in part["html"]]
                cols = [part[f.name] for f in kept]
                cols += [pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*[f.name for f in kept], "text", "n_chars", "sureness"])

    return rows.mapInArrow(run, schema)
