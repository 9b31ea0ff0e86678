"""Main text of HTML pages: boosted trees over DOM nodes, decoded down the tree.

A tolerant reader builds the tree of block elements; raw and hidden elements are skipped,
inline ones add their text to the block around them. Trees score each node by text and
link density of its subtree, tag and attribute tokens, depth and siblings. Decoding picks
the labels of least total loss among those in which a dropped node has no kept node
below it, so that ancestors and descendants agree. Kept blocks of text, each with its
white space as single spaces and references decoded, are joined in page order by line feeds.

The trees learn from pages that ``page_maker`` writes: common layouts with known main text
(``TRAINING_PAGES`` of them, from a fixed seed), as the table of pages has no labels.

Null and empty pages, and pages without main text, give an empty text; repeated rows are
read alike; an empty table has no texts; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import slices

TRAINING_PAGES = 700
#: HTML's kinds of elements.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br picture source".split())
#: Drawings: their words are text of the block around them.
INLINE |= frozenset("canvas svg g defs text tspan textpath path rect circle ellipse line polyline polygon use symbol lineargradient radialgradient stop clippath mask filter foreignobject desc".split())
#: MathML: a formula is text of the block around it.
INLINE |= frozenset("math semantics annotation annotation-xml maction merror mfrac mfenced menclose mglyph mi mlabeledtr mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe head select option button".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An open element of the second kind keeps the first kind from being closed across it.
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Comments, tags and declarations. Each alternative runs to the page's end if nothing closes it, and gives nothing
#: back, so that every character is read a bounded number of times.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
#: Ends of sentences in Chinese, Japanese, Hindi, Arabic, Urdu, Armenian and Ethiopic.
_STOPS = re.compile("[。！？｡।॥؟۔։።]")
#: The same where quotes of attributes do not close: a tag ends at the next ">".
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|aria-label|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")


class Node:
    __slots__ = ("tag", "tokens", "up", "depth", "place", "kids", "chars", "linked", "ends", "below")

    def __init__(self, tag: str, tokens: tuple, up: int, depth: int, place: int):
        self.tag, self.tokens, self.up, self.depth, self.place = tag, tokens, up, depth, place
        self.kids = self.chars = self.linked = self.ends = self.below = 0


def _tokens(page: str) -> Iterator[re.Match]:
    """Comments, tags and declarations in page order.

    A tag that quotes keep open to the end is read again without heed to quotes, as are all
    after it; one that nothing closes is text, as is all after it.
    """
    for m in _TOKEN.finditer(page):
        if m[2] is not None and not m[4]:
            for p in _PLAIN.finditer(page, m.start()):
                if p[2] is not None and not p[4]:
                    return
                yield p
            return
        yield m


def read_page(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes in page order, each after its parent, and blocks of text as (node, text)."""
    nodes = [Node("#", (), -1, 0, 0)]
    blocks: list[tuple[int, str]] = []
    stack, pieces, links, linked, at, end = [0], [], 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                node = nodes[stack[-1]]
                node.chars += len(text)
                node.linked += min(linked, len(text))
                node.ends += text.count(". ") + text.count("! ") + text.count("? ") + (text[-1] in ".!?") + len(_STOPS.findall(text))
                blocks.append((stack[-1], text))
        linked = 0

    # open elements by tag, and raw tags that nothing closes any more: neither is looked for in vain
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()

    def close(to: int) -> None:
        flush()
        for k in stack[to:]:
            opened[nodes[k].tag] -= 1
        del stack[to:]

    for m in _tokens(page):
        if m.start() < at:
            continue
        if m.start() > at:
            text = page[at : m.start()]
            pieces.append(text)
            if links:
                linked += len(text)
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            if tag in INLINE:
                if tag == "a":
                    links = 0
            elif opened[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag == tag:
                        close(k)
                        links = 0
                        break
            continue
        if tag in INLINE:
            if tag == "a":
                links = 1
            elif tag in ("br", "mtd"):
                pieces.append(" ")
            if tag not in RAW:
                continue
        if tag in RAW and tag != "head":
            flush()
            if not m[3].endswith("/"):
                stop = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if stop:
                    at = stop.end()
                else:
                    unclosed.add(tag)
                    at = end if tag in ("script", "style", "textarea", "title") else at
            continue
        flush()
        if tag in VOID:
            continue
        links = 0
        if tag in CLOSES_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == "p":
                    close(k)
                    break
                if nodes[stack[k]].tag in ("table", "td", "th", "li", "div", "article", "section"):
                    break
        if tag in ENDS:
            left = sum(opened[x] for x in ENDS[tag])
            for k in range(len(stack) - 1, 0, -1):
                if not left or nodes[stack[k]].tag in BOUNDS[tag]:
                    break
                if nodes[stack[k]].tag in ENDS[tag]:
                    close(k)
                    left = sum(opened[x] for x in ENDS[tag])
        tokens: tuple = ()
        if len(m[3]) > 3:
            found = []
            for a in _ATTRIBUTE.finditer(m[3]):
                kind, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if kind == "hidden":
                    found.append("hidden")
                elif kind == "style":
                    if "none" in value and "display" in value:
                        found.append("hidden")
                else:
                    found += [x.lower() for x in _WORDS.findall(value)]
            tokens = tuple(found)
        up = stack[-1]
        nodes[up].kids += 1
        nodes.append(Node(tag, tokens, up, len(stack), nodes[up].kids))
        stack.append(len(nodes) - 1)
        opened[tag] += 1
    if at < end:
        pieces.append(page[at:])
    flush()
    return nodes, blocks


N_FEATURES = 24


class Lexicon:
    """How much a tag or attribute token speaks for main text: shares learned from training pages."""

    def __init__(self, nodes: list[Node], keep: np.ndarray):
        self.values = {}
        seen: dict[tuple, list] = {}
        for n, y in zip(nodes, keep.tolist(), strict=True):
            for key in {("t", n.tag), *(("a", x) for x in n.tokens)}:
                pair = seen.setdefault(key, [0, 0])
                pair[y] += 1
        self.values = {k: float(np.log((b + 0.5) / (a + 0.5))) for k, (a, b) in seen.items() if a + b >= 4}


def describe(pages: list[list[Node]], lexicon: dict) -> np.ndarray:
    """Features of all nodes of the pages."""
    rows = []
    for nodes in pages:
        n = len(nodes)
        chars, linked, ends, blocks, below = ([0] * n for _ in range(5))
        low, high, items, paragraphs = [0.0] * n, [0.0] * n, [0] * n, [0] * n
        own = [0.0] * n
        path = [0.0] * n
        before = 0
        starts = [0] * n
        for k, x in enumerate(nodes):
            starts[k] = before
            before += x.chars
            chars[k], linked[k], ends[k], blocks[k] = x.chars, x.linked, x.ends, int(x.chars > 0)
            items[k], paragraphs[k] = int(x.tag == "li"), int(x.tag == "p")
            own[k] = lexicon.get(("t", x.tag), 0.0)
            found = [lexicon.get(("a", t), 0.0) for t in x.tokens]
            if found:
                low[k], high[k] = min(found), max(found)
            path[k] = min(path[x.up], low[k], own[k]) if x.up >= 0 else 0.0
        for k in range(n - 1, 0, -1):
            u = nodes[k].up
            chars[u] += chars[k]
            linked[u] += linked[k]
            ends[u] += ends[k]
            blocks[u] += blocks[k]
            items[u] += items[k]
            paragraphs[u] += paragraphs[k]
            below[u] += 1 + below[k]
        total = max(1, chars[0])
        for k, x in enumerate(nodes):
            u = max(x.up, 0)
            c = chars[k]
            rows.append((
                own[k], low[k], high[k], path[k], own[u], low[u], high[u], path[u], x.depth, x.place, nodes[u].kids, x.kids,
                c, c / total, linked[k] / (c + 1), ends[k] / (c + 1) * 100, c / (blocks[k] + 1), c / (below[k] + 1),
                items[k] / (below[k] + 1), paragraphs[k], chars[u] / total, linked[u] / (chars[u] + 1), starts[k] / total, c / (chars[u] + 1),
            ))
    return np.array(rows, np.float64).reshape(-1, N_FEATURES)


class Boosted:
    """Gradient boosting of depth-limited trees for a logistic loss, on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 32, least: int = 8):
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        b = self.bin(x)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees, self.depth = [], depth
        z = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 0.5 * (1 + np.tanh(z / 2))
            tree = self._grow(b, p - y, p * (1 - p), depth, bins, least)
            self.trees.append((tree[0], tree[1], rate * tree[2]))
            z += self._apply(self.trees[-1], b)

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], 1).astype(np.int16)

    @staticmethod
    def _grow(b, g, h, depth, bins, least):
        n_nodes = (1 << depth) - 1
        feature, cut = np.zeros(n_nodes, np.int16), np.full(n_nodes, bins, np.int16)
        at = np.zeros(len(g), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-6)
            cell = (at - first) * (bins + 1)
            for f in range(b.shape[1]):
                k, size = cell + b[:, f], width * (bins + 1)
                sums = [np.bincount(k, w, size).reshape(width, -1) for w in (g, h, None)]
                left = [np.cumsum(s, 1)[:, :-1] for s in sums]
                whole = [s.sum(1, keepdims=True) for s in sums]
                right = [w - s for w, s in zip(whole, left, strict=True)]
                gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - whole[0] ** 2 / (whole[1] + 1)
                gain[(left[2] < least) | (right[2] < least)] = 0
                where = gain.argmax(1)
                top = gain[np.arange(width), where]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better] = f
                cut[first : first + width][better] = where[better]
            at = 2 * at + 1 + (b[np.arange(len(at)), feature[at]] > cut[at])
        leaf = at - n_nodes
        value = -np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + 1)
        return feature, cut, value

    def _apply(self, tree, b):
        feature, cut, value = tree
        at, row = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(self.depth):
            at = 2 * at + 1 + (b[row, feature[at]] > cut[at])
        return value[at - len(feature)]

    def output(self, x: np.ndarray) -> np.ndarray:
        b = self.bin(x)
        z = np.full(len(x), self.base)
        for tree in self.trees:
            z += self._apply(tree, b)
        return z


#: Log odds of a tag or attribute token at which what lies below is taken for junk by its name alone,
#: and the share of a block's characters that lie in links at which it is a list of links.
JUNK, LINKED = -3.0, 0.5


def plain_page(nodes: list[Node], path: np.ndarray, blocks: list[tuple[int, str]]) -> list[bool]:
    """What to keep of a page of which decode() keeps no text: if no text lies below a name that
    tells of junk, all but lists of links; else nothing."""
    if any(path[k] <= JUNK for k, _ in blocks):
        return [False] * len(nodes)
    return [x.linked < LINKED * max(1, x.chars) for x in nodes]


def decode(nodes: list[Node], z: np.ndarray) -> list[bool]:
    """Keep or drop for each node: the best sum of log odds with nothing kept below a dropped node.

    The root is always kept; the log odds count by text, so that empty nodes have little say.
    """
    n = len(nodes)
    gain = np.clip(z, -12, 12).tolist()
    gain[0] = 0.0
    for k in range(n - 1, 0, -1):  # gain[k]: of keeping k and the best below it
        if gain[k] > 0:
            gain[nodes[k].up] += gain[k]
    keep = [True] * n
    for k in range(1, n):
        keep[k] = keep[nodes[k].up] and gain[k] > 0
    return keep


class Extractor:
    def __init__(self, pages: int = TRAINING_PAGES, seed: int = 11):
        trees, labels = [], []
        for page, main in page_maker(pages, seed):
            nodes, blocks = read_page(page)
            good = [False] * len(nodes)
            for node, text in blocks:
                if text in main:
                    good[node] = True
            for k in range(len(nodes) - 1, 0, -1):
                if good[k]:
                    good[nodes[k].up] = True
            trees.append(nodes)
            labels += good
        y = np.array(labels, int)
        self.lexicon = Lexicon([x for t in trees for x in t], y).values
        self.model = Boosted(describe(trees, self.lexicon), y.astype(float))

    def extract(self, pages: list[str | None]) -> list[str]:
        read = [read_page(x or "") for x in pages]
        if not read:
            return []
        features = describe([x[0] for x in read], self.lexicon)
        z = self.model.output(features)
        out, at = [], 0
        for nodes, blocks in read:
            keep = decode(nodes, z[at : at + len(nodes)])
            if not any(keep[k] for k, _ in blocks):
                keep = plain_page(nodes, features[at : at + len(nodes), 3], blocks)
            at += len(nodes)
            out.append("\n".join(text for node, text in blocks if keep[node]))
        return out


def page_maker(n: int, seed: int) -> Iterator[tuple[str, set[str]]]:
    """Pages in common layouts, each with the blocks of its main text."""
    rng = np.random.default_rng(seed)
    some = lambda x: x[int(rng.integers(len(x)))]
    chance = lambda p: rng.random() < p
    syllables = "ta re mi ko an el or us in ve la sto qui ber ent ou th er ch ng é ü ñ".split()

    def word() -> str:
        return "".join(some(syllables) for _ in range(int(rng.integers(1, 4))))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(int(rng.integers(a, b))))

    def sentence() -> str:
        text = words(3, 16) + some([".", ".", ".", "!", "?"])
        return text[:1].upper() + text[1:]

    def prose(a: int, b: int) -> str:
        return " ".join(sentence() for _ in range(int(rng.integers(a, b))))

    def names(kinds: list[str]) -> str:
        word_of = some(kinds)
        forms = [word_of, f"{some(['site', 'page', 'main', 'js', 'c', 'x', 'block', 'top'])}-{word_of}", f"{word_of}-{some(['box', 'wrap', 'inner', 'area', 'block', 'list', 'container'])}", word_of]
        return some([f' class="{some(forms)}"', f' id="{some(forms)}"', f' class="{some(forms)} {some(["col", "row", "wide", "clearfix"])}"'])

    def links(k: int) -> str:
        made = [f'<a href="/{word()}">{words(1, 4)}</a>' for _ in range(k)]
        return some(["<ul>" + "".join(f"<li>{x}</li>" for x in made) + "</ul>", " | ".join(made), "".join(f"<div>{x}</div>" for x in made)])

    def junk(kind: str) -> str:
        if kind == "menu":
            tag, attrs = some([("nav", ""), ("nav", names(["nav", "menu"])), ("div", names(["nav", "menu", "navigation", "navbar", "breadcrumb", "breadcrumbs", "toc", "tabs"])), ("ul", names(["menu", "nav"])), ("div", ""), ("div", f" class={word()}")])
            return f"<{tag}{attrs}>{links(int(rng.integers(3, 9)))}</{tag}>"
        if kind == "header":
            tag, attrs = some([("header", ""), ("header", names(["header", "masthead"])), ("div", names(["header", "masthead", "topbar", "logo"]))])
            return f"<{tag}{attrs}><div>{words(1, 4)}</div>{links(3) if chance(0.6) else ''}{f'<p>{words(3, 9)}</p>' if chance(0.5) else ''}</{tag}>"
        if kind == "footer":
            tag, attrs = some([("footer", ""), ("footer", names(["footer"])), ("div", names(["footer", "copyright", "legal", "colophon"]))])
            inner = f"&copy; {word()}.example.com &middot; {prose(1, 3)}"
            return f"<{tag}{attrs}>{some([inner, f'<p>{inner}</p>'])}{links(3) if chance(0.4) else ''}</{tag}>"
        if kind == "aside":
            tag, attrs = some([("aside", ""), ("aside", names(["sidebar", "related"])), ("div", names(["sidebar", "widget", "rail", "related", "recommended", "trending", "popular", "more"]))])
            return f"<{tag}{attrs}><h3>{words(1, 4)}</h3>{links(int(rng.integers(2, 7)))}{f'<p>{prose(1, 4)}</p>' if chance(0.5) else ''}</{tag}>"
        if kind == "ad":
            tag, attrs = some([("div", names(["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner"])), ("div", ' class="ad"'), ("ins", names(["ad"])), ("section", names(["promo", "advert"]))])
            tag = "div" if tag == "ins" else tag
            return f"<{tag}{attrs}>{some([prose(1, 3), f'<p>{prose(1, 3)}</p>', f'<a href=/>{words(3, 8)}</a>'])}</{tag}>"
        if kind == "notice":
            tag, attrs = some([("div", names(["cookie", "consent", "notice", "gdpr", "popup", "modal", "alert", "banner", "subscribe", "paywall"])), ("section", names(["cookie", "notice"])), ("div", ' role="alert"'), ("div", ' role="dialog"')])
            return f"<{tag}{attrs}><p>{prose(1, 4)}</p>{f'<button>{words(1, 3)}</button>' if chance(0.6) else ''}</{tag}>"
        if kind == "form":
            field = f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button>"
            return some([f"<form{names(['search', 'newsletter', 'subscribe', 'login', 'contact'])}><p>{prose(1, 3)}</p>{field}</form>", f"<form>{words(2, 6)} {field}</form>", f"<div{names(['newsletter', 'signup', 'subscribe'])}><p>{prose(1, 3)}</p>{field}</div>"])
        if kind == "share":
            return f"<div{names(['share', 'social', 'tags', 'meta', 'byline', 'author', 'sharing'])}>{some([links(4), words(2, 6)])}</div>"
        one = lambda: some([f"<div{names(['comment'])}><p>{prose(1, 6)}</p></div>", f"<li><b>{word()}</b><p>{prose(1, 6)}</p></li>", f"<article{names(['comment', 'reply'])}><p>{prose(1, 6)}</p></article>"])
        tag, attrs = some([("section", names(["comments", "replies", "discussion", "responses"])), ("div", names(["comments", "comment", "disqus", "discussion", "responses", "replies"])), ("ol", names(["comments", "commentlist"]))])
        return f"<{tag}{attrs}><h3>{words(1, 3)}</h3>{''.join(one() for _ in range(int(rng.integers(1, 9))))}</{tag}>"

    for _ in range(n):
        main: set[str] = set()

        def block(text: str, main=main) -> str:
            main.add(_SPACE.sub(" ", html.unescape(text)).strip())
            return text

        def odd() -> str:
            """Text without sentences, or without Latin letters."""
            cjk = lambda: "".join(chr(int(c)) for c in rng.integers(0x4E00, 0x9000, int(rng.integers(4, 30))))
            return some([words(2, 8), " ".join(str(int(c)) for c in rng.integers(0, 9999, int(rng.integers(2, 9)))), f"{word()} = {word()}({word()}); return {word()}", "，".join(cjk() for _ in range(int(rng.integers(1, 4)))) + "。", cjk() + "。" + cjk() + "！"])

        def body_block() -> str:
            r = rng.random()
            if chance(0.05):
                return f"<p>{block(odd())}</p>"
            if chance(0.05):
                first, rest = words(1, 5), prose(1, 5)
                block(f"{first} {rest}")
                return f'<p><a href="/{word()}">{first}</a> {rest}</p>'
            if r < 0.68:
                text = block(prose(1, 9))
                return some([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p class={word()}>{text}</p>", f"<div>{text}</div>", f"<p>\n  <em>{text}</em>\n</p>"])
            if r < 0.76:
                h = some(["h2", "h3", "h4"])
                return f"<{h}>{block(words(2, 8))}</{h}>"
            if r < 0.84:
                return f"<ul>{''.join(f'<li>{block(prose(1, 3))}</li>' for _ in range(int(rng.integers(2, 6))))}</ul>"
            if r < 0.9:
                return f"<blockquote><p>{block(prose(1, 4))}</p></blockquote>"
            if r < 0.95:
                return "<table>" + "".join(f"<tr><td>{block(words(1, 5) + ' ' + word())}</td><td>{block(words(1, 4) + ' ' + word())}</td></tr>" for _ in range(int(rng.integers(1, 4)))) + "</table>"
            return f"<figure><img src=x><figcaption>{block(prose(1, 3))}</figcaption></figure>"

        if chance(0.06):
            inside = ""
        else:
            title = words(2, 9)
            parts = [f"<h1>{block(title)}</h1>"] if chance(0.8) else []
            if parts and chance(0.2):
                parts = [f"<header>{parts[0]}</header>"]
            size = int(rng.integers(1, 4) if chance(0.3) else rng.integers(2, 26))
            if chance(0.1):  # next to nothing
                parts, size = parts if chance(0.5) else [], 0
                parts += [f"<p>{block(words(1, 4) + some(['', '.']))}</p>" for _ in range(int(rng.integers(1, 3)))]
            for _ in range(size):
                parts.append(body_block())
                if chance(0.07):
                    parts.append(junk(some(["ad", "aside", "share", "notice", "form", "ad"])))
            if chance(0.15):
                parts.append(junk(some(["share", "comments", "menu"])))
            content = "".join(parts)
            tag, attrs = some([("article", ""), ("article", ""), ("article", names(["post", "article", "entry"])), ("main", ""), ("div", names(["content", "article", "post", "entry", "story", "text", "body", "main"])), ("div", ' itemprop="articleBody"'), ("section", names(["content", "article", "story"])), ("div", ' role="main"'), ("div", ""), *[("td", names(["content", "main"]))] * 2])
            if tag == "td":  # layouts by tables, with cells of any name or none
                cell = lambda: some([names(["sidebar", "nav"]), "", f" class={word()}", f" width={int(rng.integers(80, 200))}"])
                bar = lambda: " | ".join([words(1, 4), *(f"<a href=/{word()}>{words(1, 3)}</a>" for _ in range(int(rng.integers(2, 6))))])
                column = some([links(int(rng.integers(3, 8))), "<br>".join(f"<a href=/{word()}>{words(1, 3)}</a>" for _ in range(int(rng.integers(3, 8))))])
                top = f"<tr><td colspan=2{cell()}>{some([bar(), f'<font size=5>{words(1, 4)}</font> | ' + bar()])}</td></tr>" if chance(0.6) else ""
                inside = f"<table>{top}<tr><td{cell()}>{column}</td><td{some([attrs, attrs, ''])}>{content}</td></tr></table>"
            else:
                inside = f"<{tag}{attrs}>{content}</{tag}>"
            if chance(0.3):
                inside = some([f"<main>{inside}</main>", f"<div{names(['wrapper', 'container', 'content', 'main', 'page'])}>{inside}</div>", f"<section>{inside}</section>"])
        before = [junk(k) for k in ("menu", "header", "ad", "notice", "form", "aside") if chance({"menu": 0.75, "header": 0.4, "ad": 0.45}.get(k, 0.2))]
        after = [junk(k) for k in ("comments", "aside", "ad", "share", "form", "notice", "menu", "footer") if chance({"comments": 0.4, "footer": 0.8, "aside": 0.35}.get(k, 0.15))]
        if chance(0.15):
            inside = f"<div{names(['row', 'layout', 'wrapper', 'container'])}>{inside}{''.join(after[:2])}</div>"
            after = after[2:]
        body = "".join(before) + inside + "".join(after)
        if chance(0.1):  # nothing but a text, often a short one
            if chance(0.6):
                main.clear()
                inside = "".join(some([f"<p>{block(text)}</p>", f"<div>{block(text)}</div>"]) for text in [some([odd, lambda: prose(1, 4)])() for _ in range(int(rng.integers(1, 4)))])
                inside = some([f"<article>{inside}</article>", f"<div>{inside}</div>", inside])
            body = inside
        if chance(0.3):
            body = f"<div{names(['wrapper', 'container', 'page', 'root', 'app', 'site'])}>{body}</div>"
        yield f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{words(2, 6)}</title><style>p{{margin:0}}</style></head><body>{body}<script>var a="</p>";</script></body></html>', main


@lru_cache(maxsize=1)
def default_extractor() -> Extractor:
    return Extractor()


def extract(pages: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    extractor = extractor or default_extractor()
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 2 << 20):
            texts = extractor.extract(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
