"""Operator 1: main text of web pages by a tree-structured graphical model.

A page becomes a tree: block elements are inner nodes, and each run of text
between block boundaries is a leaf. Every node is content or not. A log-linear
potential scores a node by its tag, the words of its class and id, its text
and its share of links; a potential for each kind of child scores parent and
child together. Sum-product messages, from the leaves up and from the root
down, give each node's exact marginal, and the leaves with 1/2 or more are the
text. Messages of all trees of a slice of rows run together, level by level.

Training maximises the exact likelihood of labelled pages. Labels come from a
bounded sample of the table's own pages that name their article (an
``article`` or ``main`` element): as they are, with these elements renamed to
plain ones, and rewritten with other layouts: plain elements with and without
a class, and sidebars, notices, adverts, forms and reader comments made of
other pages' text, labelled as such. The sample is bounded to ``sample`` pages
of at most ``sample_chars`` characters; extraction reads every page whole.

Text: character references are decoded, white space inside a block becomes
one space, blocks are joined in page order by line breaks. Scripts, styles,
templates and the head are markup, not text.

Defined cases: null and empty html give '' and 0; broken markup is read as
far as it goes (an unclosed element ends with its parent; a tag with a quote
that never closes ends at its first >, and without one is text; elements deeper than ``_DEEPEST`` are siblings, as in browsers), in
time that grows with the page; plain text without
markup is one block; repeated rows each count; with no page that names its
article the rewritten defaults below train alone; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import map_text, spread, table

SAMPLE = 200
SAMPLE_CHARS = 100_000
BITS = 13
STEPS = 60

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source map area input br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript svg math iframe object title textarea select canvas audio video".split())
NAMED = frozenset("article main nav aside footer header form section".split())
#: An opening tag of the key ends an open element of the value (up to the nearest of SCOPE).
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
ENDS |= dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split(), {"p"})
SCOPE = frozenset("html body table ul ol dl div section article aside nav footer header main form blockquote".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_OPEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_MARKUP = re.compile(r"<(?=[/A-Za-z!?])")
_MARK = re.compile(r"[>\"']")
#: Tags up to here are read by one pattern, longer ones from quote to quote.
_TAG_REACH = 1 << 14
_DEEPEST = 512
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_FEATURES: dict[str, int] = {}


def _feature(name: str) -> int:
    got = _FEATURES.get(name)
    if got is None:
        if len(_FEATURES) > 200_000:
            _FEATURES.clear()
        got = _FEATURES[name] = zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
    return got


class Tree:
    """One page: parents come before children."""

    __slots__ = ("parent", "depth", "kind", "tag", "names", "text", "links", "size", "label")

    def __init__(self) -> None:
        self.parent, self.depth, self.kind, self.tag, self.names, self.text, self.links, self.size, self.label = ([] for _ in range(9))

    def add(self, parent: int, kind: int, tag: str, names: tuple[str, ...]) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.kind.append(kind)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append("")
        self.links.append(0)
        self.size.append(0)
        return len(self.parent) - 1


LEAF, PART, PLAIN, NAME = range(4)
_PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd pre blockquote figcaption caption tr".split())


def _tag_end(source: str, at: int, dead: set[int]) -> int:
    """Behind the > that ends a tag, from a place among its attributes on; -1 if a quote in it never closes.

    dead: quotes from which this is known, so that no stretch is read anew for each tag before it.
    """
    path = []
    while m := _MARK.search(source, at):
        k = m.start()
        if source[k] == ">":
            return k + 1
        path.append(k)
        close = -1 if k in dead else source.find(source[k], k + 1)
        if close < 0:
            break
        at = close + 1
    dead.update(path)
    return -1


def next_tag(source: str, at: int, last: int, dead: set[int]) -> tuple[int, int, str, str, str] | None:
    """(start, end, name, '/' if closing, attributes) of the first tag from a place on; comments and declarations have no name. last: place of the last >; dead: as in _tag_end.

    A > inside a quoted value does not end a tag, however long the value is; a
    tag with a quote that never closes ends at its first >.
    """
    while m := _MARKUP.search(source, at):
        begin = m.start()
        if source.startswith("<!--", begin):
            close = source.find("-->", begin + 4)
            return begin, close + 3 if close >= 0 else len(source), "", "", ""
        if begin > last:  # no tag ends any more
            comment = source.find("<!--", begin)
            return (comment, len(source), "", "", "") if comment >= 0 else None
        if tag := _TAG.match(source, begin, min(len(source), begin + _TAG_REACH)):
            return begin, tag.end(), tag[2], tag[1], tag[3]
        head = _OPEN.match(source, begin)
        stop = source.find(">", begin) + 1
        if head:
            whole = _tag_end(source, head.end(), dead)
            stop = whole if whole > 0 else stop
            return begin, stop, head[2], head[1], source[head.end() : stop - 1]
        if source[begin + 1] in "!?":
            return begin, stop, "", "", ""
        at = begin + 2  # "</" and no name
    return None


def _closed(source: str, name: str, at: int) -> int:
    """Where an element whose inside is no markup ends: behind its closing tag, or with the page."""
    close = re.compile(rf"</{re.escape(name)}\b", re.I).search(source, at)
    stop = source.find(">", close.end()) if close else -1
    return stop + 1 if stop >= 0 else len(source)


def parse(source: str) -> Tree:
    """The tree of a page."""
    t = Tree()
    stack = [t.add(-1, PLAIN, "root", ())]
    tags = ["root"]
    runs: list[str] = []
    linked = inside = 0
    at, end = 0, len(source)

    def flush() -> None:
        nonlocal linked
        if runs:
            text = " ".join("".join(runs).split())
            runs.clear()
            if text:
                k = t.add(stack[-1], LEAF, tags[-1], ())
                t.text[k], t.links[k], t.size[k] = text, min(linked, len(text)), len(text)
            linked = 0

    last = source.rfind(">")
    dead: set[int] = set()
    while tag := next_tag(source, at, last, dead):
        begin, stop, name, closing, attributes = tag
        if begin > at:
            piece = source[at:begin]
            piece = _html.unescape(piece) if "&" in piece else piece
            runs.append(piece)
            if inside:
                linked += len(piece)
        at = stop
        if not name:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "br":
                runs.append(" ")
            elif name == "a":
                inside = 0 if closing else 1
            continue
        if name in RAW and not closing:
            if attributes.endswith("/"):
                continue
            at = _closed(source, name, at)
            continue
        flush()
        if closing:
            inside = 0
            if name in tags:
                k = len(tags) - 1 - tags[::-1].index(name)
                if k:
                    del stack[k:], tags[k:]
            continue
        ends = ENDS.get(name)
        if ends:
            k = len(tags) - 1
            cut = 0
            while k > 0 and tags[k] not in SCOPE:
                if tags[k] in ends:
                    cut = k
                k -= 1
            if cut:
                del stack[cut:], tags[cut:]
        if name in VOID:
            continue
        if name == "head":
            close = re.compile(r"</head\b|<body\b", re.I).search(source, at)
            if close:
                at = close.start() if close[0][1] != "/" else _closed(source, "head", at)
            continue
        names: tuple[str, ...] = ()
        if attributes:
            found = _NAME.findall(attributes)
            if found:
                names = tuple(_WORDS.findall(" ".join(a or b or c for a, b, c in found).lower()))
        if len(stack) > _DEEPEST:
            continue
        stack.append(t.add(stack[-1], NAME if name in NAMED else PART if name in _PARTS else PLAIN, name, names))
        tags.append(name)
    if at < end:
        runs.append(_html.unescape(source[at:]))
    flush()
    for k in range(len(t.parent) - 1, 0, -1):
        t.size[t.parent[k]] += t.size[k]
        t.links[t.parent[k]] += t.links[k]
    return t


def _level(x: float, cuts: tuple) -> int:
    return sum(x >= c for c in cuts)


def features(t: Tree) -> list[list[int]]:
    """Feature numbers of each node."""
    out = []
    for kind, tag, names, text, links, size in zip(t.kind, t.tag, t.names, t.text, t.links, t.size, strict=True):
        density = _level(links / size, (0.01, 0.3, 0.7)) if size else 9
        if kind == LEAF:
            # a leaf's words say little of themselves: lengths are coarse, and its place comes by messages
            f = [f"leaf={tag if tag in _PARTS else '-'}", f"long={_level(size, (20, 80, 300))}", f"links={density}"]
            if "©" in text:
                f.append("copyright")
        else:
            f = [f"tag={tag}", f"inner={density}"] + [f"name={n}" for n in dict.fromkeys(names)]
        out.append([_feature("bias"), *map(_feature, f)])
    return out


class Forest:
    """Many trees as arrays, with the order in which messages run."""

    def __init__(self, trees: list[Tree]):
        sizes = np.array([len(t.parent) for t in trees], np.int64)
        base = np.append(0, np.cumsum(sizes))[:-1]
        self.tree = np.repeat(np.arange(len(trees)), sizes)
        self.parent = np.array([p for t in trees for p in t.parent], np.int64)
        inner = self.parent >= 0
        self.parent[inner] += base[self.tree[inner]]
        self.kind = np.array([k for t in trees for k in t.kind], np.int64)
        depth = np.array([d for t in trees for d in t.depth], np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 1)))
        rows = [f for t in trees for f in features(t)]
        self.flat = np.array([x for f in rows for x in f], np.int64)
        self.ends = np.cumsum([len(f) for f in rows])
        self.owner = np.repeat(np.arange(len(rows)), [len(f) for f in rows])

    def unary(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.flat], np.append(0, self.ends[:-1]))

    def marginals(self, unary: np.ndarray, joint: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and expected pair counts [kind, parent, child] if asked for.

        joint: [kind of child, state of parent, state of child]. Messages are log-odds.
        """
        up = unary.astype(float).copy()
        sent = np.zeros(len(up))
        for nodes in self.levels[:0:-1]:
            j, x = joint[self.kind[nodes]], up[nodes]
            sent[nodes] = np.logaddexp(j[:, 1, 0], j[:, 1, 1] + x) - np.logaddexp(j[:, 0, 0], j[:, 0, 1] + x)
            np.add.at(up, self.parent[nodes], sent[nodes])
        belief = up.copy()
        expected = np.zeros_like(joint)
        for nodes in self.levels[1:]:
            j, x = joint[self.kind[nodes]], belief[self.parent[nodes]] - sent[nodes]
            belief[nodes] = up[nodes] + np.logaddexp(j[:, 0, 1], j[:, 1, 1] + x) - np.logaddexp(j[:, 0, 0], j[:, 1, 0] + x)
            if pairs:
                s = np.stack([j[:, 0, 0], j[:, 0, 1] + up[nodes], x + j[:, 1, 0], x + j[:, 1, 1] + up[nodes]], 1)
                s = np.exp(s - s.max(1, keepdims=True))
                np.add.at(expected, self.kind[nodes], (s / s.sum(1, keepdims=True)).reshape(-1, 2, 2))
        return 1 / (1 + np.exp(-np.clip(belief, -60, 60))), expected


def fit(trees: list[Tree], steps: int = STEPS) -> dict[str, np.ndarray]:
    """Weights and joint potentials from labelled trees, by gradient ascent (Adam) on their exact likelihood."""
    forest = Forest(trees)
    y = np.array([v for t in trees for v in t.label], float)
    child = np.flatnonzero(forest.parent >= 0)
    gold = np.zeros((4, 2, 2))
    np.add.at(gold, (forest.kind[child], y[forest.parent[child]].astype(int), y[child].astype(int)), 1)
    weights, joint = np.zeros(1 << BITS), np.zeros((4, 2, 2))
    one, two = np.zeros(len(weights) + 16), np.zeros(len(weights) + 16)
    for n in range(1, steps + 1):
        p, expected = forest.marginals(forest.unary(weights), joint, pairs=True)
        g = np.bincount(forest.flat, weights=(y - p)[forest.owner], minlength=len(weights)) - 0.3 * weights
        g = np.append(g, (gold - expected - 0.3 * joint).ravel())
        one += 0.1 * (g - one)
        two += 0.01 * (g * g - two)
        step = 0.2 * (one / (1 - 0.9**n)) / (np.sqrt(two / (1 - 0.99**n)) + 1e-6)
        weights += step[:-16]
        joint += step[-16:].reshape(4, 2, 2)
    return {"weights": weights, "joint": joint}


def labelled(source: str) -> Tree | None:
    """A page's tree with labels, if it names its article; None if not.

    Content is what lies in an ``article`` or ``main`` element, but not in a
    part of it that is named or classed as something else (data-label="0" in
    the rewritten pages).
    """
    t = parse(source)
    inside, other = [False] * len(t.parent), [False] * len(t.parent)
    for k, p in enumerate(t.parent):
        if p >= 0:
            inside[k] = inside[p] or t.tag[k] in ("article", "main") or "articlelabel" in t.names[k]
            other[k] = other[p] or (t.kind[k] != LEAF and (t.tag[k] in ("nav", "aside", "footer", "form") or "otherlabel" in t.names[k]))
    if not any(inside):
        return None
    own = [a and not b for a, b in zip(inside, other, strict=True)]
    # an inner node is content if some leaf under it is
    t.label = [int(o and k == LEAF) for o, k in zip(own, t.kind, strict=True)]
    for k in range(len(t.parent) - 1, 0, -1):
        if t.label[k] and own[t.parent[k]]:
            t.label[t.parent[k]] = 1
    t.names = [tuple(n for n in names if n not in ("articlelabel", "otherlabel")) for names in t.names]
    return t


#: Class words of rewritten pages.
MAIN_NAMES = ("content", "main content", "article body", "post content", "entry content", "story text", "post body", "page main")
OTHER_NAMES = {
    "nav": ("menu", "navbar", "main navigation", "breadcrumb", "topbar menu"),
    "header": ("header", "site header", "masthead", "topbar"),
    "footer": ("footer", "site footer", "copyright", "bottom"),
    "aside": ("sidebar", "side column", "related", "widget", "aside", "recommended"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"),
    "notice": ("notice", "cookie consent", "alert", "cookie banner", "message", "popup modal", "gdpr"),
    "comments": ("comments", "comment list", "reader comments", "responses", "discussion", "reply"),
    "form": ("form", "newsletter", "subscribe", "login", "search", "signup"),
    "share": ("share", "social", "tags", "meta toolbar", "pagination", "byline author"),
}
DEFAULT_TEXT = ("This paragraph tells what happened, and to whom. It goes on for two sentences.", "A second one follows.", "Read more about it here, says a short line.", "The end of the text comes with a longer paragraph, which holds several clauses, one after the other, until it stops.")


def rewritten(paragraphs: list[str], seed: int) -> str:
    """A page made of given paragraphs in another layout, with its labels in class names that ``labelled`` takes out."""
    r = np.random.default_rng(seed)
    esc = _html.escape
    pick = lambda: esc(paragraphs[int(r.integers(0, len(paragraphs)))])
    some = lambda n: " ".join(pick() for _ in range(n))
    one_of = lambda xs: xs[int(r.integers(0, len(xs)))]

    def box(kind: str, body: str, tag: str | None = None) -> str:
        named = tag if tag and r.integers(0, 2) else one_of(("div", "div", "section", "ul" if body.startswith("<li") else "div"))
        return f'<{named} class="otherlabel {one_of(OTHER_NAMES[kind]) if named in ("div", "section", "ul") or r.integers(0, 2) else ""}">{body}</{named}>'

    links = lambda n: "".join(f'<li><a href="/x">{esc(" ".join(pick().split()[:3]))}</a></li>' for _ in range(n))
    texts = lambda n: "".join(f"<{t}>{some(int(r.integers(1, 3)))}</{t}>" for t in (one_of(("p", "p", "div")) for _ in range(n)))
    form = '<label>Name</label><input name="q"><p>' + pick()[:80] + '</p><button>Send</button>'
    boxes = {
        "nav": lambda: box("nav", links(int(r.integers(3, 8))), "nav"),
        "header": lambda: box("header", (lambda tag: f"<{tag}>{pick()[:60]}</{tag}>")(one_of(("p", "h1", "div", "h2"))) + (f"<ul>{links(3)}</ul>" if r.integers(0, 2) else ""), "header"),
        "footer": lambda: box("footer", f"<p>&copy; 2020 {pick()[:80]}</p>", "footer"),
        "aside": lambda: box("aside", (f"<h3>{pick()[:40]}</h3>" if r.integers(0, 2) else "") + (texts(2) if r.integers(0, 2) else f"<ul>{links(4)}</ul>"), "aside"),
        "ad": lambda: box("ad", texts(1) if r.integers(0, 2) else pick()),
        "notice": lambda: box("notice", texts(1) if r.integers(0, 2) else pick()),
        "comments": lambda: box("comments", (f"<h2>{pick()[:30]}</h2>" if r.integers(0, 2) else "") + texts(int(r.integers(1, 4)))),
        "form": lambda: box("form", form, "form"),
        "share": lambda: box("share", f"<ul>{links(3)}</ul>" if r.integers(0, 2) else f"<p>{pick()[:50]}</p>"),
    }
    some_of = lambda kinds: "".join(boxes[k]() for k in kinds if r.integers(0, 3))
    body = f"<h1>{esc(pick()[:60])}</h1>" if r.integers(0, 4) else ""
    for i in range(int(r.integers(1, 7))):
        turn = int(r.integers(0, 10))
        if turn == 3:
            body += f"<table><tr><td>{' '.join(pick().split()[:2])}</td><td>{' '.join(pick().split()[:1])}</td></tr></table>"
        elif turn == 4:
            body += f"<p>{' '.join(pick().split()[: int(r.integers(1, 4))])}</p>"
        body += f"<ul><li>{pick()}</li><li>{pick()}</li></ul>" if turn == 0 else f"<blockquote>{pick()}</blockquote>" if turn == 1 else f"<h2>{pick()[:40]}</h2>" if turn == 2 else f"<p>{some(int(r.integers(1, 4)))}</p>"
        if i and not r.integers(0, 4):
            body += boxes[one_of(("ad", "aside", "form", "share", "notice"))]()
    tail = boxes["comments"]() if r.integers(0, 2) else ""
    turn = int(r.integers(0, 12))
    if turn == 0:  # a bare page: nothing but the text
        return f'<html><body class="articlelabel">{body}</body></html>' if r.integers(0, 2) else f'<body class="articlelabel"><p>{" ".join(pick().split()[: int(r.integers(1, 9))])}</p></body>'
    if turn <= 4:
        tag = one_of(("article", "main"))
        main = f"<{tag}>{body}{tail if r.integers(0, 2) else ''}</{tag}>"
    else:
        main = f'<div class="articlelabel {one_of(MAIN_NAMES) if r.integers(0, 3) else ""}">{body}</div>' + tail
    wrap = f'<div class="{one_of(("wrapper", "container", "page", "row", ""))}">{main}{some_of(("aside", "ad"))}</div>' if r.integers(0, 2) else main + some_of(("aside", "ad"))
    return f"<html><body>{some_of(('notice', 'header', 'nav', 'ad'))}{wrap}{some_of(('comments', 'share', 'form', 'footer'))}</body></html>"


_ARTICLE = re.compile(r"<(/?)(?:article|main)\b([^>]*)>", re.I)


def renamed(source: str) -> str:
    """The page with its article in a plain element, labelled for ``labelled``; its own class names go every other time."""
    keep = zlib.crc32(source.encode("utf-8", "surrogatepass")) & 1
    return _ARTICLE.sub(lambda m: "</div>" if m[1] else f'<div class="articlelabel" {m[2] if keep else ""}>', source)


def train(sources: list[str], variants: int = 2) -> dict[str, np.ndarray]:
    """Fit on pages that name their article, on the same with the name gone, and on pages rewritten from their paragraphs."""
    trees = [t for t in map(labelled, sources) if t is not None]
    paragraphs = [x for t in trees for x, y, k in zip(t.text, t.label, t.kind, strict=True) if k == LEAF and y]
    paragraphs = [p for p in paragraphs if len(p) > 20] + list(DEFAULT_TEXT)
    trees += [t for t in (labelled(renamed(s)) for s in sources) if t is not None]
    trees += [t for t in (labelled(rewritten(paragraphs, i)) for i in range(max(400, variants * len(sources)))) if t is not None]
    return fit(trees)


def extract(model: dict, sources: list[str]) -> list[str]:
    """Main text of each page."""
    trees = [parse(s) for s in sources]
    forest = Forest(trees)
    p, _ = forest.marginals(forest.unary(model["weights"]), model["joint"])
    keep = (p >= 0.5) & (forest.kind == LEAF)
    out: list[str] = []
    at = 0
    for t in trees:
        if len(t.parent) == 2 and t.kind[1] == LEAF:  # no element at all
            out.append(t.text[1])
        else:
            out.append("\n".join(t.text[k] for k in np.flatnonzero(keep[at : at + len(t.parent)]).tolist()))
        at += len(t.parent)
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of ``pages``."""
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    named = narrow.where(F.col("html").rlike("(?i)<(article|main)[\\s>]") & (F.length("html") <= sample_chars))
    # keys are ranked alone, so no task and no driver sees more pages than the sample holds; at most ``sample`` keys are broadcast
    keys = named.select(F.xxhash64("page_id", "url").alias("key")).distinct().orderBy("key").limit(sample)
    picked = named.join(F.broadcast(keys), F.xxhash64("page_id", "url") == F.col("key"), "left_semi")
    rows = [r["html"] for r in picked.groupBy("page_id", "url").agg(F.min("html").alias("html")).orderBy("page_id", "url").collect()]
    model = pages.sparkSession.sparkContext.broadcast(train(rows))

    def make():
        def f(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = extract(model.value, [h or "" for h in part.column(2).to_pylist()])
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return f

    kinds = dict(narrow.dtypes)
    return map_text(spread(narrow), make, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long", column=2)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return main_text(table(spark, sf_dir, "pages"))


#: These tables' pages name their article, so SQL can cut it out; the model is not told so.
OP1_SQL = """
WITH body AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)(</article>|$)', 1) AS b FROM pages),
cut AS (
  SELECT page_id, url, string_split(
    regexp_replace(regexp_replace(regexp_replace(b, '<br[^>]*>', ' ', 'g'), '</?(p|h1)[^>]*>', chr(1), 'g'), '<[^>]*>', '', 'g'), chr(1)) AS parts FROM body),
plain AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(
    regexp_replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'),
    '\\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM cut)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, CAST(length(array_to_string(blocks, chr(10))) AS BIGINT) AS n_chars FROM plain
"""
