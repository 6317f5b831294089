"""Main text of pages by a tree-structured graphical model.

Every block element and every run of text of a page's DOM is a node with a
binary label, content or not.  A node has a potential from its features (tag,
names in class, id and role, length, link share, punctuation), and every edge
from parent to child one from a table by kind of child.  Messages pass upward
from the leaves and downward from the root (sum-product, exact on a tree) and
give each node's marginal; runs of text that are content more likely than not
make the main text.

Weights are trained by maximum likelihood, with the same messages for the
expectations, on labelled pages.  By default these are the pages that label
themselves: those with an article or main element, whose inside is content
save for what is named as page furniture.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only, slices

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_NAME = re.compile(r"[a-z]+")

# Elements by the roles the HTML standard gives them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style template noscript head svg math iframe object canvas audio video select textarea".split())
RAW = frozenset("script style textarea iframe noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
# An element that ends an open one of its group, unless one of the limits is nearer.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
            "option": ("option",), "body": ("head",)}
LIMITS = frozenset("ul ol dl table".split())

FURNITURE_TAGS = frozenset("nav aside footer header form button fieldset label dialog menu".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus "
    "footer form header login masthead menu menubar modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted "
    "related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe tags teaser toolbar widget".split()
)
ARTICLE_TAGS = frozenset(["article", "main"])


@dataclass
class Tree:
    """Nodes of one page in document order; a parent stands before its children."""

    parent: list[int] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    features: list[list[str]] = field(default_factory=list)
    furniture: list[bool] = field(default_factory=list)
    article: list[bool] = field(default_factory=list)

    def add(self, parent: int, text: str | None, features: list[str], furniture: bool, article: bool) -> int:
        self.parent.append(parent)
        self.text.append(text)
        self.features.append(features)
        self.furniture.append(furniture)
        self.article.append(article)
        return len(self.parent) - 1


def _element(tag: str, attributes: str) -> tuple[list[str], bool, bool]:
    names: set[str] = set()
    hidden = False
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id", "role"):
                names.update(_NAME.findall(value))
            elif key == "style":
                hidden = hidden or "display:none" in value.replace(" ", "")
            elif key == "aria-hidden":
                hidden = hidden or value == "true"
    furniture = hidden or tag in FURNITURE_TAGS or not names.isdisjoint(FURNITURE_NAMES)
    article = tag in ARTICLE_TAGS
    features = [f"tag:{tag}", "element"] + [f"name:{n}" for n in sorted(names)]
    if furniture:
        features.append("furniture")
    if article:
        features.append("article")
    return features, furniture, article


def _run_features(text: str, links: int, tag: str) -> list[str]:
    n = len(text)
    share = links / n
    return [
        "text", f"in:{tag}", f"length:{min(n.bit_length(), 10)}", "links:" + ("none" if not links else "some" if share < 0.5 else "most"),
        "stop" if text[-1] in ".!?…" else "no stop", f"commas:{min(text.count(','), 3)}",
    ]


def parse(source: str) -> Tree:
    """The DOM tree of a page, with the standard's implied end tags."""
    tree = Tree()
    root = tree.add(-1, None, ["tag:#page", "element"], False, False)
    # open elements: (tag, node of the nearest block, link)
    stack: list[tuple[str, int, bool]] = [("#page", root, False)]
    pieces: list[str] = []
    links, dropped, at = 0, 0, 0

    def flush():
        nonlocal pieces, links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                block = stack[-1][1]
                tag = next(t for t, n, _ in reversed(stack) if n == block and t not in INLINE)
                tree.add(block, text, _run_features(text, min(links, len(text)), tag), False, False)
            pieces, links = [], 0

    def close(k: int):
        nonlocal dropped
        flush()
        for tag, _, _ in stack[k:]:
            dropped -= tag in DROPPED
        del stack[k:]

    def nearest(tags, limits) -> int | None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in limits:
                return None
        return None

    def words(text: str):
        nonlocal links
        if text and not dropped:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if stack[-1][2]:
                links += len(text.strip())

    n = len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if not m:
            words(source[at:])
            break
        words(source[at:m.start()])
        at = max(m.end(), m.start() + 1)
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE and tag not in VOID:
                # an inline end tag closes nothing beyond its own block
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k]
                        break
                    if stack[k][0] not in INLINE:
                        break
            elif tag not in VOID:
                k = nearest((tag,), ())
                if k is not None:
                    close(k)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                pieces.append(" ")
                if tag == "hr":
                    flush()
            continue
        if tag in INLINE:
            stack.append((tag, stack[-1][1], stack[-1][2] or tag == "a"))
            continue
        if tag in ENDS_P and (k := nearest(("p",), LIMITS | {"td", "th", "button"})) is not None:
            close(k)
        if tag in SIBLINGS and (k := nearest(SIBLINGS[tag], LIMITS)) is not None:
            close(k)
        flush()
        if tag in DROPPED:
            dropped += 1
            stack.append((tag, stack[-1][1], False))
        elif dropped:
            stack.append((tag, stack[-1][1], False))
        else:
            stack.append((tag, tree.add(stack[-1][1], None, *_element(tag, m[3] or "")), stack[-1][2]))
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(source, at)
            at = end.start() if end else n
    flush()
    return tree


def self_labels(tree: Tree) -> list[int] | None:
    """Labels of a page that marks its article: 1 inside it (and outside of
    furniture), else 0; None if it marks none."""
    if not any(tree.article):
        return None
    label, off = [], []
    for i, p in enumerate(tree.parent):
        off.append(tree.furniture[i] or (p >= 0 and off[p]))
        label.append(int(not off[i] and (tree.article[i] or (p >= 0 and label[p] == 1))))
    return label


def text_labels(tree: Tree, main_text: str) -> list[int]:
    """Labels from a page's known main text (blocks joined by \\n): runs that
    are one of its blocks, and the elements that hold such a run."""
    blocks = set(main_text.split("\n"))
    label = [int(t is not None and t in blocks) for t in tree.text]
    for i in range(len(label) - 1, 0, -1):
        if label[i]:
            label[tree.parent[i]] = 1
    return label


class Forest:
    """Trees side by side as arrays, so that messages of one depth are one
    vector operation."""

    def __init__(self, trees: list[Tree], index: dict[str, int]):
        sizes = [len(t.parent) for t in trees]
        start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.start, n = start, int(start[-1])
        self.parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + s) for t, s in zip(trees, start)] + [np.zeros(0, np.int64)]).astype(np.int64)
        self.kind = np.array([int(x is not None) for t in trees for x in t.text], np.int64)
        depth = np.zeros(n, np.int64)
        for i, p in enumerate(self.parent.tolist()):
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]  # depth 1 and more
        pairs = [(i, index[f]) for i, fs in enumerate(f for t in trees for f in t.features) for f in fs if f in index]
        self.node, self.feature = np.array(pairs, np.int64).reshape(-1, 2).T

    def beliefs(self, w: np.ndarray, table: np.ndarray):
        """Marginals P(content) of all nodes, and of the edges as joint tables
        (child, parent label, child label)."""
        n = len(self.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(self.node, w[self.feature], n)
        up, down, sent = own.copy(), np.zeros((n, 2)), np.zeros((n, 2))
        for c in reversed(self.levels):
            m = np.logaddexp.reduce(up[c][:, None, :] + table[self.kind[c]], axis=2)
            m -= m.max(axis=1, keepdims=True)
            sent[c] = m
            np.add.at(up, self.parent[c], m)
        joint = np.zeros((n, 2, 2))
        for c in self.levels:
            p = self.parent[c]
            above = up[p] + down[p] - sent[c]
            edge = above[:, :, None] + table[self.kind[c]]
            m = np.logaddexp.reduce(edge, axis=1)
            down[c] = m - m.max(axis=1, keepdims=True)
            both = edge + up[c][:, None, :]
            both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
            joint[c] = both / both.sum(axis=(1, 2), keepdims=True)
        b = up + down
        return 1 / (1 + np.exp(np.clip(b[:, 0] - b[:, 1], -500, 500))), joint


@dataclass(frozen=True)
class Model:
    """Feature weights, and edge potentials by [kind of child][parent][child]."""

    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    table: np.ndarray = field(default_factory=lambda: np.zeros((2, 2, 2)))


def fit(trees: list[Tree], labels: list[list[int]], rounds: int = 200, rate: float = 0.1, l2: float = 1e-3) -> Model:
    """Maximum likelihood on labelled trees: observed less expected feature and
    edge counts are the gradient."""
    if not trees:
        return Model()
    index = {f: i for i, f in enumerate(sorted({f for t in trees for fs in t.features for f in fs}))}
    forest, y = Forest(trees, index), np.array([v for x in labels for v in x], np.int64)
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    x = np.zeros(len(index) + 8)
    m, v = np.zeros_like(x), np.zeros_like(x)
    scale = 1 / len(trees)
    for step in range(1, rounds + 1):
        p, joint = forest.beliefs(x[:-8], x[-8:].reshape(2, 2, 2))
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, forest.kind[child], joint[child])
        g = np.append(np.bincount(forest.feature, (p - y)[forest.node], len(index)), (expected - seen).ravel()) * scale + l2 * x
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(index, x[:-8], x[-8:].reshape(2, 2, 2))


def content(trees: list[Tree], model: Model) -> list[str]:
    """Main text of each tree: its content runs in page order, one a line."""
    forest = Forest(trees, model.index)
    p, _ = forest.beliefs(model.weights, model.table)
    return [
        "\n".join(x for x, q in zip(t.text, p[s:s + len(t.text)]) if x is not None and q > 0.5)
        for t, s in zip(trees, forest.start.tolist())
    ]


def varied(tree: Tree, label: list[int]) -> list[tuple[Tree, list[int]]]:
    """The labelled tree, and variants of it that part a run's looks from its
    place: paragraphs of the article also stand, as furniture, in the page's
    furniture and in some inside the article, and the article's element is a
    plain one.  Without them a
    paragraph would count as content wherever it stands."""
    inside = [i for i, t in enumerate(tree.text) if t is not None and label[i]]
    holders = [i for i, off in enumerate(tree.furniture) if off and tree.text[i] is None and not label[i]]
    out = [(tree, label)]
    for plain in (False, True):
        v = Tree(list(tree.parent), list(tree.text), list(tree.features), list(tree.furniture), list(tree.article))
        y = list(label)
        # furniture can also stand inside the article, as an advert does
        nested = [v.add(i, None, ["tag:div", "element", "furniture"], True, False) for i, a in enumerate(tree.article) if a and label[i]]
        y += [0] * len(nested)
        for k, holder in enumerate(holders + nested if inside else []):
            for j in (inside[k % len(inside)], inside[(7 * k + 3) % len(inside)]):
                p = v.add(holder, None, tree.features[tree.parent[j]] if not tree.article[tree.parent[j]] else ["tag:div", "element"], False, False)
                v.add(p, tree.text[j], tree.features[j], False, False)
                y += [0, 0]
        if plain:
            v.features = [["tag:div", "element"] if a else f for f, a in zip(v.features, v.article)]
        out.append((v, y))
    return out


def train(pages: DataFrame, max_pages: int = 300, max_chars: int = 200_000, labelled: DataFrame | None = None) -> Model:
    """Model from a sample of at most ``max_pages`` labelled pages of at most
    ``max_chars`` characters, chosen by a hash of their html.

    labelled: (page_id, text) with known main texts; without it the pages that
    mark their article label themselves.  Without a labelled page nothing is
    learnt, and no text is content.
    """
    p = only(pages, "page_id", "html").filter(F.col("html").isNotNull() & (F.length("html") <= max_chars))
    if labelled is None:
        p = p.filter(F.lower("html").rlike("<(article|main)[\\s>]")).withColumn("known", F.lit(None).cast("string"))
    else:
        p = p.join(labelled.select("page_id", F.col("text").alias("known")), "page_id")
    # the pages of the least hashes, copies once: only hashes are ordered, so
    # no task sends more than the sample's own pages
    p = p.withColumn("h", F.xxhash64("html"))
    least = [r["h"] for r in p.select("h").distinct().orderBy("h").limit(max_pages).collect()]
    rows = p.filter(F.col("h").isin(least)).groupBy("h").agg(F.min(F.struct("html", "known")).alias("r")).orderBy("h").select("r.html", "r.known").collect()
    trees = [parse(r["html"]) for r in rows]
    labels = [self_labels(t) if r["known"] is None else text_labels(t, r["known"]) for t, r in zip(trees, rows)]
    kept = [x for t, y in zip(trees, labels) if y is not None for x in varied(t, y)]
    return fit([t for t, _ in kept], [y for _, y in kept])


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row; a null or empty html, and a
    page without content, give an empty text."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train(pages))

    def run(batches):
        for part in slices(batches, "html", 2 << 20):
            texts = content([parse(s) for s in part.column("html").to_pylist()], shared.value)
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    p = only(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html")
    )
    return p.mapInArrow(run, "page_id long, url string, text string, n_chars long")
