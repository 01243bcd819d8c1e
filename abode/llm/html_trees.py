"""Main-text extraction: gradient-boosted trees over DOM nodes, hierarchical decoding.

Each block node of a page (``dom``) gets a log odds of being kept: of holding
article text. A node that is dropped drops its whole subtree, and a kept node
has kept ancestors, so labels never contradict each other: the best consistent
labelling of the tree is found bottom-up (sum of log probabilities).

Training data come from a sample of the given pages that have an article or
main element: about ``train_pages`` pages, by a hash of the page, whatever their
length. A page that marks its article gives its own blocks as labelled nodes, and
is laid out anew several times with its texts: other elements and class names,
with menus, page headers, notices, side columns, adverts, forms, comments and
footers around the same article. So the trees learn from structure, attribute
words and densities rather than from one template. Pages are parsed whole in the
tasks; only features reach the driver, of at most ``page_nodes`` nodes a page
(a random draw if it and its layouts have more) and 2 * ``train_pages`` pages.
Every page of the table is then extracted whole.

Defined cases: a null or empty html has an empty text. Without a page that
marks its article the trees learn from layouts of built-in texts. Equal rows get
equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.llm import dom
from abode.llm import textbytes as B
from abode.llm.common import hash_cut


@dataclass(frozen=True)
class Settings:
    train_pages: int = 200
    page_nodes: int = 500
    layouts: int = 5
    trees: int = 50
    depth: int = 4
    rate: float = 0.25
    bins: int = 32
    ridge: float = 1.0


@dataclass
class Forest:
    """Complete binary trees in heap order: split feature and threshold per inner node, value per leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            while inner and at.min(initial=inner) < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out


def fit_forest(x: np.ndarray, y: np.ndarray, settings: Settings) -> Forest:
    """Logistic boosting with histograms of the features' quantile bins."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, settings.bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    inner, bins = 2 ** settings.depth - 1, settings.bins + 1
    share = np.clip(y.mean(), 0.01, 0.99)
    start = float(np.log(share / (1 - share)))
    z = np.full(n, start)
    features, thresholds, leaves = [], [], []
    column = np.arange(width) * bins
    for _ in range(settings.trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(settings.depth):
            first, nodes = 2 ** level - 1, 2 ** level
            cell = ((at - first)[:, None] * (width * bins) + column + binned).ravel()
            size = nodes * width * bins
            gs = np.bincount(cell, np.repeat(g, width), minlength=size).reshape(nodes, width, bins).cumsum(2)
            hs = np.bincount(cell, np.repeat(h, width), minlength=size).reshape(nodes, width, bins).cumsum(2)
            g_all, h_all = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs ** 2 / (hs + settings.ridge) + (g_all - gs) ** 2 / (h_all - hs + settings.ridge) \
                - g_all ** 2 / (h_all + settings.ridge)
            gain[..., -1] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for k in range(nodes):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    f[first + k], t[first + k] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > t[at])
        where = at - inner
        value = -settings.rate * np.bincount(where, g, minlength=inner + 1) / \
            (np.bincount(where, h, minlength=inner + 1) + settings.ridge)
        z += value[where]
        features.append(f)
        thresholds.append(t)
        leaves.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(leaves), start)


def decode(page: dom.Page, odds: np.ndarray) -> np.ndarray:
    """Best labels in which whatever is below a dropped node is dropped; the root is kept."""
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    all_drop, best_keep = drop.copy(), keep.copy()
    parent = [x.parent for x in page.nodes]
    for i in range(len(parent) - 1, 0, -1):
        all_drop[parent[i]] += all_drop[i]
        best_keep[parent[i]] += max(best_keep[i], all_drop[i])
    kept = np.zeros(len(parent), bool)
    kept[0] = True
    for i in range(1, len(parent)):
        kept[i] = kept[parent[i]] and best_keep[i] >= all_drop[i]
    return kept


def article_root(page: dom.Page) -> int | None:
    """The node that a page marks as its article: <article>, else <main>."""
    for tag in ("article", "main"):
        for i, x in enumerate(page.nodes):
            if x.tag == tag:
                return i
    return None


def _below(page: dom.Page, roots: set[int]) -> np.ndarray:
    out = np.zeros(len(page.nodes), bool)
    for i, x in enumerate(page.nodes):
        out[i] = i in roots or (x.parent >= 0 and out[x.parent])
    return out


def labels_of(page: dom.Page, inside: np.ndarray) -> np.ndarray:
    """Nodes in the article and those that lead to it."""
    y = inside.astype(float)
    for i in range(len(y) - 1, 0, -1):
        y[page.nodes[i].parent] = max(y[page.nodes[i].parent], y[i])
    return y


# Class names of the layouts that training pages get.
_CLASSES = {
    "content": ["content", "post", "entry-content", "article-body", "story", "main-text", "post-content", ""],
    "menu": ["menu", "navbar", "nav-links", "breadcrumbs", "topnav", "site-nav"],
    "header": ["header", "site-header", "masthead", "topbar", "page-head"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "colophon"],
    "side": ["sidebar", "widget", "related", "right-rail", "recommended", "popular"],
    "advert": ["ad", "ads", "advert", "sponsored", "promo", "ad-slot"],
    "notice": ["cookie-notice", "notice", "alert", "consent", "newsletter", "popup", "subscribe"],
    "comment": ["comments", "comment-list", "replies", "discussion", "reader-comments"],
    "share": ["share", "social", "byline", "post-meta", "tags"],
}
_ELEMENTS = {"content": ["article", "main", "div", "section"], "menu": ["nav", "div", "ul"], "header": ["header", "div"],
             "footer": ["footer", "div"], "side": ["aside", "div", "section"], "advert": ["div", "aside", "section"],
             "notice": ["div", "section", "p"], "comment": ["section", "div", "ul"], "share": ["div", "p", "ul"]}


def lay_out(rng: random.Random, article: list[tuple[str, str]], texts: list[str]) -> str:
    """A page around the article's blocks, with other parts from ``texts``. data-part marks the article."""
    def short(a: int, z: int) -> str:
        return html.escape(" ".join(rng.choice(texts).split()[:rng.randint(a, z)]))

    def part(kind: str, inner: str, plain: float = 0.25) -> str:
        tag = rng.choice(_ELEMENTS[kind])
        named = tag not in ("nav", "header", "footer", "aside") or rng.random() > plain
        name = rng.choice(_CLASSES[kind]) if named else ""
        attribute = rng.choice(["class", "class", "id"])
        return f"<{tag}{f' {attribute}="{name}"' if name else ''}>{inner}</{tag}>"

    def links(n: int) -> str:
        made = [f'<a href="#">{short(1, 4)}</a>' for _ in range(n)]
        if rng.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in made) + "</ul>"
        return rng.choice([" ", " | "]).join(made)

    def prose(a: int, z: int) -> str:
        return "".join(f"<p>{short(4, 60)}</p>" if rng.random() < 0.8 else short(4, 40) for _ in range(rng.randint(a, z)))

    body = []
    for tag, text in article:
        made = html.escape(text)
        if rng.random() < 0.1:
            made = f"<b>{made}</b>"
        if tag == "p" and rng.random() < 0.06:
            tag = rng.choice(["blockquote", "pre", "div"])
        if tag == "p" and rng.random() < 0.05:
            body.append("<ul>" + "".join(f"<li>{x}</li>" for x in made.split(". ")) + "</ul>")
        else:
            body.append(f"<{tag}>{made}</{tag}>")
        if len(body) > 1 and rng.random() < 0.06:
            body.append(part("advert", short(2, 30) if rng.random() < 0.5 else prose(1, 1)))
    if rng.random() < 0.3:
        body.insert(rng.randint(0, min(1, len(body))), part("share", links(rng.randint(1, 4))))
    tag = rng.choice(_ELEMENTS["content"])
    name = rng.choice(_CLASSES["content"])
    inner = "".join(body)
    comments = part("comment", ("<h3>" + short(1, 3) + "</h3>") * rng.randint(0, 1) + "".join(
        f"<{t}>{prose(1, 2)}</{t}>" for t in [rng.choice(["div", "article", "p", "li"])] * rng.randint(1, 6)))
    if rng.random() < 0.2:
        inner, comments = inner + comments, ""
    core = f"<{tag}{f' class="{name}"' if name else ''} data-part=1>{inner}</{tag}>"
    form = f"<form><label>{short(1, 4)}</label><input name=q><button>{short(1, 2)}</button>{prose(0, 1)}</form>"
    before = [(part("header", f"<h2>{short(1, 5)}</h2>" + prose(0, 1)), 0.5), (part("menu", links(rng.randint(3, 9))), 0.8),
              (part("notice", prose(1, 1) if rng.random() < 0.5 else short(4, 40)), 0.4),
              (part("advert", short(2, 40)), 0.5), (form, 0.25)]
    after = [(part("share", links(rng.randint(1, 5))), 0.3), (part("advert", prose(1, 1)), 0.3), (comments, 0.5),
             (part("side", f"<h3>{short(1, 3)}</h3>" + (links(rng.randint(2, 6)) if rng.random() < 0.5 else prose(1, 3))), 0.5),
             (form, 0.2), (part("notice", prose(1, 1)), 0.3),
             (part("footer", prose(0, 2) + (short(3, 15) if rng.random() < 0.7 else links(3))), 0.85)]
    start = [x for x, p in before if rng.random() < p]
    rng.shuffle(start)
    end = [x for x, p in after if rng.random() < p]
    middle = core
    if rng.random() < 0.4:
        beside = part("side", f"<h4>{short(1, 3)}</h4>" + (prose(1, 2) if rng.random() < 0.5 else links(rng.randint(2, 6))))
        both = [core, beside] if rng.random() < 0.6 else [beside, core]
        middle = f'<div class="{rng.choice(["container", "row", "wrapper", "layout"])}">{"".join(both)}</div>'
    made = "".join([*start, middle, *end])
    if rng.random() < 0.4:
        made = f'<div id="{rng.choice(["page", "wrap", "app", "root"])}">{made}</div>'
    return f"<html><body>{made}</body></html>"


def training_nodes(source: str, seed: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of nodes of a page and of its layouts; none if it does not mark its article."""
    page = dom.parse(source)
    root = article_root(page)
    if root is None:
        return np.zeros((0, dom.N_FEATURES)), np.zeros(0)
    inside = _below(page, {root})
    blocks = [("h1" if page.nodes[o].tag in ("h1", "h2", "h3") else "p", t) for o, t in page.runs if inside[o]]
    x, y = _layout_nodes(random.Random(seed), blocks, [t for _, t in page.runs], settings) if blocks else ([], [])
    x, y = np.concatenate([dom.features(page), *x]), np.concatenate([labels_of(page, inside), *y])
    if len(y) > settings.page_nodes:
        drawn = np.sort(np.random.default_rng(abs(seed)).choice(len(y), settings.page_nodes, replace=False))
        x, y = x[drawn], y[drawn]
    return x, y


def _layout_nodes(rng: random.Random, blocks: list[tuple[str, str]], texts: list[str],
                  settings: Settings) -> tuple[list[np.ndarray], list[np.ndarray]]:
    xs, ys = [], []
    for _ in range(settings.layouts):
        source = lay_out(rng, blocks, texts)
        page = dom.parse(source)
        xs.append(dom.features(page))
        ys.append(_layout_labels(source, page))
    return xs, ys


# What layouts are made of where no page marks its article.
_SENTENCES = [
    "The council met on Tuesday to discuss the plan, and most of its members agreed.",
    "Rain is expected in the north; the south stays dry.", "Nobody had seen the old map before the house was sold.",
    "She wrote three letters, but only one of them was answered.", "In the end, the price fell by a third within two years.",
    "According to the report, the bridge can carry twice the weight that it was built for.", "Why did it take so long?",
    "The first trains ran in spring, when the snow on the pass had melted and the road was open again.",
    "Home", "About us", "Contact", "Read more", "All rights reserved", "Sign in to your account", "Latest news and offers",
]


def built_in_nodes(settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of layouts around articles of built-in sentences."""
    rng = random.Random(7)
    xs, ys = [], []
    for _ in range(settings.train_pages // 2):
        blocks = [("h1", rng.choice(_SENTENCES[:8]))] * rng.randint(0, 1) + [
            ("p", " ".join(rng.choice(_SENTENCES[:8]) for _ in range(rng.randint(1, 8)))) for _ in range(rng.randint(2, 10))]
        x, y = _layout_nodes(rng, blocks, _SENTENCES + [t for _, t in blocks], settings)
        xs += x
        ys += y
    return np.concatenate(xs), np.concatenate(ys)


def _layout_labels(source: str, page: dom.Page) -> np.ndarray:
    """Labels of a layout: below the marked part, but not in the parts put into it."""
    marked = [k for k, x in enumerate(_block_tags(source)) if "data-part=1" in x]
    inside = _below(page, {marked[0] + 1})
    names = list(dom.ATTRIBUTE_GROUPS)
    root = marked[0] + 1
    foreign = {i for i, x in enumerate(page.nodes) if inside[i] and i != root
               and (x.tag in ("aside", "nav", "footer", "header", "form") or any(names[g] != "content" for g in x.groups))}
    inside &= ~_below(page, foreign)
    return labels_of(page, inside)


def _block_tags(source: str) -> list[str]:
    """The start tags that make nodes, in order."""
    return [m[3] for m in dom._TAG.finditer(source)
            if m[2] and not m[1] and m[2].lower() not in dom.INLINE | dom.VOID | dom.RAW_TEXT | dom.HIDDEN | {"html", "body", "head"}]


def fit(pages: DataFrame, settings: Settings = Settings()) -> Forest:
    """Trees from the sample of ``pages`` (page_id, html), or from built-in layouts if no page marks its article."""
    rows = pages.filter(F.col("html").rlike("(?i)<(article|main)[\\s/>]")).select(F.xxhash64("page_id", "html").alias("h"), "html")
    rows = rows.filter(F.col("h") <= F.lit(hash_cut(rows.count(), settings.train_pages)))

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches, "html", 1 << 20):
            made = [training_nodes(s, h, settings) for s, h in zip(b.column("html").to_pylist(), b.column("h").to_pylist())]
            yield pa.record_batch({"h": b.column("h"),
                                   "x": pa.array([x.astype("<f4").tobytes() for x, _ in made], pa.binary()),
                                   "y": pa.array([y.astype("<f4").tobytes() for _, y in made], pa.binary())})
    found = rows.mapInArrow(nodes, "h long, x binary, y binary").filter(F.length("y") > 0).limit(2 * settings.train_pages)
    found = sorted(found.collect(), key=lambda r: (r["h"], r["x"]))
    x = np.frombuffer(b"".join(r["x"] for r in found), "<f4").reshape(-1, dom.N_FEATURES).astype(float)
    y = np.frombuffer(b"".join(r["y"] for r in found), "<f4").astype(float)
    if not len(y) or y.min() == y.max():
        x, y = built_in_nodes(settings)
    return fit_forest(x, y, settings)


def extract_text(source: str, forest: Forest | None) -> list[str]:
    """The kept runs of text of a page, in page order."""
    return _extract_many([source], forest)[0]


def _extract_many(sources: list[str], forest: Forest | None) -> list[list[str]]:
    parsed = [dom.parse(s) for s in sources]
    if forest is None:
        return [[t for _, t in p.runs] for p in parsed]
    if not parsed:
        return []
    made = [dom.features(p) for p in parsed]
    odds = forest.log_odds(np.concatenate(made))
    cut = np.cumsum([len(x) for x in made])
    out = []
    for p, z in zip(parsed, np.split(odds, cut[:-1])):
        kept = decode(p, z)
        out.append([t for o, t in p.runs if kept[o]])
    return out


def extract(pages: DataFrame, forest: Forest | None) -> DataFrame:
    """``pages`` with ``blocks``, the runs of main text of each page in page order."""
    pages = pages.drop("blocks")
    shared = pages.sparkSession.sparkContext.broadcast(forest)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches, "html", 1 << 20):
            blocks = _extract_many([x or "" for x in b.column("html").to_pylist()], shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(blocks, pa.list_(pa.string()))],
                                             [*b.schema.names, "blocks"])
    return pages.mapInArrow(run, f"{fields}, blocks array<string>")
