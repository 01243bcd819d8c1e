"""A tolerant HTML reader: block nodes, their text runs, and features of each node."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[A-Za-z][a-z]*|[0-9]+")

# HTML element names by their role.
RAW_TEXT = set("script style title iframe".split())
HIDDEN = set("noscript template svg object canvas audio video annotation annotation-xml".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q s samp small span "
             "strike strong sub sup time tt u var label ruby rb rt rp picture "
             "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub msup "
             "msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction semantics".split())
CLOSES_P = set("address article aside blockquote center details dialog div dl fieldset figure figcaption footer form h1 "
               "h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt td th tr".split())
TAG_GROUPS = (
    {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}, {"ul", "ol", "dl", "menu"}, {"li", "dt", "dd"}, {"div"},
    {"section"}, {"article"}, {"main"}, {"nav"}, {"header"}, {"footer"}, {"aside"},
    {"form", "fieldset", "button", "select", "option", "textarea", "legend", "optgroup"},
    {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"},
    {"blockquote", "pre", "figure", "figcaption", "details", "summary"}, {"html", "body", "center"},
)
# Tokens of class, id and role attributes by what they usually name.
ATTRIBUTE_GROUPS = {
    "content": "article articlebody body content entry main post story text page prose blog hentry copy".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topnav tabs toolbar pagination pager skip toc".split(),
    "header": "header head masthead banner topbar logo brand site".split(),
    "footer": "footer foot bottom copyright colophon legal contentinfo".split(),
    "side": "sidebar side aside widget related rail recommend recommended more trending popular complementary teaser".split(),
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner adsense dfp".split(),
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup paywall privacy".split(),
    "comment": "comment comments commentlist reply replies respond disqus discussion reader readers feedback".split(),
    "form": "form search login register input field contact poll survey".split(),
    "share": "share sharing social follow like tweet facebook twitter tags tag meta byline author rating".split(),
}
_GROUP_OF_TOKEN: dict[str, list[int]] = {}
for _i, _words in enumerate(ATTRIBUTE_GROUPS.values()):
    for _w in _words:
        _GROUP_OF_TOKEN.setdefault(_w, []).append(_i)
_GROUP_OF_TAG = {t: i for i, g in enumerate(TAG_GROUPS) for t in g}
_NEGATIVE_TAGS = {"nav", "header", "footer", "aside", "form", "button", "select", "textarea"}
_PUNCTUATION = re.compile(r"[.,;:!?]")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    groups: tuple[int, ...] = ()
    links: int = 0          # characters of its own runs inside links
    runs: list[int] = field(default_factory=list)


@dataclass
class Page:
    """``nodes``: block elements, parents before children; ``runs``: (node, text) in page order."""

    nodes: list[Node]
    runs: list[tuple[int, str]]


def attribute_groups(attributes: str) -> tuple[int, ...]:
    """Numbers of the groups that the words of class, id and role name."""
    found: set[int] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        for token in _TOKEN.findall(m[2] or m[3] or m[4] or ""):
            found.update(_GROUP_OF_TOKEN.get(token.lower(), ()))
    return tuple(sorted(found))


def _raw_text_end(source: str, tag: str, at: int) -> int:
    """End of a raw-text element whose content starts at ``at``; unclosed, it reaches to the end of the page."""
    stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
    return stop.end() if stop else len(source)


def hidden_ends(source: str) -> dict[int, int]:
    """End of each hidden element, by the place after its start tag; those not closed within their parent have none."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    open_tags: dict[str, int] = {}
    at = 0
    while (m := _TAG.search(source, at)) is not None:
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or tag in INLINE or tag in VOID or not m[1] and m[3].rstrip().endswith("/"):
            continue
        if not m[1]:
            if tag in RAW_TEXT:
                at = _raw_text_end(source, tag, at)
            else:
                stack.append((tag, at))
                open_tags[tag] = open_tags.get(tag, 0) + 1
        elif open_tags.get(tag):
            name = ""
            while name != tag:
                name, place = stack.pop()
                open_tags[name] -= 1
            if tag in HIDDEN:
                ends[place] = at
    return ends


def parse(source: str) -> Page:
    """Block nodes and text runs. White space in a run is one space; markup, comments and hidden elements are gone.

    Inline elements do not break a run, <br> is white space in it. Elements
    that are never closed end with their parent. A hidden element (video, svg,
    template, ...) that its parent's end finds open hides nothing: its start tag
    is dropped and what follows is text of the page. Only raw-text elements
    (script, style, title, iframe) reach to the end of the page if unclosed.
    Formulas (math) are inline text.
    """
    hidden: dict[int, int] | None = None
    nodes = [Node("html", -1, 0)]
    runs: list[tuple[int, str]] = []
    stack = [0]
    pieces: list[str] = []
    in_link, link_chars, at, size = 0, 0, 0, len(source)

    def flush() -> None:
        nonlocal link_chars
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                owner = stack[-1]
                nodes[owner].runs.append(len(runs))
                nodes[owner].links += min(link_chars, len(text))
                runs.append((owner, text))
            link_chars = 0

    def add(raw: str) -> None:
        nonlocal link_chars
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if in_link:
            link_chars += len(text)

    while at < size:
        m = _TAG.search(source, at)
        if m is None:
            add(source[at:])
            break
        if m.start() > at:
            add(source[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in INLINE or tag in VOID or tag in RAW_TEXT or tag in HIDDEN:
                continue
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    del stack[k:]
                    in_link = 0
                    break
            continue
        if tag in RAW_TEXT:
            if not m[3].rstrip().endswith("/"):
                at = _raw_text_end(source, tag, at)
            continue
        if tag in HIDDEN:
            if hidden is None:
                hidden = hidden_ends(source)
            at = hidden.get(at, at)
            continue
        if tag in INLINE:
            in_link += tag == "a"
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                pieces.append(" ")
            continue
        flush()
        if tag in ("html", "body", "head"):
            groups = attribute_groups(m[3])
            nodes[0].groups = tuple(sorted({*nodes[0].groups, *groups}))
            continue
        if tag in CLOSES_P and nodes[stack[-1]].tag == "p":
            stack.pop()
        if tag in ("li", "option", "tr", "td", "th", "dt", "dd"):
            like = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(tag, (tag,))
            for k in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[k]].tag
                if open_tag in like:
                    del stack[k:]
                    break
                if open_tag in ("ul", "ol", "dl", "table", "select", "div") or tag in ("td", "th") and open_tag == "tr":
                    break
        nodes.append(Node(tag, stack[-1], nodes[stack[-1]].depth + 1, attribute_groups(m[3]) if m[3] else ()))
        if not m[3].rstrip().endswith("/"):
            stack.append(len(nodes) - 1)
    flush()
    # text beside child blocks is a block of its own
    parents = {x.parent for x in nodes}
    for k, (owner, text) in enumerate(runs):
        if owner in parents:
            nodes.append(Node("#text", owner, nodes[owner].depth + 1, (), 0, [k]))
            runs[k] = (len(nodes) - 1, text)
    return Page(nodes, runs)


N_TAGS, N_GROUPS = len(TAG_GROUPS), len(ATTRIBUTE_GROUPS)
N_FEATURES = N_TAGS + N_GROUPS + 24


def features(page: Page) -> np.ndarray:
    """One row per node: element, attribute tokens, density of its subtree, depth, siblings, ancestors."""
    nodes = page.nodes
    n = len(nodes)
    parent = np.array([x.parent for x in nodes])
    depth = np.array([x.depth for x in nodes], float)
    own, marks, words, links = np.zeros(n), np.zeros(n), np.zeros(n), np.array([x.links for x in nodes], float)
    blocks = np.zeros(n)
    start = np.full(n, -1.0)
    at = 0
    for owner, text in page.runs:
        k = len(text)
        own[owner] += k
        marks[owner] += len(_PUNCTUATION.findall(text))
        words[owner] += text.count(" ") + 1
        blocks[owner] += 1
        if start[owner] < 0:
            start[owner] = at
        at += k
    total = max(at, 1)
    chars, sub_marks, sub_words, sub_links, sub_blocks = own.copy(), marks.copy(), words.copy(), links.copy(), blocks.copy()
    tags, paragraphs = np.ones(n), np.array([x.tag == "p" for x in nodes], float)
    paragraphs_below = paragraphs.copy()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for a in (chars, sub_marks, sub_words, sub_links, sub_blocks, tags, paragraphs_below):
            a[p] += a[i]
        if start[i] >= 0 and (start[p] < 0 or start[i] < start[p]):
            start[p] = start[i]
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[parent[i]].append(i)
    out = np.zeros((n, N_FEATURES))
    base = N_TAGS + N_GROUPS
    for i, x in enumerate(nodes):
        g = _GROUP_OF_TAG.get(x.tag)
        if g is not None:
            out[i, g] = 1
        for g in x.groups:
            out[i, N_TAGS + g] = 1
    index, siblings, alike = np.zeros(n), np.ones(n), np.ones(n)
    before, after, richest = np.zeros(n), np.zeros(n), np.zeros(n)
    for mine in children:
        if not mine:
            continue
        kinds: dict[str, int] = {}
        for c in mine:
            kinds[nodes[c].tag] = kinds.get(nodes[c].tag, 0) + 1
        most = max(chars[c] for c in mine)
        for k, c in enumerate(mine):
            index[c], siblings[c], alike[c] = k, len(mine), kinds[nodes[c].tag] / len(mine)
            before[c] = chars[mine[k - 1]] if k else 0
            after[c] = chars[mine[k + 1]] if k + 1 < len(mine) else 0
            richest[c] = chars[c] / most if most else 0
    bad, good = np.zeros(n), np.zeros(n)
    for i, x in enumerate(nodes):
        bad_here = x.tag in _NEGATIVE_TAGS or any(0 < g for g in x.groups)
        good_here = x.tag in ("article", "main") or 0 in x.groups
        bad[i] = max(bad[parent[i]] if i else 0, float(bad_here))
        good[i] = max(good[parent[i]] if i else 0, float(good_here))
    up = np.maximum(parent, 0)
    columns = (
        depth, np.log1p([len(c) for c in children]), np.log1p(tags), np.log1p(chars), np.log1p(own), np.log1p(sub_words),
        sub_links / np.maximum(chars, 1), links / np.maximum(own, 1), np.log1p(chars / tags), sub_marks / np.maximum(chars, 1),
        sub_words / np.maximum(sub_blocks, 1), np.log1p(paragraphs_below), chars / total, chars / np.maximum(chars[up], 1),
        np.maximum(start, 0) / total, 1 - (np.maximum(start, 0) + chars) / total, index / siblings, np.log1p(siblings), alike,
        np.log1p(before), np.log1p(after), richest, bad, good)
    for k, column in enumerate(columns):
        out[:, base + k] = column
    return out
