"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with its path of tags from the root. For each path, text length and punctuation are
added up over its nodes and divided by their number; the ratios are smoothed over neighbouring nodes in page order and fused
into one weight, which links reduce and elements that by tag or name hold no article (menus, adverts, forms, comments ...) don't have.
The part of the page that holds most weight is found by walking down the paths. Ratios choose this container; inside it every path is
content but for those of such names and of mostly links, so that short items of an article stay. Outside it, and on a page that
falls into several parts of which none holds most, paths must pass a threshold.

Everything about a page is decided within the page, so pages are mapped where they lie: nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame

from contrapair.llm.common import map_texts

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# Names of HTML, by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = frozenset("""address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption""".split())
SECTIONS = frozenset("html body main article section div center table tbody tr td span font".split())
CLOSED_BY = {  # an open element that the start of another ends
    "p": BLOCKS - {"body", "html", "head", "br", "td", "th", "tr", "tbody", "caption", "option"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "thead", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option"]), "head": frozenset(["body"]),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("table td th ul ol dl select button article section div main body html".split())
ASIDE_TAGS = frozenset("head nav footer aside button select menu dialog svg canvas audio video object applet datalist search".split())
ASIDE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb
breadcrumbs masthead topbar toolbar footer foot sidebar sidebars side rail aside widget widgets related recommended share sharing social comment comments commentlist
reply replies respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search pagination
pager copyright skip hidden""".split())
# Of these, names that a section of an article may have as well, and parts of a name that say nothing of the role.
WEAK_WORDS = frozenset("share sharing side notice notices reply replies related alert skip foot rail social hidden".split())
NEUTRAL_WORDS = frozenset("""area bar block body bottom box column container content contents group holder inner item items left link links list outer page panel posts right
section site slot text top unit wrap wrapper""".split())
PLAIN_ROLES = {"navigation": 1, "banner": 1, "contentinfo": 1, "complementary": 1, "search": 1, "form": 1, "dialog": 1, "alert": 1, "menu": 1}
PUNCTUATION = re.compile(r"[.,;:!?…、。，？！]")


class Node:
    """A run of text: its path, its block, whether it is inside a link or an element that holds no article, and the doubtful elements around it."""

    __slots__ = ("path", "text", "block", "linked", "aside", "doubts")

    def __init__(self, path, text, block, linked, aside, doubts):
        self.path, self.text, self.block, self.linked, self.aside, self.doubts = path, text, block, linked, aside, doubts


class Doubt:
    """An element that by its class or id or as a form would hold no article, which its contents may refute."""

    __slots__ = ("weak", "article", "weight", "released")

    def __init__(self, weak, article):
        self.weak, self.article, self.weight, self.released = weak, article, 0.0, False


def _aside(tag: str, attributes: str, inside: list[tuple]) -> bool:
    """True for an element that by its tag, role or style holds no article."""
    if tag in ASIDE_TAGS or tag == "header" and not any(e[0] in ("article", "main") for e in inside):
        return True
    if tag in ("html", "body", "main", "article") or not attributes:
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "role" and value in PLAIN_ROLES or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _named(attributes: str) -> set[str]:
    """Words for asides in the classes and the id; a name counts if all its parts are such words or neutral ones."""
    found: set[str] = set()
    for name, value in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for one in value.strip("\"'").lower().split():
                parts = {w for w in re.split(r"[^a-z]+", one) if len(w) > 1}
                if parts <= ASIDE_WORDS | NEUTRAL_WORDS:
                    found |= parts & ASIDE_WORDS
    return found


def _settle(nodes: list[Node], marks: list[tuple]) -> None:
    """Decides which doubtful elements hold no article after all; ``marks`` are the doubts around each h1, article and main, in page order.

    An element is released if it holds the page's first h1, article or main and a fifth of its plain text, or, where none of these stands
    elsewhere, three fifths of it. A section of an article with a weak name is released if its text runs like the rest of the article.
    """
    total, rest = 0.0, [0, 0]
    for n in nodes:
        if n.aside or n.linked:
            continue
        w = len(n.text) * (1.0 + len(PUNCTUATION.findall(n.text)))
        total += w
        for d in n.doubts:
            d.weight += w
        if not n.doubts:
            rest[0] += len(n.text)
            rest[1] += 1
    doubts = {id(d): d for n in nodes for d in n.doubts}.values()
    strong = [around for around in marks if all(d.weight >= 0.2 * total for d in around)]
    for d in doubts:
        d.released = bool(strong) and d in strong[0] or d.weight >= 0.6 * total and all(d in around for around in strong)
    for d in doubts:
        if d.weak and d.article and not d.released:
            own = [n for n in nodes if d in n.doubts and not n.aside]
            plain = [n.text for n in own if not n.linked]
            long = sum(map(len, plain))
            d.released = long > sum(len(n.text) for n in own if n.linked) and bool(PUNCTUATION.search("".join(plain))) and long / len(plain) >= 0.5 * rest[0] / max(1, rest[1])
    for n in nodes:
        n.aside = n.aside or not all(d.released for d in n.doubts)


def _label(tag: str, attributes: str) -> str:
    if tag in ("div", "section", "span", "td", "table"):
        for name, value in ATTRIBUTE.findall(attributes):
            if name.lower() == "class" and value:
                return f"{tag}.{value.strip(chr(34) + chr(39)).split(' ')[0]}"
    return tag


def text_nodes(page: str) -> list[Node]:
    """Text nodes of a page in order; text of scripts, styles and other raw elements is none."""
    nodes: list[Node] = []
    stack: list[tuple] = []  # tag, label, linked, aside, doubts
    marks: list[tuple] = []
    block, at = 0, 0
    path: tuple = ()

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            top = stack[-1] if stack else ("", "", False, False, ())
            nodes.append(Node(path, raw, block, top[2], top[3], top[4]))
        elif raw and nodes and nodes[-1].block == block:
            nodes[-1].text += " "

    find = TOKEN.search
    while True:
        m = find(page, at)
        if m is None:
            text(page[at:])
            _settle(nodes, marks)
            return nodes
        text(page[at:m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in BLOCKS:
            block += 1
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    path = tuple(e[1] for e in stack)
                    break
                if stack[depth][0] in SCOPES and tag not in BLOCKS:
                    break  # a stray end of an inline element doesn't end a block
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        for depth in range(len(stack) - 1, -1, -1):
            if tag in CLOSED_BY.get(stack[depth][0], ()):
                del stack[depth:]
                break
            if stack[depth][0] in SCOPES:
                break
        linked = tag == "a" or bool(stack) and stack[-1][2]
        aside = bool(stack) and stack[-1][3] or _aside(tag, attributes, stack)
        doubts = stack[-1][4] if stack else ()
        words = _named(attributes) if attributes and tag not in ("html", "body", "main", "article") else set()
        if words or tag == "form":
            doubts = (*doubts, Doubt(tag != "form" and words <= WEAK_WORDS, any(e[0] in ("article", "main") for e in stack)))
        if tag in ("h1", "article", "main") and not aside:
            marks.append(doubts)
        stack.append((tag, _label(tag, attributes), linked, aside, doubts))
        path = tuple(e[1] for e in stack)


def main_text(page: str | None, *, share: float = 0.6, threshold: float = 0.25, reach: int = 2) -> str:
    """The article's blocks, one a line; empty if the page has none.

    ``share``: a container is entered while it holds this share of the page's weight. ``threshold``: a path outside
    the container needs this share of the mean weight. ``reach``: neighbours on each side for smoothing.
    """
    nodes = text_nodes(page or "")
    if not nodes:
        return ""
    decoded = [html.unescape(n.text) for n in nodes]
    length = np.array([len(" ".join(t.split())) for t in decoded], dtype=np.float64)
    marks = np.array([len(PUNCTUATION.findall(t)) for t in decoded], dtype=np.float64)
    linked = np.array([n.linked for n in nodes])
    keep = np.array([not n.aside for n in nodes])
    paths = [n.path for n in nodes]
    index = {p: i for i, p in enumerate(dict.fromkeys(paths))}
    of = np.array([index[p] for p in paths])
    count = np.bincount(of).astype(np.float64)
    text_ratio, mark_ratio = np.bincount(of, length) / count, np.bincount(of, marks) / count
    # each node takes its path's ratios, smoothed with a Gaussian over its neighbours in page order
    near = np.exp(-0.5 * np.arange(-reach, reach + 1) ** 2)
    pad = np.convolve(np.ones(len(nodes)), near, mode="full")[reach:reach + len(nodes)]
    t, p = (np.convolve(r[of], near, mode="full")[reach:reach + len(nodes)] / pad for r in (text_ratio, mark_ratio))
    fused = t * (1.0 + p) * keep * np.where(linked, 0.1, 1.0)
    weight = np.bincount(of, fused * length)  # by path, over all of its text
    total = weight.sum()
    if total <= 0:
        return ""
    # walk down to the container that holds most of the weight
    container: tuple = ()
    parted = False
    while True:
        below: dict[tuple, float] = defaultdict(float)
        d = len(container)
        for path, i in index.items():
            if len(path) > d and path[:d] == container:
                below[path[:d + 1]] += weight[i]
        if not below:
            break
        best = max(below, key=lambda c: (below[c], c))
        parted = below[best] < share * total and container[-1:] in ((), ("html",), ("body",)) and not any(
            len(path) > d and path[d].split(".")[0] not in SECTIONS and weight[i] > 0 for path, i in index.items())
        if below[best] < share * total or best[-1].split(".")[0] not in SECTIONS or any(path == best for path in index):
            break
        container = best
    # in the container a path is content unless it is mostly links; elsewhere its weight must come near the mean
    plain, within_links = np.bincount(of, length * ~linked), np.bincount(of, length * linked)
    mean = np.average(weight / np.maximum(np.bincount(of, length), 1.0), weights=weight)
    d = len(container)
    content = np.zeros(len(index), dtype=bool)
    for path, i in index.items():
        if weight[i] <= 0:
            continue
        if within_links[i]:
            above = path[:path.index("a")] if "a" in path else path
            around = [j for other, j in index.items() if other[:len(above)] == above]
            if plain[around].sum() < within_links[around].sum():
                continue
        whole = path[:d] == container and (not parted or path[-1:] and path[-1] in HEADINGS)
        content[i] = whole or weight[i] / max(1.0, plain[i] + within_links[i]) >= threshold * mean
    lines: dict[int, list[str]] = {}
    for n, i, t in zip(nodes, of, decoded, strict=True):
        if content[i] and not n.aside:
            lines.setdefault(n.block, []).append(t)
    blocks = (" ".join("".join(parts).split()) for parts in lines.values())
    return "\n".join(b for b in blocks if b)


def extract(pages: DataFrame, html_col: str, carry: list[str]) -> DataFrame:
    """The columns ``carry`` with ``main_text`` of the whole html.

    * Null or empty html, and pages without an article, give an empty text. Unclosed and stray tags are allowed.
    * Character references are decoded, white space inside a block becomes one space, blocks are joined by a newline.
    * Repeated rows stay rows; null ids are carried; columns that are not carried are not looked at.
    """

    def start():
        return lambda pages: {"main_text": [main_text(p) for p in pages]}

    return map_texts(pages, html_col, carry, {"main_text": "string"}, start)
