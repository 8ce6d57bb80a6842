"""Main text of web pages by a tree-structured graphical model.

The nodes are the block elements of the DOM, each either article or not. A node's potential comes
from what is seen of it: tag, names in class and id, size of its own text, share of link text.
Parent-child potentials join neighbours in the tree. Sum-product messages, upward and then
downward, give every node's exact marginal; blocks whose marginal reaches one half are the text.
The potentials are smoothed frequencies from labelled pages.

Text is the decoded text of those blocks in page order: white space inside a block becomes one
space, blocks are joined by one space. Scripts, styles, comments in the markup and the head never
count as text.

Cases: null or empty html, or a page without article blocks, gives an empty text; broken markup
is read as far as it goes (an open paragraph ends where a block begins that cannot stand in it, an item
where the next begins, an open head where something begins that cannot stand in it, an open comment at
the end of the page); scripts, drawings and buttons inside a line of text leave the line whole; null and
repeated page ids keep their rows; extra columns are ignored; no length is capped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from natal.llm.common import rows_of
from natal.llm.labelled_pages import labelled_pages

#: Elements that never hold text of a page. Those within a line do not part it.
SILENT = frozenset("script style noscript template head title svg iframe object select option button textarea datalist".split())
#: Elements that part blocks; all others, unknown ones too, stand within a line of text.
BLOCKS = frozenset(
    "html body address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup legend li listing main menu nav ol p plaintext pre search section summary table caption colgroup thead "
    "tbody tfoot tr td th ul xmp".split()
)
#: Blocks that can stand in an open paragraph; every other one ends it.
IN_PARAGRAPH = frozenset("html body legend caption colgroup thead tbody tfoot tr td th".split())
#: Elements that can stand in a head; any other ends an open head.
HEAD = frozenset("html head title base link meta style script noscript template".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the key ends, up to the nearest of the second set.
_ITEMS = {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Word parts in class and id that tell what a part of a page is for.
KINDS = {
    "comment": re.compile(r"comment|discuss|repl(y|ies)|respond|disqus|reader|feedback|guestbook", re.I),
    "menu": re.compile(r"nav|menu|breadcrumb|pag(er|ination)|tabs|toc", re.I),
    "side": re.compile(r"side|widget|related|rail|promo|newsletter|social|share|recommend|popular|teaser|subscribe|author-?box|tag-?list|outbrain", re.I),
    "notice": re.compile(r"cookie|consent|notice|notif|banner|popup|modal|alert|gdpr|paywall|disclaimer|overlay", re.I),
    "ad": re.compile(r"(^|[-_ ])(ad|ads|adv|advert\w*|sponsor\w*|adsense|dfp|promoted)([-_ 0-9]|$)", re.I),
    "foot": re.compile(r"foot|legal|copyright|imprint", re.I),
    "head": re.compile(r"header|masthead|topbar|logo|brand", re.I),
    "form": re.compile(r"form|login|search|signup|sign-in", re.I),
    "main": re.compile(r"article|post|entry|story|content|main|body|text", re.I),
}
_GROUPS = {
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "heading"),
    **dict.fromkeys(("ul", "ol", "dl", "menu"), "list"),
    **dict.fromkeys(("li", "dt", "dd"), "item"),
    **dict.fromkeys(("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"), "table"),
    **dict.fromkeys(("form", "fieldset", "button", "textarea", "input", "legend"), "form"),
    **dict.fromkeys(("figure", "figcaption", "details", "summary"), None),
    **dict.fromkeys(("html", "body", "div", "section", "p", "article", "main", "nav", "aside", "header", "footer", "blockquote", "pre"), None),
}


class Node:
    __slots__ = ("tag", "parent", "kind", "mark", "letters", "linked", "silent")

    def __init__(self, tag: str, parent: int, kind: str, mark: str | None, silent: bool):
        self.tag, self.parent, self.kind, self.mark, self.silent = tag, parent, kind, mark, silent
        self.letters = self.linked = 0


def _kind(attributes) -> str:
    names = " ".join(v for k, v in attributes if v and k in ("class", "id", "role", "itemprop"))
    if not names:
        return "none"
    return next((kind for kind, pattern in KINDS.items() if pattern.search(names)), "other")


class Tree(HTMLParser):
    """Block nodes of a page in page order and its runs of text, each with its node."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("root", -1, "none", None, False)]
        self.open = [0]
        self.runs: list[tuple[int, list[str]]] = []
        self.links = 0
        self.broken = True
        self.feed(html)
        if self.rawdata.startswith("<!--"):  # a comment that is not closed goes on to the end
            self.rawdata = ""
        self.close()
        self._leave_out_silent()

    def _leave_out_silent(self) -> None:
        """Elements that hold no text say nothing of the part that they stand in."""
        place, kept = {-1: -1}, []
        for i, node in enumerate(self.nodes):
            if not node.silent:
                place[i] = len(kept)
                node.parent = place[node.parent]
                kept.append(node)
        self.nodes, self.runs = kept, [(place[at], parts) for at, parts in self.runs]

    def handle_starttag(self, tag, attributes):
        if tag not in HEAD:
            self._end_head(tag)
        if tag in VOID:
            if tag != "wbr" and self.runs:
                if tag in ("br", "hr"):
                    self.runs[-1][1].append(" ")
                self.broken |= tag == "hr"
            return
        if tag not in BLOCKS and tag not in SILENT:
            self.links += tag == "a"
            return
        if tag in BLOCKS:
            self.broken = True
            self._end_drawing()
            if tag in _ITEMS:
                self._end(*_ITEMS[tag])
            elif tag not in IN_PARAGRAPH and self.nodes[self.open[-1]].tag == "p":
                self.open.pop()
            self.links = 0
        elif tag in ("head", "title"):
            self.broken = True
        elif tag in _ITEMS:
            self._end(*_ITEMS[tag])
        above = self.nodes[self.open[-1]]
        mark = next((v for k, v in attributes if k == "data-main"), above.mark)
        self.nodes.append(Node(tag, self.open[-1], _kind(attributes), mark, above.silent or tag in SILENT))
        self.open.append(len(self.nodes) - 1)

    def _end_drawing(self) -> None:
        """A block that begins inside an open drawing ends it."""
        for depth in range(len(self.open) - 1, 0, -1):
            node = self.nodes[self.open[depth]]
            if node.tag == "svg":
                del self.open[depth:]
                return
            if not node.silent:
                return

    def _end_head(self, by: str) -> None:
        """End an open head, and what is open in it, where ``by`` cannot stand in it.

        Inside its title words may be marked up; what its noscript or template holds ends no head,
        except that a body ends a noscript.
        """
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.nodes[self.open[depth]].tag
            if tag == "head":
                del self.open[depth:]
                self.broken = True
                return
            if tag == "template" or tag == "noscript" and by != "body" or tag == "title" and by and by not in BLOCKS:
                return

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)  # in HTML the slash means nothing

    def _end(self, ended: set[str], limit: set[str]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.nodes[self.open[depth]].tag
            if tag in limit:
                return
            if tag in ended and (tag != "p" or depth == len(self.open) - 1):
                del self.open[depth:]
                if tag != "p":
                    return

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if tag not in BLOCKS and tag not in SILENT:
            self.links = max(0, self.links - (tag == "a"))
            return
        if tag in BLOCKS or tag in ("head", "title"):
            self.broken = True
        for depth in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[depth]].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        if self.nodes[self.open[-1]].tag == "head" and not data.isspace():
            self._end_head("")
        at = self.open[-1]
        node = self.nodes[at]
        if node.silent:
            return
        size = len(data) - data.count(" ")
        if size:
            node.letters += size
            node.linked += size if self.links else 0
        if self.broken or not self.runs or self.runs[-1][0] != at:
            self.runs.append((at, []))
            self.broken = False
        self.runs[-1][1].append(data)


def observed(nodes: list[Node]) -> list[tuple]:
    """What is seen of each node, one discrete value per feature."""
    letters, linked = [n.letters for n in nodes], [n.linked for n in nodes]
    paragraphs = [0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent
        letters[up] += letters[i]
        linked[up] += linked[i]
        paragraphs[up] += nodes[i].tag == "p"
    out = []
    for i, n in enumerate(nodes):
        tag = _GROUPS.get(n.tag, "rare") or n.tag
        size = min(8, int(math.log2(1 + n.letters)))
        share = min(4, int(5 * linked[i] / letters[i])) if letters[i] else 5
        out.append((("tag", tag), ("kind", n.kind), ("size", size), ("share", share), ("text", min(3, paragraphs[i]))))
    return out


class Model:
    """Log potentials: of a feature's value given the state, of a child's state given its parent's."""

    def __init__(self, pages: list[str], smoothing: float = 0.5):
        seen = [Counter(), Counter()]
        steps = np.full((2, 2), smoothing)
        states = np.full(2, smoothing)
        values: dict[str, set] = {}
        for page in pages:
            nodes = Tree(page).nodes
            state = [int(n.mark == "1") for n in nodes]
            for i, features in enumerate(observed(nodes)):
                states[state[i]] += 1
                seen[state[i]].update(features)
                for name, value in features:
                    values.setdefault(name, set()).add(value)
                if i:
                    steps[state[nodes[i].parent], state[i]] += 1
        self.steps = np.log(steps / steps.sum(axis=1, keepdims=True)).tolist()
        self.root = np.log(states / states.sum()).tolist()
        self.unseen = 0.0
        self.weights = {
            (name, value): tuple(
                math.log((seen[y][(name, value)] + smoothing) / (states[y] + smoothing * len(values[name]))) for y in (0, 1)
            )
            for name in values
            for value in values[name]
        }

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(article) of every node: messages up from the leaves, then down from the root."""
        own = []
        for features in observed(nodes):
            pair = [0.0, 0.0]
            for f in features:
                w = self.weights.get(f)
                if w:
                    pair[0] += w[0]
                    pair[1] += w[1]
            own.append(pair)
        (t00, t01), (t10, t11) = self.steps
        up = [None] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):  # children come after their parent
            a, b = own[i]
            up[i] = (_add(t00 + a, t01 + b), _add(t10 + a, t11 + b))
            above = own[nodes[i].parent]
            above[0] += up[i][0]
            above[1] += up[i][1]
        belief = [None] * len(nodes)
        belief[0] = (own[0][0] + self.root[0], own[0][1] + self.root[1])
        for i in range(1, len(nodes)):
            p = belief[nodes[i].parent]
            p0, p1 = p[0] - up[i][0], p[1] - up[i][1]
            belief[i] = (own[i][0] + _add(p0 + t00, p1 + t10), own[i][1] + _add(p0 + t01, p1 + t11))
        return [1 / (1 + math.exp(max(-60.0, min(60.0, a - b)))) for a, b in belief]


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model fitted to the labelled pages, once per worker; the pages are always the same."""
    return Model(labelled_pages())


def main_text(html: str | None, model: Model | None = None) -> str:
    if not html:
        return ""
    tree = Tree(html)
    marginal = (model or trained()).marginals(tree.nodes)
    blocks = (" ".join("".join(parts).split()) for at, parts in tree.runs if marginal[at] >= 0.5)
    return " ".join(b for b in blocks if b)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""

    def run(batches):
        model = trained()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(h, model) for h in rows_of(part, "html", 32)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint"
    )
