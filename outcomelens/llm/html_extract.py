"""Main text of web pages by wrapper induction.

Pages of a host share a template. Every scan task aligns the DOM trees of the pages it meets, host by host, by simple
tree matching: two nodes match if their labels do, and the children of matched nodes are aligned in order so
that the most nodes match. The merged tree of a host is its wrapper; it counts, for every node, the pages
that have it and its text and link characters. Wrappers of different tasks are merged in
the same way, so all pages of a host count and only wrappers are shuffled.

A text that recurs at its kind of node on nearly all pages is template: the pages of every text are counted, none left out. Varying slots are content, those of menus, adverts,
footers and the like excepted; the content's root is the deepest container outside of which no varying text stands but
in links, or an article or main element that holds half of it. A page's content is what aligns with that root.

Names of classes and ids are a prior: where all words of a name say the same, the element goes; where others stand beside them, it
goes if pages of its host have it throughout.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .common import bounded

#: A text is template if it stands at its node on at least this share of a host's pages, of which there are at least so many.
CONSTANT, ENOUGH = 0.8, 5
#: Nodes of a wrapper of all pages of a host. Rare ones go first.
NODES = 2000
#: Hosts, nodes of their wrappers and counts of texts that a scan task holds before it passes them on.
HOSTS, HELD, COUNTS = 2000, 200_000, 200_000
#: Wrappers are broadcast up to this size in all, measured beforehand.
BROADCAST_BYTES = 64 << 20
#: Deeper elements become siblings; their end tags still close them and nothing else.
DEPTH = 150

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
_LEAF = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd pre blockquote tr td th caption figcaption address".split())
_CELL = frozenset(("td", "th"))
#: Elements whose start ends an open one of the second list, up to an element of the third.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: Never content.
_DROPPED = frozenset(
    "head script style noscript template nav footer aside form button select option input textarea iframe object svg canvas "
    "audio video map dialog menu".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar footer masthead topbar comment comments disqus reply replies respond cookie cookies consent "
    "gdpr notice notices popup modal overlay newsletter subscribe subscription social share sharing related recommended "
    "recommendations widget toolbar pagination pager login signup signin search copyright".split()
)
#: Words that say nothing about what an element is. A name of these and of the words above names a kind of element for sure; with any other
#: word in it, it may be the article's own matter (the history of social work, the law of copyright) and recurrence decides.
_PLAIN = frozenset(
    "area bar block body bottom box button buttons card cell center col column container content count div entry feed fixed footer form "
    "frame global grid group header holder icon icons inline inner item items label left link links list main middle module outer page "
    "panel primary right row rows secondary section site slot small sticky tab text thread title top unit view wrap wrapper zone".split()
)
#: After a name stand attributes. A quote opens a string only right after an equals sign; elsewhere it is a character like any other, and so
#: is one that never ends.
_TAG = re.compile(
    r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<rest>(?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=\s*[^\s\"'>][^\s>]*|=)*+)(?P<close>>|\Z)?)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?", re.S)
_SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    """An element: its children are elements and texts."""

    __slots__ = ("tag", "label", "dropped", "suspect", "children", "weight")

    def __init__(self, tag: str, label: str = "", dropped: bool = False, suspect: bool = False):
        self.tag, self.label, self.dropped, self.suspect, self.children, self.weight = tag, label or tag, dropped, suspect, [], -1


def _element(tag: str, rest: str) -> Node:
    if "=" not in rest and "hidden" not in rest:
        return Node(tag, tag, tag in _DROPPED)
    dropped, suspect = tag in _DROPPED, False
    identity = ""
    for match in _ATTRIBUTE.finditer(rest):
        name = match[1].lower()
        if name not in ("class", "id", "role", "hidden", "style", "aria-hidden"):
            continue
        value = match[2] or match[3] or match[4] or ""
        if name in ("class", "id"):
            for name in value.split():
                found = {w.lower() for w in _SPLIT.split(name) if w and not w.isdigit()}
                if not found.isdisjoint(_WORDS):
                    sure = found <= _WORDS | _PLAIN
                    dropped, suspect = dropped or sure, suspect or not sure
            identity += "." + " ".join(sorted(re.sub(r"[0-9]+", "0", value).split()))
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            dropped = True
        elif name == "role":
            dropped |= value.lower() in _ROLES
        elif name == "style":
            dropped |= "display:none" in value.replace(" ", "").lower()
    return Node(tag, tag + identity, dropped, suspect)


def parse(html: str) -> Node:
    """A tree of the page, whatever its errors: open elements end with their parents or the page."""
    root = Node("#root")
    stack = [root]
    opened: dict[str, int] = defaultdict(int)
    at, end = 0, len(html)

    def push(node: Node) -> None:
        inside = len(stack) > DEPTH and stack[-1].dropped
        if len(stack) >= DEPTH and (inside or not node.dropped):
            flat = Node(node.tag, dropped=inside)
            flat.children = stack[-1].children
            node = flat
        stack.append(node)
        opened[node.tag] += 1

    def pop(k: int) -> None:
        for one in stack[k:]:
            opened[one.tag] -= 1
        if k >= DEPTH and any(one.tag not in _INLINE for one in stack[k:]):
            stack[k - 1].children.append(Node("div"))  # what follows is a block of its own
        del stack[k:]

    while at < end:
        match = _TAG.search(html, at)
        if not match:
            stack[-1].children.append(html[at:])
            break
        if match.start() > at:
            stack[-1].children.append(html[at : match.start()])
        at = match.end()
        name = match["name"]
        if not name:
            continue
        if match["close"] != ">":  # the page ends inside the tag
            if (at := html.find(">", at) + 1) == 0:
                break
        tag = name.lower()
        if match["end"]:
            if not opened.get(tag):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    pop(k)
                    break
                if tag == "p" and stack[k].tag in ("article", "section", "div", "main"):
                    break
            continue
        if tag in _CLOSES:
            closed, until = _CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in until:
                    break
                if stack[k].tag in closed:
                    pop(k)
                    if tag not in ("tr", "dt", "dd"):
                        break
        if tag in _ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    pop(k)
                    break
                if stack[k].tag not in _INLINE:
                    break
        node = _element(tag, match["rest"])
        stack[-1].children.append(node)
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            node.dropped = True
            at = close.end() if close else end
        elif tag not in _VOID:
            push(node)
    return root


def _weigh(node: Node) -> int:
    """Characters of text in an element, for the guard on dropping; scripts and the like weigh nothing."""
    total = 0
    for child in node.children:
        total += len(child) if type(child) is str else 0 if child.tag in _DROPPED else _weigh(child)
    node.weight = total
    return total


def _spare_main(node: Node, whole: int, in_article: bool = False) -> None:
    """A name like 'sidebar' drops no element that holds most of the page's text; a header outside the article or main goes."""
    for child in node.children:
        if type(child) is str:
            continue
        if child.dropped and child.tag not in _DROPPED and 10 * child.weight > 6 * whole and child.tag not in _RAW:
            child.dropped = False
        if child.tag == "header" and not in_article and 10 * child.weight <= 6 * whole:
            child.dropped = True
        if not child.dropped:
            _spare_main(child, whole, in_article or child.tag in ("article", "main"))


def _settle(node: Node, template: frozenset[int], in_article: bool = False) -> None:
    """Elements whose names only suggest what they are: those that recur on the host's pages go, and outside of the article, where no
    host tells, all."""
    for child in node.children:
        if type(child) is str or child.dropped:
            continue
        if child.suspect and (suspicion(child) in template or not (template or in_article)):
            child.dropped = True
        else:
            _settle(child, template, in_article or child.tag in ("article", "main"))


def suspicion(node: Node) -> int:
    """Code under which the pages with such an element are counted."""
    return code_of("?", node.label)


def suspects(node: Node) -> Iterator[int]:
    """Codes of the suspect elements in it."""
    for child in node.children:
        if type(child) is not str and not child.dropped:
            if child.suspect:
                yield suspicion(child)
            yield from suspects(child)


def tidy(text: str) -> str:
    return " ".join(unescape(text).split())


def blocks(node: Node) -> list[tuple[str, str, int]]:
    """(label, text, link characters) of the blocks in an element, in page order; dropped elements give none."""
    out: list[tuple[str, str, int]] = []
    parts: list[str] = []
    links = 0

    def flush(label: str) -> None:
        nonlocal links
        text = tidy("".join(parts))
        if text:
            out.append((label, text, min(links, len(text))))
        parts.clear()
        links = 0

    def walk(one: Node, label: str, linked: bool) -> None:
        nonlocal links
        for child in one.children:
            if type(child) is str:
                parts.append(child)
                if linked:
                    links += len(child)
            elif child.dropped:
                continue
            elif child.tag in _INLINE:
                if child.tag == "br":
                    parts.append(" ")
                walk(child, label, linked or child.tag == "a")
            elif child.tag in _CELL:
                parts.append(" ")
                walk(child, label, linked)
                parts.append(" ")
            else:
                flush(label)
                walk(child, child.label, linked)
                flush(child.label)

    walk(node, node.label, False)
    flush(node.label)
    return out


class Shape:
    """A node of a generalised tree: block elements only, a run of like siblings being one node.

    ``pages`` had it, with ``chars`` of own text in all that is not template, ``links`` of them in links; ``fixed`` are the template's.
    """

    __slots__ = ("label", "tag", "dropped", "pages", "chars", "links", "fixed", "kids", "nodes")

    def __init__(self, label: str, tag: str, dropped: bool):
        self.label, self.tag, self.dropped = label, tag, dropped
        self.pages, self.chars, self.links, self.fixed = 1, 0, 0, 0
        self.kids: list[Shape] = []
        self.nodes: list[Node] = []

    def to_list(self) -> list:
        return [self.label, self.tag, int(self.dropped), self.pages, self.chars, self.links, self.fixed, [k.to_list() for k in self.kids]]

    @classmethod
    def from_list(cls, row: list) -> Shape:
        one = cls(row[0], row[1], bool(row[2]))
        one.pages, one.chars, one.links, one.fixed = row[3], row[4], row[5], row[6]
        one.kids = [cls.from_list(k) for k in row[7]]
        return one

    def size(self) -> int:
        return 1 + sum(k.size() for k in self.kids)

    def forget(self) -> None:
        """Lets go of the page's elements."""
        self.nodes = []
        for kid in self.kids:
            kid.forget()


def code_of(label: str, text: str) -> int:
    """A hash of a text and the label of its node, in the range of a signed long."""
    return xxhash.xxh3_64_intdigest(f"{label}\0{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


def shape_of(node: Node, template: frozenset[int] = frozenset()) -> Shape:
    """The generalised tree of one page or element. Its texts are those of ``blocks``."""
    shape = Shape(node.label + "!" * node.dropped, node.tag, node.dropped)  # a dropped element matches no other
    shape.nodes.append(node)
    parts: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        text = tidy("".join(parts))
        if text and code_of(node.label, text) in template:
            shape.fixed += len(text)
        elif text:
            shape.chars += len(text)
            shape.links += min(links, len(text))
        parts.clear()
        links = 0

    def add(child: Node) -> None:
        kid = shape_of(child, template)
        if shape.kids and shape.kids[-1].label == kid.label:
            _absorb(shape.kids[-1], kid)
        else:
            shape.kids.append(kid)

    def walk(one: Node, linked: bool) -> None:
        nonlocal links
        for child in one.children:
            if type(child) is str:
                parts.append(child)
                if linked:
                    links += len(child.strip())
            elif child.tag in _RAW or child.tag == "head":
                continue
            elif child.dropped:
                add(child)
            elif child.tag in _INLINE:
                parts.append(" " if child.tag == "br" else "")
                walk(child, linked or child.tag == "a")
            elif child.tag in _CELL:
                parts.append(" ")
                walk(child, linked)
                parts.append(" ")
            else:
                flush()
                add(child)

    walk(node, False)
    flush()
    return shape


def _absorb(run: Shape, kid: Shape) -> None:
    """Adds a like sibling of the same page to a run: the page still counts once."""
    run.chars += kid.chars
    run.links += kid.links
    run.fixed += kid.fixed
    run.nodes += kid.nodes
    for a, b in align(run.kids, kid.kids):
        if a is not None and b is not None:
            _absorb(a, b)
        elif b is not None:
            run.kids.append(b)


def matching(a: Shape, b: Shape) -> int:
    """Simple tree matching: the most nodes that an order-keeping alignment of the two trees can match."""
    if a.label != b.label:
        return 0
    x, y = a.kids, b.kids
    if not x or not y:
        return 1
    if len(x) == len(y) and all(p.label == q.label for p, q in zip(x, y, strict=True)):
        return 1 + sum(map(matching, x, y))
    x, y = _shared(x, y)
    return 1 + _table(x, y)[0][-1][-1] if x else 1


def _shared(x: list[Shape], y: list[Shape]) -> tuple[list[Shape], list[Shape]]:
    """The nodes whose label the other list has as well; no others can match."""
    both = {k.label for k in x} & {k.label for k in y}
    return [k for k in x if k.label in both], [k for k in y if k.label in both]


def _table(x: list[Shape], y: list[Shape]):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    score = [[matching(p, q) for q in y] for p in x]
    for i in range(1, len(x) + 1):
        row, above = best[i], best[i - 1]
        for j in range(1, len(y) + 1):
            row[j] = max(row[j - 1], above[j], above[j - 1] + score[i - 1][j - 1])
    return best, score


def align(x: list[Shape], y: list[Shape]) -> list[tuple[Shape | None, Shape | None]]:
    """Both lists in order, matched nodes side by side."""
    if len(x) == len(y) and all(p.label == q.label for p, q in zip(x, y, strict=True)):
        return list(zip(x, y, strict=True))
    p, q = _shared(x, y)
    best, score = _table(p, q)
    pairs: list[tuple[Shape, Shape]] = []
    i, j = len(p), len(q)
    while i and j:
        if score[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + score[i - 1][j - 1]:
            i, j = i - 1, j - 1
            pairs.append((p[i], q[j]))
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i -= 1
    out: list[tuple[Shape | None, Shape | None]] = []
    left, right = iter(x), iter(y)
    for a, b in reversed(pairs):
        out += [(one, None) for one in iter(lambda: next(left), a)]
        out += [(None, one) for one in iter(lambda: next(right), b)]
        out.append((a, b))
    return out + [(one, None) for one in left] + [(None, one) for one in right]


def merge(wrapper: Shape, other: Shape) -> None:
    """Aligns another page's tree, or another wrapper, with a wrapper and adds it."""
    wrapper.pages += other.pages
    wrapper.chars += other.chars
    wrapper.links += other.links
    wrapper.fixed += other.fixed
    kids = []
    for a, b in align(wrapper.kids, other.kids):
        if a is not None and b is not None:
            merge(a, b)
        elif b is not None:
            b.forget()
        kids.append(a if a is not None else b)
    wrapper.kids = kids
    wrapper.nodes = []


def prune(wrapper: Shape, way: Iterable[Shape] = ()) -> None:
    """Drops the rarest nodes of a wrapper of all pages of a host that has outgrown its bound, those of ``way`` and beside it excepted."""
    kept = {id(one) for step in way for one in (step, *step.kids)}
    least = 2
    while wrapper.size() > NODES and least <= 2 * wrapper.pages:
        _without(wrapper, least, kept)
        least *= 2


def _without(one: Shape, least: int, kept: set[int]) -> None:
    one.kids = [k for k in one.kids if k.pages >= least or id(k) in kept]
    for kid in one.kids:
        _without(kid, least, kept)


def page_tree(html: str, template: frozenset[int] | None = None) -> Node:
    """The page's elements, the dropped ones marked; those that are only suspect stay where no template is given."""
    root = parse(html)
    if template is not None:
        _settle(root, template)
    _spare_main(root, max(1, _weigh(root)))
    return root


def page_shape(html: str, template: frozenset[int] = frozenset()) -> tuple[Node, Shape]:
    root = page_tree(html, template)
    return root, shape_of(root, template)


class Wrapper:
    """What extraction needs of a host: the codes of its template texts, whether they stay in the content, and the way to the
    content's root in its merged tree.

    They stay where they are most of the root's text over all pages: there the article itself recurs. Where nothing varies, the
    recurring text shows the way.
    """

    def __init__(self, tree: Shape, template: frozenset[int] = frozenset(), way: list[int] | None = None, stay: bool = False):
        self.tree, self.template, self.stay = tree, template, stay
        self.way: list[Shape] = [tree]
        if way is None:
            chars, fixed = self._sums(tree)
            if not chars and fixed:
                self._release(tree)
            self._mass: dict[int, int] = {}
            self._weigh(tree)
            self._descend(tree, False)
            sums = self._sums(self.way[-1])
            self.stay = sums[1] > sums[0] or (not chars and fixed > 0)
        else:
            for k in way:
                self.way.append(self.way[-1].kids[k])

    def to_json(self) -> str:
        """The tree, pruned off the way, and the way."""
        prune(self.tree, self.way)
        places = [[id(k) for k in before.kids].index(id(step)) for before, step in zip(self.way, self.way[1:], strict=False)]
        return json.dumps([self.tree.to_list(), places, self.stay])

    @classmethod
    def from_json(cls, text: str, template: frozenset[int]) -> Wrapper:
        tree, way, stay = json.loads(text)
        return cls(Shape.from_list(tree), template, way, stay)

    def _sums(self, one: Shape) -> tuple[int, int]:
        """Characters of varying and of template text, dropped elements excepted."""
        if one.dropped:
            return 0, 0
        parts = [self._sums(k) for k in one.kids]
        return one.chars + sum(p[0] for p in parts), one.fixed + sum(p[1] for p in parts)

    def _release(self, one: Shape) -> None:
        one.chars, one.fixed = one.chars + one.fixed, 0
        for kid in one.kids:
            self._release(kid)

    def _weigh(self, one: Shape) -> int:
        """Varying text outside of links, dropped elements excepted."""
        own = 0
        if not one.dropped:
            own = max(0, one.chars - one.links) + sum(self._weigh(k) for k in one.kids)
        self._mass[id(one)] = own
        return own

    def _marked(self, one: Shape) -> bool:
        """Whether an article or main element in it holds at least half of the varying text."""
        if one.dropped or 2 * self._mass[id(one)] < self._mass[id(self.tree)] or not self._mass[id(one)]:
            return False
        return one.tag in ("article", "main") or any(map(self._marked, one.kids))

    def _varies(self, one: Shape) -> bool:
        """Whether varying text stands in it that is not mostly links; a headline may be one."""
        return not one.dropped and (one.chars > (0 if one.tag == "h1" else 2 * one.links) or any(map(self._varies, one.kids)))

    def _descend(self, one: Shape, in_main: bool) -> None:
        if one.tag == "article":
            return
        in_main |= one.tag == "main"
        goal = None if in_main else next(filter(self._marked, one.kids), None)
        if goal is None and one.chars <= 2 * one.links:
            holding = list(filter(self._varies, one.kids))
            if len(holding) == 1 and holding[0].tag not in _LEAF:
                goal = holding[0]
        if goal is not None:
            self.way.append(goal)
            self._descend(goal, in_main)

    def roots(self, shape: Shape) -> list[Node]:
        """The page's elements that align with the content's root; none if the page has another layout."""
        at = shape
        for before, step in zip(self.way, self.way[1:], strict=False):
            at = next((b for a, b in align(before.kids, at.kids) if a is step and b is not None), None)
            if at is None:
                return []
        return at.nodes


def extract(html: str | None, wrapper: Wrapper | None) -> str:
    """A page's main text: its blocks joined by newlines."""
    if not html:
        return ""
    root, shape = page_shape(html, wrapper.template if wrapper else frozenset())
    nodes = wrapper.roots(shape) if wrapper else []
    found = [b for node in nodes for b in blocks(node)]
    if not found:  # another layout: the page is its own wrapper
        found = [b for node in Wrapper(shape).roots(shape) for b in blocks(node)]
    if not found:
        found = blocks(root)
    if wrapper and wrapper.template and not wrapper.stay:
        # a page without any other text keeps its template's
        found = [b for b in found if code_of(b[0], b[1]) not in wrapper.template] or found
    return "\n".join(text for _, text, _ in found)


def host_of(url):
    """The host in a url, in lower case; empty for null or none."""
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan task over (host, html): the pages of every host (no code) and of every text of its."""
    held: Counter[tuple[str, int | None]] = Counter()

    def passed_on() -> pa.RecordBatch:
        arrays = [pa.array([h for h, _ in held], pa.string()), pa.array([c for _, c in held], pa.int64()), pa.array(held.values(), pa.int64())]
        rows = pa.RecordBatch.from_arrays(arrays, names=["host", "code", "n"])
        held.clear()
        return rows

    for batch in batches:
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not html:
                continue
            held[host, None] += 1
            tree = page_tree(html)
            for code in {*(code_of(label, text) for label, text, _ in blocks(tree)), *suspects(tree)}:
                held[host, code] += 1
            if len(held) >= COUNTS:
                yield passed_on()
    yield passed_on()


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, codes) for the hosts of (host, html) that have template texts.

    Every text of every page is counted, in partial sums by host and text, so the result does not depend on how pages
    fall into tasks. A host has at most 1 / CONSTANT times as many template texts as its pages have texts.
    """
    n = pages.mapInArrow(_count, "host string, code long, n long").groupBy("host", "code").agg(F.sum("n").alias("n"))
    n = scratch.table(n.where(F.col("code").isNull() | (F.col("n") >= math.ceil(CONSTANT * ENOUGH))), "texts")
    hosts = n.where(F.col("code").isNull() & (F.col("n") >= ENOUGH)).select("host", F.col("n").alias("pages"))
    common = n.where("code is not null").join(bounded(hosts), "host").where(F.col("n") >= F.col("pages") * CONSTANT - 1e-6)
    return common.groupBy("host").agg(F.sort_array(F.collect_list("code")).alias("codes"))


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan task over (host, html, codes): the wrappers of the hosts it meets, with all their nodes."""
    held: dict[str, Shape] = {}
    template: dict[str, frozenset[int]] = {}
    nodes = 0

    def passed_on() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([json.dumps(w.to_list()) for w in held.values()], pa.string())], names=["host", "tree"]
        )
        held.clear()
        template.clear()
        return rows

    for batch in batches:
        for host, html, codes in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if not html:
                continue
            if host not in template:
                template[host] = frozenset(codes or ())
            _, shape = page_shape(html, template[host])
            nodes += shape.size()
            if host in held:
                merge(held[host], shape)
            else:
                shape.forget()
                held[host] = shape
            if nodes > HELD:  # so far counted as if none had matched
                nodes = sum(w.size() for w in held.values())
            if len(held) >= HOSTS or 2 * nodes > HELD:
                yield passed_on()
                nodes = 0
    yield passed_on()


def _met(rows: pd.DataFrame) -> Shape:
    trees = [Shape.from_list(json.loads(t)) for t in sorted(rows["tree"])]
    for other in trees[1:]:
        merge(trees[0], other)
    return trees[0]


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": rows["host"].iloc[:1].to_numpy(), "tree": [json.dumps(_met(rows).to_list())]})


def _whole(rows: pd.DataFrame) -> pd.DataFrame:
    """The last merge: all pages of the host have met, so the way is found before any node goes."""
    return pd.DataFrame({"host": rows["host"].iloc[:1].to_numpy(), "tree": [Wrapper(_met(rows)).to_json()]})


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, tree) for every host of (host, html, codes of the host's template texts).

    Every scan task may have a wrapper of a large host. They meet in two steps, each of about the square root of the
    number of tasks, so no task merges very many.
    """
    salts = math.isqrt(pages.rdd.getNumPartitions()) + 1
    local = pages.mapInArrow(_induce, "host string, tree string")
    salted = local.withColumn("_salt", F.pmod(F.xxhash64("tree"), F.lit(salts)))
    some = salted.groupBy("host", "_salt").applyInPandas(_merged, "host string, tree string")
    return some.groupBy("host").applyInPandas(_whole, "host string, tree string")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    had: dict[tuple[str, str], Wrapper] = {}
    for batch in batches:
        texts = []
        columns = [batch.column(c).to_pylist() for c in ("html", "host", "tree", "codes")]
        for html, host, tree, codes in zip(*columns, strict=True):
            if tree is not None and (host, tree) not in had:
                if len(had) > 200:
                    had.clear()
                had[host, tree] = Wrapper.from_json(tree, frozenset(codes or ()))
            texts.append(extract(html, had[host, tree] if tree is not None else None))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def _small(df: DataFrame, size) -> DataFrame:
    """Marks a table for broadcast if its measured size allows."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def main_text(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per row of (page_id, url, html): page_id, url, text, n_chars.

    Text is the article's blocks, character references decoded, white space within a block one space, blocks joined in page
    order by a newline. Null and empty pages have empty text. Where template texts are most of the content of a host, they stay. Pages without a host in their url share the empty
    host. A host with fewer than five pages has no template texts; its content is still found by its layout.
    Other columns are ignored.
    """
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    fixed = scratch.table(templates(rows.select("host", "html"), scratch), "templates")
    fixed = _small(fixed, F.size("codes") * 8 + 40)
    trees = wrappers(rows.join(fixed, "host", "left").select("host", "html", "codes"))
    trees = scratch.table(trees.join(fixed, "host", "left"), "wrappers")
    trees = _small(trees, F.length("tree") + F.coalesce(F.size("codes"), F.lit(0)) * 8 + 40)
    kind = dict(pages.dtypes)["page_id"]
    return rows.join(trees, "host", "left").select("page_id", "url", "html", "host", "tree", "codes").mapInArrow(
        _extract, f"page_id {kind}, url string, text string, n_chars long"
    )
