"""A small forgiving HTML parser and simple tree matching, for html_extract."""

from __future__ import annotations

import re
from html import unescape

import numpy as np

#: Product of the lengths of two lists up to which plain loops are faster than arrays.
SMALL = 600

#: Fixed lists of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noscript iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"br", "body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CHROME_TAGS = set("head nav header footer aside form button select input script style noscript template iframe svg canvas dialog menu object".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in names that mark what is not content wherever they stand, and such that a part of the content may bear too.
SURE_NAMES = set(
    "nav navbar navigation masthead footer sidebar cookie cookies consent gdpr banner ad ads advert adverts advertisement sponsor sponsored promo "
    "promotion popup modal newsletter subscribe breadcrumb breadcrumbs comment comments commentlist replies respond disqus pagination pager toolbar "
    "login signin signup".split()
)
LIKELY_NAMES = set("menu header aside widget notice alert overlay subscription share sharing social related recommended search skip".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup")
#: Characters outside of links from which an element of a likely name counts as prose.
PROSE = 80

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
_attr = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")

class Node:
    """An element. chrome: known not to be content by tag, role or name; likely: its name alone suggests it.

    Set when the page has been read: `shape`, a number that elements of equal keys and equal shapes below share; `size`,
    the characters of content below; `linked`, those of them in links; `inside`, whether a block stands below; `unit`,
    whether it is a lowest block, or stands beside blocks.
    """

    __slots__ = ("tag", "key", "kids", "elements", "chrome", "likely", "shape", "size", "linked", "inside", "unit")

    def __init__(self, tag: str, key: str, chrome: bool = False, likely: bool = False):
        self.tag, self.key, self.chrome, self.likely = tag, key, chrome, likely
        self.kids: list[Node | str] = []
        self.elements: list[Node] = []
        self.unit = False

    def add(self, kid: Node) -> None:
        self.kids.append(kid)
        self.elements.append(kid)

    @property
    def counts(self) -> bool:
        """Whether it is content as far as tag and name tell."""
        return not self.chrome and not (self.likely and self.size - self.linked < PROSE)


def _element(tag: str, attrs: str) -> Node:
    if not attrs or attrs.isspace():
        return Node(tag, tag, tag in CHROME_TAGS)
    found = {k.lower(): v.strip("\"'") if v else "" for k, v in _attr.findall(attrs)}
    style = found.get("style", "").replace(" ", "").lower()
    names = [re.split(r"[-_]+", x.strip("-_")) for a in ("class", "id") for x in found.get(a, "").lower().split()] if tag not in ("html", "body") else []
    chrome = (
        tag in CHROME_TAGS
        or found.get("role", "").lower() in CHROME_ROLES
        or "hidden" in found
        or found.get("aria-hidden", "").lower() == "true"
        or "display:none" in style
        or any(w in SURE_NAMES for x in names for w in x)
    )
    likely = tag not in ("p", *HEADINGS) and any(x[0] in LIKELY_NAMES for x in names)
    return Node(tag, f"{tag}.{found.get('class', '').lower()}" if found.get("class") else tag, chrome, likely)


class Shapes:
    """Numbers of the shapes of trees that are compared with each other."""

    def __init__(self) -> None:
        self.number: dict[tuple, int] = {}
        self.key: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.nodes: list[int] = []
        self.matches: dict[tuple[int, int], int] = {}

    def of(self, key: str, kids: tuple[int, ...]) -> int:
        n = self.number.setdefault((key, kids), len(self.key))
        if n == len(self.key):
            self.key.append(key)
            self.kids.append(kids)
            self.nodes.append(1 + sum(map(self.nodes.__getitem__, kids)))
        return n

    def match(self, a: int, b: int) -> int:
        """Pairs of a largest order-preserving mapping of two shapes; without recursion, as pages may be deep."""
        todo, known = [(a, b)], self.matches
        while todo:
            x, y = todo[-1]
            if (x, y) in known:
                todo.pop()
            elif self.key[x] != self.key[y]:
                known[x, y] = 0
            elif x == y:
                known[x, y] = self.nodes[x]
            elif not self.kids[x] or not self.kids[y]:
                known[x, y] = 1
            else:
                same, xs, ys, _ = self._trimmed(self.kids[x], self.kids[y])
                if need := [(p, q) for p in set(xs) for q in set(ys) if (p, q) not in known]:
                    todo.extend(need)
                else:
                    known[x, y] = 1 + same + int(self._last_row(xs, ys)[-1])
        return known[a, b]

    def _trimmed(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[int, ...], int]:
        """Nodes of equal shapes at the start and end of two lists, which some largest mapping pairs; what lies between,
        and where it starts.
        """
        head, most = 0, min(len(xs), len(ys))
        while head < most and xs[head] == ys[head]:
            head += 1
        tail = 0
        while tail < most - head and xs[-1 - tail] == ys[-1 - tail]:
            tail += 1
        same = sum(self.nodes[i] for i in (*xs[:head], *xs[len(xs) - tail :]))
        return same, xs[head : len(xs) - tail], ys[head : len(ys) - tail], head

    def _weights(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> dict[int, np.ndarray]:
        kinds = {q: i for i, q in enumerate(dict.fromkeys(ys))}
        place = np.array([kinds[q] for q in ys], np.int64)
        return {p: np.array([self.matches[p, q] for q in kinds], np.int64)[place] for p in set(xs)}

    def _last_row(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> np.ndarray | list[int]:
        """Pairs of the largest mapping of all of xs to each beginning of ys."""
        if len(xs) * len(ys) <= SMALL:
            known, row = self.matches, [0] * (len(ys) + 1)
            for p in xs:
                above, left = row, 0
                row = [0]
                for j, q in enumerate(ys):
                    left = max(left, above[j + 1], above[j] + known[p, q])
                    row.append(left)
            return row
        row, weights = np.zeros(len(ys) + 1, np.int64), self._weights(xs, ys)
        for p in xs:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights[p]))
        return row

    def align(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of the pairs of a largest mapping. Long lists are halved (Hirschberg), so memory is linear."""
        out, todo = [], [(0, len(xs), 0, len(ys))]
        while todo:
            a, b, c, d = todo.pop()
            _, us, vs, head = self._trimmed(xs[a:b], ys[c:d])
            tail = b - a - head - len(us)
            out.extend((a + i, c + i) for i in range(head))
            out.extend((b - 1 - i, d - 1 - i) for i in range(tail))
            a, b, c, d = a + head, b - tail, c + head, d - tail
            if not us or not vs:
                continue
            if len(us) == 1:
                best = max(range(len(vs)), key=lambda j: self.matches[us[0], vs[j]])
                if self.matches[us[0], vs[best]]:
                    out.append((a, c + best))
                continue
            half = len(us) // 2
            up, down = np.array(self._last_row(us[:half], vs)), np.array(self._last_row(us[half:][::-1], vs[::-1]))
            cut = int(np.argmax(up + down[::-1]))
            todo.extend([(a, a + half, c, c + cut), (a + half, b, c + cut, d)])
        return out


def _read(root: Node, shapes: Shapes) -> None:
    """Sets what a node has from those below it, from the bottom up."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(n.elements)
    for n in reversed(order):
        n.shape = shapes.of(n.key, tuple(k.shape for k in n.elements))
        n.inside = any(k.inside or k.tag in BLOCK for k in n.elements)
        below = [k for k in n.elements if k.counts]
        n.size = sum(len(k) for k in n.kids if isinstance(k, str) and not k.isspace()) + sum(k.size for k in below)
        n.linked = n.size if n.tag == "a" else sum(k.linked for k in below)
        for k in n.elements:
            k.unit = not k.inside and (k.tag in BLOCK or n.inside)


def parse(html: str, shapes: Shapes | None = None) -> Node:
    """The tree of a page, however deep. Void, implied and missing end tags are dealt with; nothing raises."""
    root = Node("#root", "#root")
    stack, at = [root], 0
    while m := _token.search(html, at):
        if m.start() > at:
            stack[-1].kids.append(unescape(html[at : m.start()]))
        at = m.end()
        end, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in CLOSES_P or tag in SIBLINGS:
            shut = SIBLINGS.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            stop = {"ul", "ol", "table", "dl", "article", "section", "div", "main", "body", "td", "blockquote"} - shut
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in shut:
                    del stack[i:]
                    break
                if stack[i].tag in stop:
                    break
        node = _element(tag, attrs)
        stack[-1].add(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(html, at)
            at = close.end() if close else len(html)
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
    if at < len(html):
        stack[-1].kids.append(unescape(html[at:]))
    _read(root, shapes or Shapes())
    return root


def simple_tree_match(a: Node, b: Node, shapes: Shapes) -> list[tuple[Node, Node]]:
    """Pairs of a largest order-preserving mapping of a's tree to b's (simple tree matching); roots must agree."""
    if not shapes.match(a.shape, b.shape):
        return []
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        if x.elements and y.elements:
            xs, ys = shapes.kids[x.shape], shapes.kids[y.shape]
            _, us, vs, _ = shapes._trimmed(xs, ys)
            for p in set(us):
                for q in set(vs):
                    shapes.match(p, q)
            todo.extend((x.elements[i], y.elements[j]) for i, j in shapes.align(xs, ys))
    return pairs


def text_of(node: Node, skip: frozenset[tuple[str, str]] = frozenset()) -> str:
    """The text of a node's blocks without chrome, white space as one space, blocks joined by one space in page order.

    skip: (key, text) of units to leave out. Of a <header> inside the node, its headings are content, and nothing else.
    """
    parts: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            parts.append(n)
            continue
        if n.tag in BLOCK:
            parts.append(" ")
            todo.append(" ")
        for k in reversed(n.kids):
            if isinstance(k, str):
                todo.append(k)
            elif k.tag == "header" and k.tag == k.key:
                todo.extend(reversed(headings(k)))
            elif k.counts and k.tag not in RAW and not (skip and k.unit and (k.key, text_of(k)) in skip):
                todo.append(k)
    return " ".join("".join(parts).split())


def headings(node: Node) -> list[Node]:
    """The headings below a node, in page order."""
    found, todo = [], [node]
    while todo:
        n = todo.pop()
        if n.tag in HEADINGS:
            found.append(n)
        else:
            todo.extend(k for k in reversed(n.elements) if not k.chrome)
    return found
