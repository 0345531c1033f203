"""HTML extraction by wrapper induction.

Pages of one host and layout are aligned, each with one of them, by simple tree matching. A lowest block that most pages
have and that is the same in all of them is template; what varies is a slot. The wrapper is the path to the element that
holds the slots: the <article> or <main> that has most of the varying text, if it has SHARE of it, else the deepest
element that has. From there come all blocks but template, menus, headers, footers, sidebars, notices, adverts, forms
and comments, which are known by tag, role or name. A page that cannot be aligned (the only one of its layout, or with
copies of it only) has its marked article, or else its densest element.

Near copies of the reference agree in what is content elsewhere, so they tell nothing of the template; and where most of
the content of a layout would be template, its pages are near copies of one article, which keep it. A blank or odd page
stands for no other, as each layout has a reference of its own.

Pages are dealt by host and, within a host of many pages, by salt, to groups of some dozens; each group induces its
wrapper by itself. Groups come as sorted runs in a stream, so a task holds one group at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import id_text, kept_table, whole
from granary.llm.html_tree import Node, Shapes, parse, simple_tree_match, text_of

#: Pages of a host that are aligned together, about; the share of varying text that the slots' element must hold; aligned
#: pages that must agree, at least, before a block counts as template.
GROUP, SHARE, AGREE = 32, 0.8, 2
#: Share of paths that pages of one layout have in common; share of slots in which a near copy agrees with the reference;
#: tags whose presence tells nothing of a layout.
FIT, COPY, INLINE = 0.5, 0.5, ("b", "i", "em", "strong", "span", "a")

Path = tuple[str, ...]


def _weighted(root: Node, weight: dict[int, float]) -> dict[int, float]:
    """Characters of content below each element, those of units by how much they vary."""
    order, todo, total = [], [root], {}
    while todo:
        n = todo.pop()
        order.append(n)
        if not n.unit:
            todo.extend(k for k in n.elements if k.counts)
    for n in reversed(order):
        if n.unit:
            total[id(n)] = n.size * weight.get(id(n), 1.0)
        else:
            below = [k for k in n.elements if k.counts]
            total[id(n)] = n.size - sum(k.size for k in below) + sum(total[id(k)] for k in below)
    return total


def _marked(root: Node) -> list[tuple[Path, Node]]:
    """Outermost <article> and <main> elements that are not chrome, with their paths; an article inside main wins."""
    found: dict[str, list] = {"article": [], "main": []}
    todo: list[tuple[Node, tuple]] = [(root, ())]
    while todo:
        n, path = todo.pop()
        for k in reversed(n.elements):
            if not k.chrome:
                below = (path, k.key)
                if k.tag in found:
                    found[k.tag].append((below, k))
                if k.tag != "article":
                    todo.append((k, below))
    return [(_flat(p), k) for p, k in found["article"] or found["main"]]


def _flat(path: tuple) -> Path:
    out = []
    while path:
        path, key = path
        out.append(key)
    return tuple(reversed(out))


def _densest(root: Node, total: dict[int, float]) -> tuple[Path, Node]:
    """The deepest element that holds SHARE of the (varying) text."""
    path, n = [], root
    while True:
        best = max((k for k in n.elements if k.counts and not k.unit), key=lambda k: total[id(k)], default=None)
        if best is None or not total[id(root)] or total[id(best)] < SHARE * total[id(root)]:
            return tuple(path), n
        path.append(best.key)
        n = best


def _at(root: Node, path: Path) -> Node | None:
    """The element of most text at a path."""
    level = [root]
    for key in path:
        level = [k for n in level for k in n.elements if k.key == key and not k.chrome]
    return max(level, key=lambda n: n.size, default=None)


def _shape(root: Node) -> frozenset[int]:
    """The paths (as hashes) of elements that are not inline; how often one is repeated does not count."""
    found, todo = set(), [(0, root)]
    while todo:
        path, n = todo.pop()
        for k in n.elements:
            if k.tag not in INLINE:
                found.add(at := hash((path, k.key)))
                todo.append((at, k))
    return frozenset(found)


def _layouts(trees: list[Node]) -> list[list[int]]:
    """Pages by layout. The first page left is the reference of a layout, and those that share FIT of their paths with it
    (Dice) belong to it; the rest are dealt again, until each page has a layout. Blank pages fit none.
    """
    shapes, out, pages = [_shape(t) for t in trees], [], list(range(len(trees)))
    while pages:
        ref = pages[0]
        fits = [i for i in pages if i == ref or 2 * len(shapes[i] & shapes[ref]) >= FIT * (len(shapes[i]) + len(shapes[ref])) > 0]
        out.append(fits)
        taken = set(fits)
        pages = [i for i in pages if i not in taken]
    return out


def _evidence(ref: Node, others: list[Node], shapes: Shapes) -> tuple[dict[int, float], frozenset[tuple[str, str]]]:
    """How much each unit of the reference varies (0 to 1), and the units that are template, from aligned pages."""
    aligned, units = [], {}
    for tree in others:
        same = {}
        for a, b in simple_tree_match(ref, tree, shapes):
            if a.unit and a.size:
                text = units.setdefault(id(a), (a, text_of(a)))[1]
                same[id(a)] = text == text_of(b)
        aligned.append(same)
    slots = {u for same in aligned for u, s in same.items() if not s}
    size = lambda some: sum(units[u][0].size for u in some)
    told = [same for same in aligned if size(u for u in same if u in slots and same[u]) <= COPY * size(u for u in same if u in slots)]
    seen = {u: [same[u] for same in told if u in same] for u in units}
    varies = {u: 1 - sum(s) / len(s) for u, s in seen.items() if s}
    template = frozenset((n.key, text) for u, (n, text) in units.items() if len(seen[u]) >= max(AGREE, len(told) / 2) and all(seen[u]))
    return varies, template


def extract_group(pages: list[str]) -> list[str]:
    """Main texts of pages of one host."""
    shapes = Shapes()
    trees = [parse(p, shapes) for p in pages]
    texts = [""] * len(pages)
    regions: dict[int, Node] = {}
    for own in _layouts(trees):
        ref = trees[own[0]]
        others = {pages[i]: trees[i] for i in own if pages[i] != pages[own[0]]}  # a copy tells nothing
        varies, template = _evidence(ref, list(others.values()), shapes)
        total = _weighted(ref, varies)
        path, _ = _densest(ref, total)
        marks = _marked(ref)
        if marks:
            at, best = max(marks, key=lambda m: total.get(id(m[1]), 0.0))
            if not varies or total.get(id(best), 0.0) >= SHARE * total[id(ref)]:
                path = at
        for i in own:
            region = _at(trees[i], path) if path else None
            if region is None:
                own_marks = [n for _, n in _marked(trees[i])]
                region = max(own_marks, key=lambda n: n.size) if own_marks else _densest(trees[i], _weighted(trees[i], {}))[1]
            texts[i] = text_of(region)
            regions[i] = region
        if template:
            without = {i: text_of(regions[i], template) for i in own}
            if sum(map(len, without.values())) >= COPY * sum(len(texts[i]) for i in own):
                for i, t in without.items():
                    texts[i] = t
    return texts


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text (empty if none), n_chars (its code points).

    Null html counts as empty. Pages of null or odd urls are a host of their own. Repeated rows are extracted each; a
    page's text may depend on the pages of its group, and the groups on ids and urls only. Pages may be long and deep;
    other columns are ignored, and an empty table gives an empty result.
    """
    rows = pages.select(id_text(id_col).alias("_id"), F.col(url_col).alias("_u"), whole(html_col).alias("_h"))
    host = F.lower(F.regexp_extract(F.coalesce("_u", F.lit("")), r"^[a-zA-Z][-+.\w]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = rows.withColumn("_host", host)
    salts = kept_table(rows.groupBy("_host").count().filter(F.col("count") > 2 * GROUP).select(F.col("_host").alias("_big"), F.ceil(F.col("count") / GROUP).alias("_n")), "html-hosts")
    # Big hosts only; Spark broadcasts them where the table's size allows it.
    rows = rows.join(salts, F.col("_host") == F.col("_big"), "left")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_id", "_u"), F.coalesce("_n", F.lit(1))))

    def extract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        key = None

        def done() -> pd.DataFrame:
            for at in range(0, len(held), 2 * GROUP):  # rows that repeat an id and url can make a run longer
                some = held[at : at + 2 * GROUP]
                out.extend((r[0], r[1], t) for r, t in zip(some, extract_group([r[2] for r in some])))

        for p in parts:
            out: list[tuple] = []
            for r in zip(p["_id"], p["_u"], p["_h"], p["_host"], p["_salt"]):
                if r[3:] != key:
                    done()
                    held, key = [], r[3:]
                held.append(r)
            if len(held) > 2 * GROUP:
                done()
                held = []
            yield pd.DataFrame(out, columns=["_id", "_u", "_x"])
        out = []
        done()
        yield pd.DataFrame(out, columns=["_id", "_u", "_x"])

    kind = pages.select(F.col(id_col).alias("_id")).schema["_id"].dataType
    runs = rows.select("_id", "_u", "_h", "_host", "_salt").repartition("_host", "_salt").sortWithinPartitions("_host", "_salt", "_id", "_u")
    found = runs.mapInPandas(extract, "_id string, _u string, _x string")
    return found.select(F.col("_id").cast(kind).alias("page_id"), F.col("_u").alias("url"), F.col("_x").alias("text"), F.char_length("_x").cast("bigint").alias("n_chars"))
