"""N-gram Jaccard self-join by T-occurrence search, exact over sets of word shingles.

1. Documents of equal sets are a class; its smallest id stands for it. Everything below is about those.
2. Signature. In any fixed order of shingles, two sets that reach the threshold t share the first shingles of their
   common part early. Of each set, in order of hash, the first n - ceil(t n) + 1 + floor(n / 10) shingles are counted
   over the corpus; linked sets share at least s of them (s from n and the least size of a partner). Put in order of
   count, the m shingles that occur more than once must have a common one within the first m - s + 1: these are the
   entries of the lists that matter. A set with m < s has no partner. Common passages are counted often and come last.
3. The lists' entries are tied to the list's smallest id, and the components of that graph are the clusters within
   which links can be. Nothing is made for pairs.
4. T-occurrence. Each cluster's whole sets meet, by size, as linked sets differ little in size. Its shingles have
   inverted lists; for a query set the short lists are merged by a heap, what is on at least T - L of them is a
   candidate, and the L longest lists are probed by binary search (DivideSkip). The overlap is then exact, and the
   pair's own threshold decides. Pairs inside one component are not searched again, and groups that are too large for a
   task are dealt to many (search_clusters).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import merge
from itertools import groupby
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import few, free, frugal, id_text, kept_table, map_runs, packed, sift, unpacked, whole
from granary.llm.components import connected_components
from granary.llm.shingles import WORDS, shingle_sets

#: Load (shingles, and DOCUMENT for each document) of a group that one task searches; that of blocks that meet in pairs.
MOST_LOAD, DOCUMENT, PAIR_LOAD = 400_000, 1000, 1_600_000
#: DivideSkip: weight of probing against merging, and the length from which a list is probed if the threshold allows it.
PROBE, LONG = 1.0, 32
#: Documents from which a component counts as large, and how many of it are tried first.
LARGE, FIRST = 16, 8
#: Sizes n and n' of linked sets have floor(log(n, 1.3)) equal or one apart, for thresholds of 0.77 and more.
SIZE_STEP = 1.3


def _ceil(n, num: int, den: int):
    return -((-n * num) // den)


def signature_length(n, num: int, den: int):
    return n - _ceil(n, num, den) + 1 + n // 10


def shared_least(n, num: int, den: int):
    """How many shingles of their signatures two linked sets share at least, one of them of n shingles."""
    return 1 + _ceil(n, num, den) // 10


def linked(o, nx, ny, num: int, den: int):
    return den * o >= num * (nx + ny - o)


def occurrences(index: dict[int, list[int]], tokens: list[int], least: int) -> Iterator[tuple[int, int]]:
    """(entry, number of lists it is on) for entries that are on `least` or more of the tokens' lists (DivideSkip).

    The short lists are merged by a heap, which brings equal entries together; what is on enough of them is looked up
    in the long lists by binary search. Lists are in ascending order. At most least - 1 lists count as long, so that
    every answer is on a short one.
    """
    lists = sorted(filter(None, map(index.get, tokens)), key=len)
    if len(lists) < least:
        return
    apart = min(max(int(least / (PROBE * log2(len(lists[-1]) + 1) + 1)), sum(len(x) > LONG for x in lists)), least - 1)
    short, long = lists[: len(lists) - apart], lists[len(lists) - apart :]
    for y, run in groupby(merge(*short)):
        n = sum(1 for _ in run)
        if n < least - apart:
            continue
        for left, some in zip(range(apart, 0, -1), long):
            if n + left < least:
                break
            at = bisect_left(some, y)
            n += at < len(some) and some[at] == y
        if n >= least:
            yield y, n


class Part:
    """A component found so far: its documents, and those of them that are tried first for a new document.

    A large one has inverted lists of its own, which are searched only for documents that none of `first` links to.
    """

    __slots__ = ("members", "first", "index")

    def __init__(self, x: int):
        self.members, self.first, self.index = [x], [x], None


class Search:
    """Components of the links among the documents of one group, which come one by one.

    Pairs inside a component are of no use any more: a document that one of a few members of a large component links
    to is not searched in its lists. So a near copy of a text that has many costs a few comparisons.
    """

    def __init__(self, tokens: list[list[int]], num: int, den: int):
        self.tokens, self.num, self.den = tokens, num, den
        self.least_size = min(map(len, tokens), default=0)
        self.parent = list(range(len(tokens)))
        self.parts: dict[int, Part] = {}
        self.index: dict[int, list[int]] = {}  # members of parts that are not large
        self.large: set[int] = set()

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def _move(self, x: int, old: dict[int, list[int]] | None, new: dict[int, list[int]]) -> None:
        for t in self.tokens[x]:
            if old is not None:
                old[t].remove(x)
            insort(new.setdefault(t, []), x)

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a == b:
            return
        if len(self.parts[a].members) < len(self.parts[b].members):
            a, b = b, a
        part, other = self.parts[a], self.parts.pop(b)
        self.parent[b] = a
        self.large.discard(b)
        if part.index is not None:
            for x in other.members:
                self._move(x, self.index if other.index is None else None, part.index)
        elif len(part.members) + len(other.members) >= LARGE:
            part.index = {}
            self.large.add(a)
            for x in part.members + other.members:
                self._move(x, self.index, part.index)
        part.members.extend(other.members)
        part.first = (part.first + other.first)[:FIRST]

    def _partners(self, lists: dict[int, list[int]], x: int) -> Iterator[int]:
        n, num, den = len(self.tokens[x]), self.num, self.den
        low = max(_ceil(n, num, den), self.least_size)
        for y, o in occurrences(lists, self.tokens[x], _ceil(num * (n + low), 1, num + den)):
            if linked(o, n, len(self.tokens[y]), num, den):
                yield y

    def _tried_first(self, part: Part, own: set[int]) -> int | None:
        for i, y in enumerate(part.first):
            if linked(len(own.intersection(self.tokens[y])), len(own), len(self.tokens[y]), self.num, self.den):
                part.first.insert(i // 2, part.first.pop(i))
                return y
        return None

    def add(self, x: int) -> None:
        own = set(self.tokens[x])
        met = []
        for part in [self.parts[c] for c in self.large]:
            y = self._tried_first(part, own)
            if y is not None:
                part.first[FIRST - 1 :] = [x]
            else:
                y = next(self._partners(part.index, x), None)
            if y is not None:
                met.append(y)
        met.extend(self._partners(self.index, x))
        self.parts[x] = Part(x)
        self._move(x, None, self.index)
        for y in met:
            self.union(x, y)


def search_group(rows: list[tuple], num: int, den: int) -> list[tuple]:
    """(id, smallest id reached in this group, apart) of rows (id, head, set), by T-occurrence search.

    apart: outside the component of the first row, which is one with `head` set if there is any.
    """
    rows = sorted(rows, key=lambda r: (not r[1], len(r[2]), r[0]))
    search = Search([np.frombuffer(r[2], np.int64).tolist() for r in rows], num, den)
    for x in range(len(rows)):
        search.add(x)
    roots = [search.find(i) for i in range(len(rows))]
    lowest: dict[int, int] = {}
    for r, top in zip(rows, roots):
        lowest[top] = min(lowest.get(top, r[0]), r[0])
    return [(int(r[0]), int(lowest[top]), top != roots[0]) for r, top in zip(rows, roots)]


def _cut(rows: DataFrame, most: int) -> DataFrame:
    """rows of (cluster, at, g, doc, n, ...) with the number of blocks and the own one, of groups of two or more.

    Two documents meet in the group of the larger one's size, so a group without a document of its size has no use.
    """
    loads = rows.groupBy("cluster", "at").agg(F.sum(F.col("n") + DOCUMENT).alias("load"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("g") == F.col("at")).alias("own"))
    loads = loads.filter("rows > 1 and own > 0").select("cluster", "at", F.ceil(F.col("load") / most).alias("blocks"))
    return rows.join(kept_table(loads, "join-loads"), ["cluster", "at"]).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")))


def search_clusters(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of links' components, from rows (cluster, at, g, doc, n, copies, shingles, blocks, block) of which equal
    (cluster, at) meet, with the number of blocks that _cut deals each group to, and the own one.

    A group that a task can hold is searched at once. A larger one is dealt to blocks, which all get one pivot of the
    group, the text of most copies. What a block brings into the pivot's component needs no search against what another
    does. What no block does, if a task can hold it, meets every block once more; else (documents that share passages
    but are not alike) larger blocks meet in pairs.
    """

    def work(group: list[tuple]) -> list[tuple]:
        return search_group(group, num, den) if len(group) > 1 else []

    def search(table: DataFrame, keys: list[str]) -> DataFrame:
        found = map_runs(table.select(*keys, "doc", F.lit(False).alias("head"), "shingles"), keys, [], work, "doc bigint, root bigint, apart boolean")
        return kept_table(found.filter("doc <> root").select(F.col("doc").alias("a"), F.col("root").alias("b")), "join-found")

    def each(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))

    edges = search(rows.filter("blocks = 1"), ["cluster", "at"])
    large = kept_table(rows.filter("blocks > 1"), "join-large")
    if large.isEmpty():
        return edges
    key = ["cluster", "at", "block"]
    pivots = large.groupBy("cluster", "at").agg(F.max(F.struct("copies", F.xxhash64("doc").alias("o"), "doc", "shingles", "blocks")).alias("p"))
    pivots = pivots.select("cluster", "at", each(F.col("p.blocks")).alias("block"), "p.doc", F.lit(True).alias("head"), "p.shingles")
    dealt = large.select(*key, "doc", F.lit(False).alias("head"), "shingles").unionByName(pivots)
    split = kept_table(map_runs(dealt, key, [], work, "doc bigint, root bigint, apart boolean"), "join-split")
    edges = edges.unionByName(split.filter("doc <> root").select(F.col("doc").alias("a"), F.col("root").alias("b")))

    # A document is in two groups of its cluster at most; where it is apart in one, it counts as apart in both.
    apart = large.join(split.filter("apart").select("doc").distinct(), "doc", "left_semi")
    loads = kept_table(apart.groupBy("cluster", "at").agg(F.sum(F.col("n") + DOCUMENT).alias("left")), "join-apart")
    few_left, many_left = (loads.filter(c).select("cluster", "at") for c in (F.col("left") <= MOST_LOAD, F.col("left") > MOST_LOAD))
    guests = apart.join(few_left, ["cluster", "at"], "left_semi").withColumn("home", F.col("block")).withColumn("block", each(F.col("blocks"))).filter("block <> home")
    met = large.join(few_left, ["cluster", "at"], "left_semi").select(*key, "doc", "shingles").unionByName(guests.select(*key, "doc", "shingles"))
    edges = edges.unionByName(search(met, key))
    paired = _cut(large.drop("blocks", "block").join(many_left, ["cluster", "at"], "left_semi"), PAIR_LOAD).withColumn("other", each(F.col("blocks")))
    paired = paired.select("*", F.least("other", "block").alias("i"), F.greatest("other", "block").alias("j"))
    return edges.unionByName(search(paired, ["cluster", "at", "i", "j"]))


def ngram_join(docs: DataFrame, num: int = 80, den: int = 100, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Two documents link when den * |intersection| >= num * |union| of their shingle sets. component_id is the smallest
    id reachable by links, the document's own included. A null text counts as empty; a text without words has no
    shingles and links with nothing. A row without an id has no component. Of rows that repeat an id each has the
    component of its own text; an id that is the smallest of two texts ties these. Other columns are ignored, and an
    empty table gives an empty result. A very long text is one set, held by a task as a whole. Shingles are compared by
    64-bit hashes.
    """
    if num * 100 < 78 * den or num > den:
        raise ValueError("thresholds from 0.78 to 1 are supported")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), whole(text_col).alias("text"))
    meta = kept_table(_described(rows, words), "join-meta")
    able = meta.filter("n > 0 and doc is not null")
    classes = kept_table(able.groupBy("sig").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n")), "join-classes")
    clusters, scratch = _clusters(rows.filter("doc is not null"), classes, num, den, words)
    spots = kept_table(_spots(clusters, classes), "join-spots")
    members = kept_table(_members(rows, spots, words), "join-members")
    dealt = members.select("*", F.explode("spots").alias("s")).select("cluster", "g", "doc", "n", "copies", "shingles", "s.*")
    reached = connected_components(search_clusters(dealt, num, den), "join-components").select(F.col("node").alias("rep"), "component")
    verdict = kept_table(classes.join(reached.hint("merge"), "rep", "left").select("sig", F.coalesce("component", "rep").alias("component")), "join-verdict")
    out = able.join(verdict.hint("merge"), "sig").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    alone = meta.filter("n = 0 or doc is null").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("doc").alias("component_id"))
    free(members, spots, clusters, classes, *scratch)
    return out.unionByName(alone)


def _described(rows: DataFrame, words: int) -> DataFrame:
    """(doc, n, sig): size and 128-bit digest of each row's set."""

    def describe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in few(parts):
            sets = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest()) for s in shingle_sets(p["text"], words)]
            yield pd.DataFrame({"doc": p["doc"], "n": [n for n, _ in sets], "sig": [d for _, d in sets]})

    found = rows.select(id_text("doc").alias("doc"), "text").mapInPandas(frugal(describe), "doc string, n bigint, sig binary")
    return found.select(F.col("doc").cast("bigint").alias("doc"), "n", "sig")


def _clusters(rows: DataFrame, classes: DataFrame, num: int, den: int, words: int) -> tuple[DataFrame, list[DataFrame]]:
    """(node, component) of documents that may have links, within components, and the tables that it took."""

    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in few(parts):
            sets = [(len(s), s[: signature_length(len(s), num, den)].copy()) for s in shingle_sets(p["text"], words)]
            yield pd.DataFrame({"doc": p["doc"], "n": [n for n, _ in sets], "h": [h for _, h in sets]})

    signed = rows.mapInPandas(frugal(sign), "doc bigint, n bigint, h array<bigint>").select("doc", "n", F.explode("h").alias("h"))
    counts = kept_table(signed.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "join-counts")
    least = F.expr(f"1 + ((n * {num}) div {den} + if((n * {num}) % {den} > 0, 1, 0)) div 10")  # shared_least
    shared = signed.join(counts, "h").groupBy("doc").agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("c", "h"))).alias("l"))
    shared = shared.withColumn("take", F.size("l") - least + 1).filter("take > 0")
    reps = classes.select(F.col("rep").alias("doc")).distinct()
    lists = kept_table(shared.select("doc", F.transform(F.slice("l", F.lit(1), F.col("take").cast("int")), lambda x: x["h"]).alias("l")).join(reps.hint("merge"), "doc", "left_semi"), "join-lists")
    free(counts)
    entries = lists.select("doc", F.explode("l").alias("h"))
    heads = kept_table(entries.groupBy("h").agg(F.min("doc").alias("head"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("h", "head"), "join-heads")
    ties = entries.join(heads.hint("merge"), "h").select(F.col("doc").alias("a"), F.col("head").alias("b"))
    return kept_table(connected_components(ties, "join-clusters"), "join-clusters"), [lists, heads]


def _spots(clusters: DataFrame, classes: DataFrame) -> DataFrame:
    """sig, doc, cluster, g (its size's step), n, copies of the classes in clusters, and the groups in which they are searched:
    spots (at, blocks, block). Groups are dealt by these light rows, so that whole sets need no join of their own for it.
    """
    of = clusters.select(F.col("node").alias("doc"), F.col("component").alias("cluster")).join(classes.withColumnRenamed("rep", "doc").hint("merge"), "doc")
    of = of.withColumn("g", F.floor(F.log(SIZE_STEP, F.col("n"))))
    placed = _cut(of.withColumn("at", F.explode(F.array("g", F.col("g") + 1))), MOST_LOAD)
    return placed.groupBy("sig", "doc", "cluster", "g", "n", "copies").agg(F.collect_list(F.struct("at", "blocks", "block")).alias("spots"))


def _members(rows: DataFrame, spots: DataFrame, words: int) -> DataFrame:
    """The rows of _spots with the whole set of each, once: bytes, `shingles`."""

    def sets_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in few(parts):
            out = [s.tobytes() for s in shingle_sets(p["text"], words)]
            yield pd.DataFrame({"doc": p["doc"], "sig": [hashlib.blake2b(s, digest_size=16).digest() for s in out], "shingles": out})

    sets = sift(rows, "doc", spots.select("doc")).mapInPandas(frugal(sets_of), "doc bigint, sig binary, shingles binary")
    return sets.join(spots.hint("merge"), ["sig", "doc"]).dropDuplicates(["sig", "doc"])


def one_of_each_component(docs: DataFrame, num: int = 80, den: int = 100, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they were, without those whose component has a smaller id.

    Rows without an id, and texts without words, stay; rows that repeat an id stay or go together. An empty table gives
    an empty one. Columns may have any names and types.
    """
    found = ngram_join(docs, num, den, words, id_col, text_col)
    gone = kept_table(found.filter("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct(), "join-gone")
    return unpacked(packed(docs, id=id_col).join(gone, F.col("id").cast("bigint") == F.col("gone"), "left_anti"), docs)
