"""Exact links of Jaccard similarity between sets of hashes: prefix filter, clusters, and a search in each cluster.

1. Rows of equal sets are a class; its smallest id stands for it.
2. Signature. In order of hash, two sets that reach the threshold t share the first elements of their common part early:
   of a set of n, the first n - ceil(t n) + 1 + floor(n / 10) are counted over all rows, and linked sets share at least
   s = 1 + floor(ceil(t n) / 10) of them. Put in order of count, the m that occur more than once have a common one
   within the first m - s + 1. What is common to many rows comes last.
3. Those entries are tied to the smallest class of their list; links are inside the components of that graph.
4. Each component's sets meet once, cut by size and, beyond MOST elements, into blocks that meet in pairs. Overlaps are
   counted by inverted lists and the exact similarity decides.

No row is made for a pair that does not link. Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import forget, shared_dir

#: Elements of a group beyond which it is cut into blocks; links of a frame that a task gives out; bits of the map of classes.
MOST, FRAME, MAP_BITS = 3_000_000, 100_000, 1 << 26


def _kept(df: DataFrame, root: str, name: str) -> DataFrame:
    """df, written once to the shared folder; its shuffle files go at once."""
    spark, path = df.sparkSession, f"{root}/{name}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def _components(edges: DataFrame, root: str) -> DataFrame:
    """(node, component) by large-star and small-star steps, until only stars remain."""
    spark = edges.sparkSession
    now = _kept(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), root, "star")
    state = None
    while True:
        facts = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not facts["n"] or state == (facts["n"], facts["h"]):
            break
        state = (facts["n"], facts["h"])
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = _kept(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), root, "star")
        large = _kept(both.join(first, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), root, "star")
        least = _kept(large.groupBy("a").agg(F.min("b").alias("m")), root, "star")
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        before, now = now, _kept(small.select("e.a", "e.b").filter("a <> b").distinct(), root, "star")
        forget(spark, *(x.kept_at for x in (before, first, large, least)))
    tops = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)


def _sifted(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of df that may have a node of `nodes`: all that have, few others. A map of fixed size is broadcast."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    maps = nodes.select(place(F.col("node")).alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_map"))
    bit = F.bitmap_bit_position(place(F.col("node")))
    byte = F.conv(F.hex(F.substring("_map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = df.join(F.broadcast(maps), F.bitmap_bucket_number(place(F.col("node"))) == F.col("_part"))
    return met.filter(byte.bitwiseAND(F.pow(F.lit(2), F.pmod(bit, F.lit(8))).cast("int")) != 0).drop("_part", "_map")


def search(rows: list[tuple], least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, ids, similarities) of the links among rows (id, side, set); sides (1, 1), (0, 1) and (2, 3) meet."""
    t = Fraction(str(least))
    rows = sorted(rows, key=lambda r: (len(r[2]), r[0]))
    ids, side = np.array([r[0] for r in rows], object), np.array([r[1] for r in rows])
    sizes, sets = np.array([len(r[2]) for r in rows]), [np.asarray(r[2], np.int64) for r in rows]
    everything = np.concatenate(sets)
    order = np.argsort(everything, kind="stable")
    elements, first, length = np.unique(everything[order], return_index=True, return_counts=True)
    lists = np.repeat(np.arange(len(rows)), sizes)[order]  # ascending inside a list
    for x in range(1, len(rows)):
        n = int(sizes[x])
        low = int(np.searchsorted(sizes, -(-n * t.numerator // t.denominator)))
        if low >= x:
            continue
        at = np.searchsorted(elements, sets[x])
        at = at[length[at] > 1]
        span = length[at]
        found = lists[np.repeat(first[at] - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(int(span.sum()))] if len(at) else at
        same = np.bincount(found[(found >= low) & (found < x)] - low, minlength=x - low)
        similar = same / (n + sizes[low:x] - same)
        pair = side[low:x] + side[x]
        hit = np.flatnonzero((similar >= least) & ((pair == 1) | (pair == 5) | ((pair == 2) & (side[x] == 1))))
        if len(hit):
            yield np.full(len(hit), ids[x], object), ids[low + hit], similar[hit]


def exact_links(sets: DataFrame, least: float) -> DataFrame:
    """(id, leader, similarity) of rows (id, s), s without repeats: all pairs of classes of equal sets whose Jaccard
    similarity reaches `least`, by their smallest ids and the smaller as leader, and each other row of a class with the
    class's smallest id (1.0). Rows without an id, and empty sets, link with nothing; rows that repeat an id are one.
    """
    spark = sets.sparkSession
    t = Fraction(str(least))
    if not 0 < t <= 1:
        raise ValueError("thresholds above 0, to 1, are supported")
    root = f"{shared_dir(spark)}/granary"
    kind = dict(sets.dtypes)["id"]
    sets = sets.filter(F.col("id").isNotNull() & (F.size("s") > 0)).select("id", F.sort_array("s").alias("s"))
    sets = _kept(sets.select("id", F.xxhash64("s").alias("node"), "s"), root, "sets")
    classes = _kept(sets.groupBy("node").agg(F.min("id").alias("rep")), root, "classes")
    copies = sets.select("id", "node").join(classes, "node").filter("id <> rep").select("id", F.col("rep").alias("leader"), F.lit(1.0).alias("similarity"))

    part = F.expr(f"cast((size(s) * {t.numerator}L + {t.denominator - 1}) div {t.denominator} as int)")  # ceil(t n)
    sign = sets.select("id", "node", (F.expr("1") + F.floor(part / 10)).cast("int").alias("share"), F.explode(F.slice("s", F.lit(1), F.size("s") - part + 1 + F.floor(F.size("s") / 10).cast("int"))).alias("h"))
    counts = _kept(sign.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), root, "counts")
    shared = sign.join(counts, "h").groupBy("id", "node").agg(F.min("share").alias("share"), F.array_sort(F.collect_set(F.struct("c", "h"))).alias("l"))
    shared = shared.withColumn("take", F.size("l") - F.col("share") + 1).filter("take > 0")
    one = classes.select("node", F.col("rep").alias("id"))
    lists = _kept(shared.join(one, ["node", "id"], "left_semi").select("node", F.transform(F.slice("l", F.lit(1), F.col("take")), lambda x: x["h"]).alias("l")), root, "lists")
    entries = lists.select("node", F.explode("l").alias("h"))
    heads = _kept(entries.groupBy("h").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("h", "head"), root, "heads")
    clusters = _kept(_components(entries.join(heads, "h").select(F.col("node").alias("a"), F.col("head").alias("b")), root), root, "clusters")
    forget(spark, *(x.kept_at for x in (counts, lists, heads)))

    # Sizes of linked sets differ by 1 / t at most, so that these numbers are equal or one apart.
    step = 1.04 / float(t)
    members = _sifted(sets, clusters).join(clusters.join(classes, "node").withColumnRenamed("rep", "id"), ["node", "id"]).dropDuplicates(["node"])
    members = _kept(members.select("id", F.col("component").alias("cluster"), "node", F.size("s").alias("n"), "s", F.floor(F.log(step, F.size("s"))).alias("g")), root, "members")
    loads = members.select("cluster", F.explode(F.array("g", F.col("g") + 1)).alias("at"), "g", "n").groupBy("cluster", "at").agg(F.sum("n").alias("load"), F.count_if(F.col("g") == F.col("at")).alias("own"), F.count(F.lit(1)).alias("all"))
    loads = _kept(loads.filter("own > 0 and all > 1").select("cluster", "at", F.ceil(F.col("load") / MOST).alias("blocks")), root, "loads")
    placed = members.select("id", "cluster", "node", "s", F.explode(F.array(F.struct(F.col("g").alias("at"), F.lit(1).alias("side")), F.struct((F.col("g") + 1).alias("at"), F.lit(0).alias("side")))).alias("p"))
    placed = placed.select("id", "cluster", "node", "s", "p.*").join(loads, ["cluster", "at"])
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    others = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda j: F.struct(
        F.when(F.col("side") == 0, j).otherwise(F.least(j, block)).alias("i"),
        F.when(F.col("side") == 0, j).otherwise(F.greatest(j, block)).alias("j"),
        F.when(F.col("side") == 0, 0).when(j == block, 1).when(j > block, 2).otherwise(3).alias("side"),
    ))
    keys = ["cluster", "at", "i", "j"]
    placed = placed.withColumn("k", F.explode(others)).select("cluster", "at", F.col("k.i").alias("i"), F.col("k.j").alias("j"), "id", F.col("k.side").alias("side"), "s")

    def links(group: list[tuple]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def frame() -> pd.DataFrame:
            x, y, similarity = (np.concatenate(c) for c in zip(*held))
            return pd.DataFrame({"id": x, "leader": y, "similarity": similarity})

        for found in search(group, least) if len(group) > 1 else ():
            held.append(found)
            n += len(found[0])
            if n >= FRAME:
                yield frame()
                held, n = [], 0
        if held:
            yield frame()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group = None, []
        for p in parts:
            for k, row in zip(zip(*(p[c] for c in keys)), zip(p["id"], p["side"], p["s"])):
                if k != key:
                    yield from links(group)
                    key, group = k, []
                group.append(row)
        yield from links(group)

    met = placed.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, f"id {kind}, leader {kind}, similarity double").filter("id <> leader")
    met = met.select(F.greatest("id", "leader").alias("id"), F.least("id", "leader").alias("leader"), "similarity")
    return met.unionByName(copies).groupBy("id", "leader").agg(F.max("similarity").alias("similarity"))
