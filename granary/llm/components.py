"""Connected components of a graph that is never gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import kept_table


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node of edges (a, b).

    Alternates large-star and small-star steps, each of which hangs a node's neighbours on the smallest of them, until
    only stars remain; rounds grow with the logarithm of the graph. The minima of a step are written out before they
    are joined, so that both sides of the join are exchanged for it and a node of very many edges can be split.
    """
    now = kept_table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    while True:
        facts = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not facts["n"] or state == (facts["n"], facts["h"]):
            break
        state = (facts["n"], facts["h"])
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = kept_table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = kept_table(large.filter("a <> b").distinct(), name)
        least = kept_table(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = kept_table(small.select("e.a", "e.b").filter("a <> b").distinct(), name)
    tops = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
