"""Mixing sources to target weights by pivotal dependent rounding.

Targets. Source s gets min(cap_s, level * weight_s): weights share the wanted total, a source stops at its cap, and
what is above goes to the others by weight. The level that meets the total is found in closed form from running sums
over the sources in order of cap / weight.

Rounding. Each document of a source is to be taken r = target / size times: floor(r) copies, and one more with
probability p = r - floor(r). The p are rounded in pairs: words move between two documents, in either direction with
the probability that keeps both expectations, until one p is 0 or 1; the source's sum of words does not change.
Pairing runs as a fold over chunks of at most some dozens of documents; what is left of a chunk (one document) enters
a chunk of the next level, a reduction tree of log_64(n) levels. A hot source is just many chunks. The last document
of a source is rounded to the nearer integer, so a source misses its target by at most half a document.

All of it is DataFrame expressions. Directions come from a hash of seed, level and ids, so reruns agree.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import WORD, kept_table, packed, unpacked

CHUNK = 64


def source_targets(sizes: DataFrame, weights: list[float], total_share: float, max_repeat: float) -> DataFrame:
    """source, source_size, target from rows (source, size). The windows run over one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select(
        "source",
        "source_size",
        "w",
        "cap",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("w_left"),
        (F.sum("source_size").over(everything) * F.lit(float(total_share))).alias("goal"),
    ).withColumn("level", (F.col("goal") - F.col("cap_before")) / F.col("w_left"))
    # The level rises while sources ahead are full before it is reached, and falls after: its maximum is where all fits.
    level = F.max("level").over(everything)
    return per.withColumn("final", level).select("source", "source_size", F.least("cap", F.col("final") * F.col("w")).alias("target"))


def _uniform(*cols: Column) -> Column:
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def _fold(units: Column, seed: int, level: int) -> Column:
    """struct(c: the document still open, out: those decided) from an array of (id, size, mult, base, p)."""
    fields = ("id", "size", "mult", "base")
    first = F.get(units, F.lit(0))
    decided = lambda x, up: F.struct(*[x[f].alias(f) for f in fields], (x["base"] + up).cast("int").alias("copies"))
    again = lambda x, p: F.struct(*[x[f].alias(f) for f in fields], p.alias("p"))

    def step(acc: Column, y: Column) -> Column:
        x = acc["c"]
        wx, wy = (v["size"].cast("double") * v["mult"] for v in (x, y))
        room = F.struct(
            F.least(wx * (1 - x["p"]), wy * y["p"]).alias("a"),  # words that can move from y to x
            F.least(wx * x["p"], wy * (1 - y["p"])).alias("b"),  # and from x to y
            _uniform(F.lit(seed), F.lit(level), x["id"], x["size"], y["id"], y["size"]).alias("u"),
        )

        def moved(s: Column) -> Column:
            up = s["u"] * (s["a"] + s["b"]) < s["b"]
            px = F.when(up, F.when(wx * (1 - x["p"]) <= wy * y["p"], 1.0).otherwise(x["p"] + s["a"] / wx)).otherwise(F.when(wx * x["p"] <= wy * (1 - y["p"]), 0.0).otherwise(x["p"] - s["b"] / wx))
            py = F.when(up, F.when(wy * y["p"] <= wx * (1 - x["p"]), 0.0).otherwise(y["p"] - s["a"] / wy)).otherwise(F.when(wy * (1 - y["p"]) <= wx * x["p"], 1.0).otherwise(y["p"] + s["b"] / wy))
            return F.struct(px.alias("px"), py.alias("py"))

        def settled(s: Column) -> Column:
            open_x = (s["px"] > 0) & (s["px"] < 1)
            return F.struct(
                F.when(open_x, again(x, s["px"])).otherwise(again(y, s["py"])).alias("c"),
                F.concat(acc["out"], F.array(F.when(open_x, decided(y, s["py"])).otherwise(decided(x, s["px"])))).alias("out"),
            )

        return F.get(F.transform(F.transform(F.array(room), moved), settled), F.lit(0))

    kind = "array<struct<id:bigint,size:bigint,mult:bigint,base:int,copies:int>>"
    start = F.struct(first.alias("c"), F.array().cast(kind).alias("out"))
    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), start, step)


def _words(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint")


def _units(docs: DataFrame, weights: list[float], total_share: float, max_repeat: float, seed: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(source, id, size, mult, copies) of each unit, and (_s, source_size, target) of each source."""
    sized = docs.select(F.col(source_col).alias("source"), F.col(id_col).cast("bigint").alias("id"), _words(text_col).alias("size"))
    units = kept_table(sized.groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("mult")), "mix-units")
    targets = kept_table(source_targets(units.select("source", (F.col("size") * F.col("mult")).alias("size")), list(weights), total_share, max_repeat), "mix-targets")
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")  # broadcast by Spark itself where its size allows
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    base = F.floor(ratio).cast("int")
    planned = units.join(t, F.col("source").eqNullSafe(F.col("_s"))).select("source", "id", "size", "mult", base.alias("base"), (ratio - base).alias("p"))
    is_open = (F.col("size") > 0) & (F.col("p") > 0)
    done = planned.filter(~is_open).select("source", "id", "size", "mult", F.when(F.col("size") > 0, F.col("base")).otherwise(F.lit(0)).alias("copies"))

    chunks = max(1, ceil(units.count() / CHUNK))
    work = planned.filter(is_open).withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "id", "size"), F.lit(chunks)))
    level, parts = 0, [done]
    while True:
        entry = F.struct(F.xxhash64("id", "size").alias("o"), "id", "size", "mult", "base", "p")
        folded = work.groupBy("source", "chunk").agg(F.array_sort(F.collect_list(entry)).alias("units"))
        folded = folded.select("source", "chunk", F.transform("units", lambda x: F.struct(*[x[f].alias(f) for f in ("id", "size", "mult", "base", "p")])).alias("units"))
        tree = kept_table(folded.select("source", "chunk", _fold(F.col("units"), seed, level).alias("f")).select("source", "chunk", "f.c", "f.out"), f"mix-level{level}")
        parts.append(tree.select("source", F.explode("out").alias("d")).select("source", "d.id", "d.size", "d.mult", "d.copies"))
        if chunks == 1:
            break
        level, chunks = level + 1, ceil(chunks / CHUNK)
        work = tree.select("source", F.expr(f"chunk div {CHUNK}").alias("chunk"), "c.id", "c.size", "c.mult", "c.base", "c.p")
    last = F.col("base") + F.when(F.col("p") >= 0.5, 1).otherwise(0)
    parts.append(tree.select("source", "c.*").select("source", "id", "size", "mult", last.cast("int").alias("copies")))
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    return rows, t


def mix_sources(
    docs: DataFrame,
    weights: list[float] = (3, 1, 2),
    total_share: float = 1.5,
    max_repeat: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken (words, repeats counted), copies.

    size: words of the text, 0 for null. Sources by code point, null last, have the weights in turn. A document of no
    words, and a source of none, is taken 0 times. A null source is a source like any other. Rows that repeat an id,
    source and size are rounded as one unit and come back as so many rows. An empty table gives an empty result.
    """
    rows, t = _units(docs, list(weights), total_share, max_repeat, seed, id_col, text_col, source_col)
    return (
        rows.join(t, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), "mult")))
        .select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"), "copies")
    )


def mixed_documents(
    docs: DataFrame,
    weights: list[float] = (3, 1, 2),
    total_share: float = 1.5,
    max_repeat: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: the rows of docs, all columns as they were, each as often as it is taken (0, 1, 2 ... times).

    Nulls, texts without words, repeated rows and empty tables are as in mix_sources; a null text comes back as null.
    Columns may have any names and types.
    """
    rows, _ = _units(docs, list(weights), total_share, max_repeat, seed, id_col, text_col, source_col)
    taken = rows.filter("copies > 0").select(F.col("source").alias("of"), F.col("id").alias("unit"), F.col("size").alias("words"), "copies")
    all_rows = packed(docs, id=id_col, text=text_col, source=source_col)
    on = F.col("id").cast("bigint").eqNullSafe(F.col("unit")) & F.col("source").eqNullSafe(F.col("of")) & (_words("text") == F.col("words"))
    mixed = all_rows.join(kept_table(taken, "mix-taken"), on).select("row", F.explode(F.sequence(F.lit(1), "copies")))
    return unpacked(mixed, docs)
