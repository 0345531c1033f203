"""Document fingerprints from closed syncmers over words.

A k-mer of words is an anchor if the least of its inner s-mers (by hash) stands at its start or its end. That depends
on the k-mer alone, not on what surrounds it: an edit changes only the anchors whose words it touches, and two texts
that share a passage share the anchors in it, in the same order and at the same distances. A fingerprint is the
anchors' hashes and places in the order of the text. Matching is positional: what two texts have in common is an anchor
that is followed by the same anchor at the same distance, wherever in the text that is; likeness is the share of these
among all (Jaccard).

A symbol is an ideograph, or a run of at most 32 other characters that are not white space, so that texts without
spaces have anchors too. A text of fewer than k symbols, or without a closed k-mer (one or two need not be), has one
anchor, made of all of them.

All of it is DataFrame expressions. Values that a lambda reads again and again are bound by `let`, since the optimizer
could otherwise move their computation into the lambda.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import kept_table, whole

K, S = 5, 2
SYMBOL = r"\p{IsIdeographic}|[^\x20\x09-\x0D\p{IsIdeographic}]{1,32}"
#: Rows of a bucket of neighbouring ids, about; parts that a level of quantiles makes of one; levels at most, which bounds
#: what is broadcast: quantiles of PARTS ** 2 buckets, and the first id of each of PARTS ** 3.
ROWS, PARTS, LEVELS = 512, 64, 3


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The anchors of a text in its order, array<struct<h, at>>: 32 bits of a hash, and the place of the first symbol.

    s is 2 words or more, k above s.
    """
    inner = k - s  # an s-mer's last place in the k-mer
    ints = lambda last: F.sequence(F.lit(0), last)
    short = lambda v: F.shiftrightunsigned(v, 32)

    def pick(h: Column, m: Column) -> Column:
        at = lambda i, d: F.get(m, i + d)
        closed = F.filter(ints(F.size(h) - k), lambda i: F.least(*[at(i, d) for d in range(inner + 1)]).isin(at(i, 0), at(i, inner)))
        return F.transform(closed, lambda i: F.struct(short(F.xxhash64(*[F.get(h, i + d) for d in range(k)])).alias("h"), i.alias("at")))

    def of(h: Column) -> Column:
        smers = F.transform(ints(F.size(h) - s), lambda i: F.xxhash64(*[F.get(h, i + d) for d in range(s)]))
        every = F.array(F.struct(short(F.xxhash64(h)).alias("h"), F.lit(0).alias("at")))
        closed = let(let(smers, lambda m: pick(h, m)), lambda found: F.when(F.size(found) > 0, found).otherwise(every))
        return F.when(F.size(h) >= k, closed).when(F.size(h) > 0, every).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))

    return let(F.transform(F.regexp_extract_all(text, F.lit(SYMBOL), F.lit(0)), lambda w: F.xxhash64(w)), of)


def as_string(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda a: F.concat(F.lower(F.hex(a["h"])), F.lit(":"), a["at"])), " ")


def links(found: Column) -> Column:
    """For each anchor, a hash of it, the next one and the distance between them; of the last one, of it alone."""

    def link(a: Column, i: Column) -> Column:
        following = F.get(found, i + 1)
        return F.xxhash64(a["h"], following["h"], following["at"] - a["at"])

    return F.transform(found, link)


def likeness(a: Column, b: Column) -> Column:
    """The share of two texts' links() that they have in common; 1.0 if neither has any."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.size(F.array_union(a, b)))


def _bucketed(rows: DataFrame) -> DataFrame:
    """Rows (_id, _t) with _bucket: numbers rise with the ids; about ROWS rows have one, however the ids lie.

    Each level cuts each bucket of the one before at its own quantiles. Rows without an id have numbers below 0, by the
    hash of their text, so many of them fill no bucket either.
    """
    n, levels = rows.count(), 0
    while PARTS**levels * ROWS < n and levels < LEVELS:
        levels += 1
    rows = rows.withColumn("_bucket", F.when(F.col("_id").isNotNull(), F.lit(0).cast("bigint")))
    at = [i / PARTS for i in range(1, PARTS)]
    for level in range(levels):
        cuts = rows.filter("_id is not null").groupBy("_bucket").agg(F.percentile_approx("_id", at, 10000).alias("_cuts"))
        cuts = kept_table(cuts.select(F.col("_bucket").alias("_of"), F.array_distinct("_cuts").alias("_cuts")), "fingerprint-cuts")
        rows = rows.join(F.broadcast(cuts), F.col("_bucket") == F.col("_of"), "left")  # PARTS ** level rows of 63 numbers
        rows = rows.select("_id", "_t", (F.col("_bucket") * PARTS + F.size(F.filter("_cuts", lambda c: c <= F.col("_id")))).alias("_bucket"))
    place = (F.xxhash64("_t").cast("double") / float(1 << 63) + 1) / 2 * PARTS**levels
    return rows.select("_id", "_t", F.coalesce("_bucket", -1 - F.least(F.floor(place), F.lit(PARTS**levels - 1))).alias("_bucket"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (_id, _t) with _bucket, of neighbouring ids, and _look: each bucket also has the first row of the next
    one in descending order (the last one that of the first), marked _look.
    """
    rows = _bucketed(rows)
    hashed = F.when(F.col("_id").isNull(), F.xxhash64("_t"))
    heads = rows.groupBy("_bucket").agg(F.max("_id").alias("_top"), F.min(hashed).alias("_least"))
    down, all_ = Window.orderBy(F.desc("_bucket")), Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.col("_bucket").alias("_b"), "_top", "_least", F.coalesce(F.lag("_bucket").over(down), F.last("_bucket").over(all_)).alias("_to"))
    own = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("look"))
    ahead = F.struct(F.col("_to").alias("b"), F.lit(True).alias("look"))
    # heads has at most 2 * PARTS ** LEVELS rows of four numbers.
    met = rows.join(F.broadcast(heads), (F.col("_bucket") == F.col("_b")) & F.col("_id").eqNullSafe(F.col("_top")) & hashed.eqNullSafe(F.col("_least")), "left")
    return met.select("_id", "_t", F.explode(F.when(F.col("_b").isNull(), F.array(own)).otherwise(F.array(own, ahead))).alias("_at")).select("_id", "_t", F.col("_at.b").alias("_bucket"), F.col("_at.look").alias("_look"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document in descending order of the id; after the last comes the first. Texts move once, to their neighbours.

    A null text counts as empty; an empty text has no anchors, and two of those are alike (1.0). Rows of one id
    follow each other by a hash of the text; rows without an id come last, in the same way. The only row of a table
    is its own next. Very long texts are one row each; other columns are ignored, and an empty table gives an empty
    result.
    """
    rows = _dealt(docs.select(F.col(id_col).cast("bigint").alias("_id"), whole(text_col).alias("_t")))
    w = Window.partitionBy("_bucket").orderBy("_look", F.col("_id").desc_nulls_last(), F.xxhash64("_t"))
    rows = rows.withColumn("_next", F.lead("_t").over(w)).withColumn("_f", anchors(F.col("_t"), k, s)).withColumn("_l", links(F.col("_f"))).withColumn("_ln", F.lead("_l").over(w))
    half = F.floor(F.char_length("_t") / 2).cast("int")
    edited = F.concat(F.substring("_t", F.lit(1), F.char_length("_t") - half), F.substring("_next", F.lit(1), half))
    rows = rows.filter(~F.col("_look")).withColumn("_e", edited).withColumn("_fe", anchors(F.col("_e"), k, s))
    return rows.select(
        F.col("_id").alias("doc_id"),
        F.char_length("_t").cast("bigint").alias("n_chars"),
        F.sha2("_e", 256).alias("edited_sha256"),
        as_string(F.col("_f")).alias("fingerprint"),
        as_string(F.col("_fe")).alias("edited_fingerprint"),
        likeness(F.col("_l"), links(F.col("_fe"))).alias("near_edited"),
        likeness(F.col("_l"), F.col("_ln")).alias("near_next"),
    )
