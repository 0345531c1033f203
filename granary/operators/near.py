"""Near duplicates, decontamination and vector search by DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.links import exact_links

WORDS, LEAST = 5, 0.8


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of a text's distinct word shingles; a shorter text has one of all its words."""
    w = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    spans = lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - words), lambda i: F.xxhash64(*[F.get(a, i + d) for d in range(words)]))
    one = lambda a: F.when(F.size(a) >= words, spans(a)).when(F.size(a) > 0, F.array(F.xxhash64(a))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.get(F.transform(F.array(w), one), F.lit(0)))


def minhash_links(df: DataFrame, id_col: str, text_col: str, least: float = LEAST) -> DataFrame:
    """(id, leader, similarity) of all near duplicates: every two texts whose shingle sets differ and whose exact Jaccard
    similarity reaches `least`, the smaller id as leader. Texts of equal sets are not expanded into all pairs: the
    smallest id stands for them, and the others are paired with it at 1.0.

    Candidates come from an exact search (see links.py), so no link is lost by chance, as by MinHash and bands.
    """
    return exact_links(df.select(F.col(id_col).alias("id"), shingle_hashes(F.col(text_col)).alias("s")), least)


def contaminated(df: DataFrame, items: DataFrame, id_col: str, text_col: str, item_text: str, gram: int = 8, most_items: int = 100_000) -> DataFrame:
    """Ids of rows whose text holds an item verbatim, wherever it starts.

    A text that holds an item holds its inner words whole, so an item of gram + 2 words or more is looked up by the hash
    of the words after its first, and the text then decides. Shorter items meet every text; they are few, or the call
    raises. Items are benchmark questions and are broadcast up to most_items rows; beyond that they are joined by key.
    """
    words = lambda c: F.split(c, r"[\x20\x09-\x0D]+")
    known = items.select(F.col(item_text).alias("item")).filter("item <> ''").distinct().withColumn("w", words(F.col("item")))
    n_items, n_short = known.agg(F.count(F.lit(1)), F.count_if(F.size("w") < gram + 2)).first()
    if n_short > most_items:
        raise ValueError(f"{n_short} items are shorter than {gram + 2} words")
    keyed = known.filter(F.size("w") >= gram + 2).select("item", F.xxhash64(*[F.get("w", F.lit(1 + i)) for i in range(gram)]).alias("g"))
    short = F.broadcast(known.filter(F.size("w") < gram + 2).select("item"))
    grams = lambda w: F.when(F.size(w) >= gram, F.transform(F.sequence(F.lit(0), F.size(w) - gram), lambda i: F.xxhash64(*[F.get(w, i + d) for d in range(gram)])))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    seen = rows.select("id", F.explode(F.array_distinct(F.get(F.transform(F.array(words(F.col("t"))), grams), F.lit(0)))).alias("g"))
    pairs = seen.join(F.broadcast(keyed) if n_items <= most_items else keyed, "g").select("id", "item").distinct()
    hit = rows.join(pairs, "id").filter(F.contains("t", "item")).select("id")
    if n_short:
        hit = hit.union(rows.join(short, F.contains("t", "item"), "left_semi").select("id"))
    return hit.distinct().select(F.col("id").alias(id_col))


def cosine_links(df: DataFrame, id_col: str, vector: str, queries: DataFrame, least: float, block: int = 512) -> DataFrame:
    """(query_id, id, cosine) of all rows whose cosine with a query reaches `least`.

    queries is a stated set; it meets every row in blocks of at most `block` queries, which are literals of the plan.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    unit = lambda d: d.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), F.sqrt(dot(F.col(vector), F.col(vector))).alias("n"))
    rows, asked = unit(df), unit(queries)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-asked.count() // block))))).groupBy("block").agg(F.collect_list(F.struct("id", "v", "n")).alias("q"))
    met = rows.crossJoin(asked)
    hit = F.filter(F.transform("q", lambda q: F.struct(q["id"].alias("query_id"), F.try_divide(dot(F.col("v"), q["v"]), F.col("n") * q["n"]).alias("cosine"))), lambda x: x["cosine"] >= least)
    return met.select("id", F.explode(hit).alias("h")).select("h.query_id", "id", "h.cosine")
