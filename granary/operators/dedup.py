"""Exact dedup by key, and set operations. The first row by `seq` wins; a hot key is folded before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of_key(df: DataFrame, key: Column, seq: str) -> DataFrame:
    """The row of least seq for each key, all columns as they were. Null and empty keys go."""
    rows = df.select(F.struct(F.col(seq).alias("_seq"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("_r"), key.alias("_k"))
    best = rows.filter("_k <> ''").groupBy(F.xxhash64("_k").alias("_h"), "_k").agg(F.min("_r").alias("_r"))
    return best.select(*[F.col(f"_r.c{i}").alias(c) for i, c in enumerate(df.columns)])


def duplicate_rows(df: DataFrame, key: Column, seq: str) -> DataFrame:
    """The rows that first_of_key leaves out: those after the first of their key, and those of null and empty keys."""
    first = first_of_key(df, key, seq).select(F.col(seq).alias("_first"))
    return df.join(first, F.col(seq) == F.col("_first"), "left_anti")


def duplicate_counts(df: DataFrame, key: Column) -> DataFrame:
    """One row: unique, duplicates, rate = duplicates / rows (null for no rows). A null or empty key counts as a duplicate."""
    per = df.select(F.coalesce(key, F.lit("")).alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("n"))
    got = per.agg(F.count_if(F.col("_k") != "").alias("unique"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return got.select("unique", (F.col("n") - F.col("unique")).alias("duplicates"), F.try_divide(F.col("n") - F.col("unique"), F.col("n")).alias("rate"))


def new_rows(df: DataFrame, existing: DataFrame, key: Column, existing_key: Column, seq: str) -> DataFrame:
    """First rows of keys that `existing` has not."""
    seen = existing.select(existing_key.alias("_seen")).filter("_seen is not null").distinct()
    fresh = first_of_key(df.withColumn("_key", key), F.col("_key"), seq)
    return fresh.join(seen, fresh["_key"] == seen["_seen"], "left_anti").drop("_key")


def pending(df: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows whose raw key the ledger has not; null keys are pending."""
    return df.join(ledger.select(F.col(key).alias("_done")).distinct(), F.col(key) == F.col("_done"), "left_anti")


def union_all(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def union_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def except_by_value(df: DataFrame, taken: DataFrame) -> DataFrame:
    """Rows of df equal to no row of `taken`, by value in all columns; repeated rows stay repeated."""
    other = taken.select(*[F.col(c).alias(f"_x{i}") for i, c in enumerate(df.columns)]).distinct()
    on = F.lit(True)
    for i, c in enumerate(df.columns):
        on = on & F.col(c).eqNullSafe(F.col(f"_x{i}"))
    return df.join(other, on, "left_anti")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def compare_distributions(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, a, b: counts of each key in either table, 0 where it is missing."""
    x, y = (t.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for t, n in ((a, "a"), (b, "b")))
    return x.join(y, key, "full_outer").select(key, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
