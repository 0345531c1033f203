"""Losses reduced to metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evaluate(df: DataFrame, loss: str) -> DataFrame:
    """One row: num_examples, avg_loss, perplexity. The weighted mean of batch means is the mean of the rows."""
    return df.agg(F.count(loss).alias("num_examples"), F.avg(loss).alias("avg_loss")).withColumn("perplexity", F.exp("avg_loss"))


def evaluate_by(df: DataFrame, loss: str, key: Column, batch: str | None = None) -> DataFrame:
    """key, count, avg_loss, perplexity. With a batch, each row counts with the mean of its batch, whatever its key."""
    rows = df.select(key.alias("key"), F.col(loss).alias("l"), *([F.col(batch).alias("b")] if batch else []))
    if batch:
        rows = rows.withColumn("l", F.avg("l").over(Window.partitionBy("b")))
    return rows.groupBy("key").agg(F.count("l").alias("count"), F.avg("l").alias("avg_loss")).withColumn("perplexity", F.exp("avg_loss"))


def compare(base: DataFrame, other: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """One row of two one-row results: loss difference, whether they are equal, improvement in percent and a verdict."""
    a, b = base.select(F.col("avg_loss").alias("base_loss")), other.select(F.col("avg_loss").alias("other_loss"))
    got = a.crossJoin(b)  # one row each
    diff = F.abs(F.col("base_loss") - F.col("other_loss"))
    better = F.try_divide((F.col("base_loss") - F.col("other_loss")) * 100.0, F.col("base_loss"))
    return got.select("base_loss", "other_loss", diff.alias("difference"), (diff < tolerance).alias("equal"), better.alias("improvement"), F.when(better > 0, "improved").otherwise("not improved").alias("verdict"))


def early_stop(df: DataFrame, step: str, loss: str, patience: int) -> DataFrame:
    """step, loss, running mean, best so far, epochs without a new best, stop (patience reached at or before this step).

    One row a step: a series of evaluations, not a corpus, so one task is enough.
    """
    past = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("running_mean", F.avg(loss).over(past)).withColumn("best", F.min(loss).over(past))
    rows = rows.withColumn("_new", F.coalesce(F.col(loss) < F.min(loss).over(before), F.lit(True))).withColumn("_at", F.row_number().over(Window.orderBy(step)))
    rows = rows.withColumn("waited", F.col("_at") - F.max(F.when(F.col("_new"), F.col("_at"))).over(past))
    return rows.withColumn("stop", F.max((F.col("waited") >= patience).cast("int")).over(past) == 1).drop("_new", "_at")


def largest_difference(a: DataFrame, b: DataFrame, key: str, vector: str, most_keys: int | None = None) -> DataFrame:
    """One row: the largest absolute difference of vectors of equal keys (the first most_keys keys, if given)."""
    x = a.select(F.col(key).alias("k"), F.col(vector).alias("x"))
    x = x.orderBy("k").limit(most_keys) if most_keys else x
    both = x.join(b.select(F.col(key).alias("k"), F.col(vector).alias("y")), "k")
    return both.agg(F.max(F.array_max(F.zip_with("x", "y", lambda p, q: F.abs(p - q)))).alias("max_difference"))


def generation_stats(df: DataFrame, tokens: Column, difficulty: Column, domain: Column, seconds: Column) -> DataFrame:
    """Totals, tokens and throughput of all rows and of each difficulty and domain, by grouping sets."""
    rows = df.select(tokens.alias("t"), difficulty.alias("difficulty"), domain.alias("domain"), seconds.alias("s"))
    got = rows.groupingSets([[], ["difficulty"], ["domain"]], "difficulty", "domain").agg(F.count(F.lit(1)).alias("rows"), F.sum("t").alias("tokens"), F.sum("s").alias("seconds"))
    return got.withColumn("tokens_per_second", F.try_divide("tokens", "seconds"))


def cascade_route(perplexity: Column, draft: float = 20.0, base: float = 30.0) -> Column:
    """Which model answers: the draft model below its threshold, the base model below its own, else the modifier."""
    return F.when(perplexity < draft, "draft").when(perplexity < base, "base").otherwise("modifier")


def loss_mask(section_lengths: Column, trained: Column) -> Column:
    """0 or 1 for each token of sections of these lengths, 1 where the section is trained on."""
    return F.flatten(F.zip_with(section_lengths, trained, lambda n, t: F.array_repeat(t.cast("int"), n)))
