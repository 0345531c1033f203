"""Quotas and token balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens of an easy and a hard row, the wanted share of easy tokens, the band in which it counts as balanced.
EASY_TOKENS, HARD_TOKENS, EASY_SHARE, BAND = 15, 750, 0.60, (58, 62)
#: Rows wanted of each domain: total, easy, hard, for the four large and the four small domains.
LARGE_DOMAINS, SMALL_DOMAINS = ("Coding", "Math", "Tool Use", "Reasoning"), ("Reading", "Summarization", "Common Sense", "Instruction")
LARGE_QUOTA, SMALL_QUOTA = {"easy": 9870, "hard": 130}, {"easy": 4935, "hard": 65}
FIRST_LARGE_QUOTA, FIRST_SMALL_QUOTA = {"easy": 4000, "hard": 6000}, {"easy": 2000, "hard": 3000}


def quota_table(spark: SparkSession, large: dict[str, int] = LARGE_QUOTA, small: dict[str, int] = SMALL_QUOTA) -> DataFrame:
    rows = [(d, k, n) for names, q in ((LARGE_DOMAINS, large), (SMALL_DOMAINS, small)) for d in names for k, n in q.items()]
    return spark.createDataFrame(rows, "domain string, difficulty string, quota bigint")


def gap_plan(df: DataFrame, quotas: DataFrame, keys: list[str], factor: float = 1.7, batch: int = 20) -> DataFrame:
    """keys, have, need, gap (need - have), action, request = int(gap * factor), batches of it."""
    have = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("have"))
    got = quotas.join(have, keys, "left").select(*keys, F.coalesce("have", F.lit(0)).alias("have"), F.col("quota").alias("need"))
    gap = F.col("need") - F.col("have")
    request = F.when(gap > 0, F.floor(gap * F.lit(factor))).otherwise(F.lit(0).cast("bigint"))
    got = got.withColumn("gap", gap).withColumn("action", F.when(gap > 0, "generate").when(gap < 0, "trim").otherwise("ok"))
    return got.withColumn("request", request).withColumn("batches", F.expr(f"(request + {batch - 1}) div {batch}"))


def token_balance(df: DataFrame, difficulty: Column) -> DataFrame:
    """One row: easy and hard rows, their tokens, the easy share in percent (null without tokens), whether it is balanced."""
    got = df.agg(F.count_if(difficulty == "easy").alias("easy"), F.count_if(difficulty == "hard").alias("hard"))
    got = got.withColumn("easy_tokens", F.col("easy") * EASY_TOKENS).withColumn("hard_tokens", F.col("hard") * HARD_TOKENS)
    share = F.try_divide(F.col("easy_tokens") * 100.0, F.col("easy_tokens") + F.col("hard_tokens"))
    return got.withColumn("easy_percent", F.round(share, 6)).withColumn("balanced", F.coalesce(share.between(*BAND), F.lit(False)))


def required_counts(total: Column) -> list[Column]:
    """Easy and hard rows of `total` rows whose tokens have the wanted share: 75 easy rows to a hard one, cut to integers."""
    hard = total / 76
    return [F.floor(hard * 75).cast("bigint").alias("easy"), F.floor(hard).cast("bigint").alias("hard")]


def domain_targets(total: Column, easy_share: float = 0.987) -> list[Column]:
    easy = F.floor(total * F.lit(easy_share)).cast("bigint")
    return [easy.alias("easy"), (total - easy).cast("bigint").alias("hard")]


def lacking(df: DataFrame, key: str, least: int) -> DataFrame:
    """Groups with fewer rows than wanted."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < least)


def unfinished(targets: DataFrame, df: DataFrame, key: str, target: str) -> DataFrame:
    """Rows of targets whose key has fewer rows in df than its target says; complete ones are skipped."""
    done = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    full = targets.join(done, F.col(key) == F.col("_key")).filter(F.col("_n") >= F.col(target)).select("_key").distinct()
    return targets.join(full, F.col(key) == F.col("_key"), "left_anti")


def merged_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, old, new, total: what each key of `old` gains."""
    a, b = (t.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for t, n in ((old, "old"), (new, "new")))
    return a.join(b, key, "left").select(key, "old", F.coalesce("new", F.lit(0)).alias("new"), (F.col("old") + F.coalesce("new", F.lit(0))).alias("total"))


def call_cost(calls: Column) -> Column:
    """Estimated cost of calls of 500 tokens in and 300 out, at 0.15 and 0.60 a million."""
    return calls * F.lit(500) * F.lit(0.15e-6) + calls * F.lit(300) * F.lit(0.60e-6)


def batch_audit(df: DataFrame, batch: str, domain: str, difficulty: Column) -> DataFrame:
    return df.groupBy(batch).agg(F.count_distinct(domain).alias("domains"), F.count_if(difficulty == "easy").alias("easy"), F.count_if(difficulty == "hard").alias("hard"))
