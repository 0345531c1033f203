"""Counts that describe or vet a table, each in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import has_markup, quality_issues, strip


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def cleaned_stats(df: DataFrame, prompt: str, response: str, difficulty: Column) -> DataFrame:
    """One row: total, easy, hard, other, missing_prompt, missing_response, has_markup, avg_length (0 for no rows)."""
    kind = F.coalesce(difficulty, F.lit("easy"))
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(kind == "easy").alias("easy"), F.count_if(kind == "hard").alias("hard"), F.count_if(~kind.isin("easy", "hard")).alias("other"),
        F.count_if(_empty(F.col(prompt))).alias("missing_prompt"), F.count_if(_empty(F.col(response))).alias("missing_response"), F.count_if(has_markup(F.col(response))).alias("has_markup"),
        F.round(F.coalesce(F.avg(F.char_length(F.coalesce(F.col(response), F.lit("")))), F.lit(0.0)), 6).alias("avg_length"),
    )


def cleaned_by_domain(df: DataFrame, domain: str) -> DataFrame:
    """domain ('Unknown' where null), n, percent of all rows."""
    per = distribution(df, F.coalesce(F.col(domain), F.lit("Unknown")), "domain")
    total = per.agg(F.sum("n").alias("_total"))  # one row
    return per.crossJoin(F.broadcast(total)).select("domain", "n", F.round(F.col("n") * 100.0 / F.col("_total"), 6).alias("percent"))


def long_enough(text: Column, least: int = 10) -> Column:
    """Raw text of at least so many characters, before any formatting; null is too short."""
    return F.coalesce(F.char_length(text) >= least, F.lit(False))


def complete(*fields: Column) -> Column:
    """No field is null or only spaces."""
    kept = F.lit(True)
    for f in fields:
        kept = kept & F.coalesce(strip(f) != "", F.lit(False))
    return kept


def of_kinds(kind: Column, *kinds: str) -> Column:
    """The field in lower case is one of the kinds."""
    return F.coalesce(F.lower(kind).isin(*kinds), F.lit(False))


def serializable(df: DataFrame) -> DataFrame:
    """Rows that can be written as JSON: all of them, as every type of a column has a JSON form."""
    return df


def training_stats(df: DataFrame, prompt: str, response: str, metadata: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(_empty(F.col(prompt))).alias("missing_prompt"), F.count_if(_empty(F.col(response))).alias("missing_response"), F.count_if(F.col(metadata).isNull()).alias("missing_metadata"))


def assert_complete(df: DataFrame, prompt: str, response: str, metadata: str) -> None:
    """Raises ValueError if any row lacks a prompt, a response or metadata."""
    got = training_stats(df, prompt, response, metadata).first().asDict()
    bad = {k: v for k, v in got.items() if k.startswith("missing_") and v}
    if bad:
        raise ValueError(f"incomplete rows: {bad}")


def assert_fields(df: DataFrame, *fields: str) -> None:
    if missing := [f for f in fields if f not in df.columns]:
        raise ValueError(f"missing fields: {missing}")


def distribution(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Rows of each key, 'unknown' where it is null, most first."""
    return df.groupBy(F.coalesce(key.cast("string"), F.lit("unknown")).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def quality_summary(df: DataFrame, text: str) -> DataFrame:
    """One row: sampled, with_issues, issues, pass_rate in percent (null for no rows)."""
    n = F.size(quality_issues(F.col(text)))
    got = df.agg(F.count(F.lit(1)).alias("sampled"), F.count_if(n > 0).alias("with_issues"), F.coalesce(F.sum(n), F.lit(0)).alias("issues"))
    return got.withColumn("pass_rate", F.round(F.try_divide((F.col("sampled") - F.col("with_issues")) * 100.0, F.col("sampled")), 6))


def criteria_pass(*scores: Column, least: float = 7.0) -> Column:
    """The mean of the scores reaches `least`; a missing score fails."""
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return F.coalesce(total / len(scores) >= least, F.lit(False))


def merge_report(df: DataFrame, id_col: str, difficulty: Column, *required: str) -> DataFrame:
    """One row: total, easy, hard, missing (rows without a required field), duplicate_ids."""
    per = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), F.count_if(difficulty == "easy").alias("e"), F.count_if(difficulty == "hard").alias("h"), F.count_if(F.greatest(*[F.col(c).isNull() for c in required], F.lit(False))).alias("m"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("e"), F.lit(0)).alias("easy"), F.coalesce(F.sum("h"), F.lit(0)).alias("hard"), F.coalesce(F.sum("m"), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids"))


def manifest(df: DataFrame, name: Column) -> DataFrame:
    """One row: benchmarks, total_questions."""
    return df.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("benchmarks"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_questions"))


def manifest_status(df: DataFrame, expected: DataFrame, name: str) -> DataFrame:
    """One row: benchmarks, succeeded (of one row or more), failed, total_questions, of the expected names (a small table)."""
    got = df.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    per = expected.select(name).distinct().join(got, name, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("benchmarks"), F.count_if(F.col("n") > 0).alias("succeeded"), F.count_if(F.col("n") == 0).alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_questions"))


def composition(df: DataFrame, group: Column, seq: str, domain: str, difficulty: Column) -> DataFrame:
    """Each group's rows, and the domain and difficulty of its first row."""
    return df.groupBy(group.alias("name")).agg(F.count(F.lit(1)).alias("total"), F.min_by(domain, seq).alias("domain"), F.min_by(difficulty, F.col(seq)).alias("difficulty"))
