"""Rows made by a model, in batches: a provider is any function from a list of prompts to as many answers.

A batch that fails as a whole is halved down to a floor and then tried row by row; each call is tried again with growing
waits. Rows keep their order and number; an answer that could not be had is null.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[str | None]]


def echo(prompts: list[str]) -> list[str | None]:
    """A provider for tests: the prompt in capitals."""
    return [p.upper() if p is not None else None for p in prompts]


def with_retry(call: Provider, tries: int = 3, wait: float = 1.0) -> Provider:
    def tried(prompts: list[str]) -> list[str | None]:
        for k in range(tries):
            try:
                return call(prompts)
            except Exception:
                if k == tries - 1:
                    raise
                time.sleep(wait * 2**k)
        return []

    return tried


def halving(call: Provider, floor: int = 5) -> Provider:
    def answers(prompts: list[str]) -> list[str | None]:
        try:
            got = list(call(prompts))
            got = got[: len(prompts)] + [None] * (len(prompts) - len(got))
        except Exception:
            got = [None] * len(prompts)
        if any(a is not None for a in got) or not prompts:
            return got
        if len(prompts) > floor:
            half = len(prompts) // 2
            return answers(prompts[:half]) + answers(prompts[half:])
        out: list[str | None] = []
        for p in prompts if len(prompts) > 1 else []:
            try:
                out.extend(call([p])[:1] or [None])
            except Exception:
                out.append(None)
        return out or got

    return answers


def apply_provider(df: DataFrame, prompt: str, provider: Provider, batch: int = 25, floor: int = 5, tries: int = 3, wait: float = 1.0, out: str = "answer") -> DataFrame:
    """df with the answers as a further column."""
    ask = halving(with_retry(provider, tries, wait), floor)

    @F.pandas_udf("string")
    def answer(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            prompts = s.tolist()
            yield pd.Series([a for i in range(0, len(prompts), batch) for a in ask(prompts[i : i + batch])], dtype="object")

    return df.withColumn(out, answer(prompt))


def tokenize(df: DataFrame, text: str, encode: Callable[[str], list[int]], longest: int = 2048, pad: int | None = None, out: str = "input_ids") -> DataFrame:
    """df with token ids, cut at `longest` and, if a pad id is given, padded to it."""

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            cut = [list(encode(t or ""))[:longest] for t in s]
            yield pd.Series([x + [pad] * (longest - len(x)) if pad is not None else x for x in cut])

    return df.withColumn(out, ids(text))


def collate(df: DataFrame, batch: str, order: str, *columns: str) -> DataFrame:
    """One row a batch: its columns as arrays in order. Batches are of bounded size."""
    got = df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias("_r"))
    return got.select(batch, *[F.col(f"_r.{c}").alias(c) for c in columns])


def run_until(make: Callable[[int], DataFrame], target: int, models: int = 1, least_yield: float = 0.3, most_failures: int = 10) -> tuple[list[DataFrame], int]:
    """Calls make(model) until its rows reach the target. A model whose yield is under least_yield of what is missing gives way
    to the next; the loop ends after most_failures empty calls in a row. Returns the tables and their rows."""
    tables, rows, model, failures = [], 0, 0, 0
    while rows < target and failures < most_failures:
        got = make(model)
        n = got.count()
        failures = 0 if n else failures + 1
        if n < least_yield * (target - rows) and model < models - 1:
            model += 1
        if n:
            tables.append(got)
            rows += n
    return tables, rows


def aligned(questions: DataFrame, answers: DataFrame, keys: list[str], array: str, out: str = "answer") -> DataFrame:
    """Questions with the answer at their position of the batch's array (batch, array); null where the array is shorter."""
    batch, pos = keys
    return questions.join(answers.select(batch, F.col(array).alias("_a")), batch, "left").withColumn(out, F.get("_a", F.col(pos).cast("int"))).drop("_a")


def failed(df: DataFrame, question: str, difficulty: Column, answer: str, error: str = "no answer") -> DataFrame:
    """Rows without an answer, as an error table."""
    return df.filter(F.col(answer).isNull()).select(F.left(question, F.lit(100)).alias("question"), difficulty.alias("difficulty"), F.lit(error).alias("error"))


def table_function(df: DataFrame, keys: list[str], column: str, expand: Callable[[str | None], list[tuple]], schema: str, at_once: int = 10_000) -> DataFrame:
    """keys and the rows of `schema` that expand(value) gives for each row, none or many. Keys keep their types."""
    names = [x.split()[0] for x in schema.split(",")]
    kinds = dict(df.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out: list[tuple] = []
            for key, value in zip(p["_keys"], p[column]):
                out.extend((key, *row) for row in expand(value))
                if len(out) >= at_once:
                    yield pd.DataFrame(out, columns=["_keys", *names])
                    out = []
            yield pd.DataFrame(out, columns=["_keys", *names])

    # Keys go through Python as JSON, so that no null turns them into floats.
    packed = df.select(F.to_json(F.struct(*keys)).alias("_keys"), column)
    got = packed.mapInPandas(run, f"_keys string, {schema}")
    return got.select(F.from_json("_keys", ", ".join(f"`{k}` {kinds[k]}" for k in keys)).alias("_k"), *names).select("_k.*", *names)


def aggregate_function(df: DataFrame, key: str, column: str, state: Callable[[pd.Series], bytes], merge: Callable[[bytes, bytes], bytes], salts: int = 16) -> DataFrame:
    """key (as text), state: an aggregate of one's own, merged like Spark's. state(values) is made of each batch's rows of a
    key before they are shuffled; merge(a, b), in any order, first by key and salt, so that a hot key is spread, then by key.
    """

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(None if k != k else k, state(g[column])) for k, g in p.groupby("key", dropna=False)], columns=["key", "state"])

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple | None = None
        for p in parts:
            out = []
            for k, s in zip(p["key"], p["state"]):
                if now is not None and now[0] == k:
                    now = (k, merge(now[1], s))
                else:
                    out += [now] if now is not None else []
                    now = (k, s)
            yield pd.DataFrame(out, columns=["key", "state"])
        yield pd.DataFrame([now] if now is not None else [], columns=["key", "state"])

    schema = "key string, state binary"
    got = df.select(F.col(key).cast("string").alias("key"), column).mapInPandas(partial, schema).withColumn("_s", F.pmod(F.spark_partition_id(), F.lit(salts)))
    got = got.repartition("key", "_s").sortWithinPartitions("key", "_s").select("key", "state").mapInPandas(fold, schema)
    return got.repartition("key").sortWithinPartitions("key").mapInPandas(fold, schema).select(F.col("key").alias(key), "state")
