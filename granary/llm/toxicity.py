"""Toxicity: cumulative-link ordinal regression on sparse text features.

Grades come from the labels alone: 0 is a document labelled clean, 1 one labelled toxic, 2 one labelled toxic and of low
quality as well. One set of weights serves both thresholds, P(grade > j) = sigmoid(w . x - t_j) with t_0 < t_1, and the
output is the expected grade.

Features are words and their beginnings of 4 to 6 letters; those enter that are more frequent in toxic documents than
chance allows (likelihood ratio of LEAST_RATIO, in LEAST_DOCS documents or more). A value is log(1 + times per 100 words).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import frugal, kept_here, whole
from granary.llm.labelled import held_out, training_texts

#: Documents learned from, at most; documents and likelihood ratio that a feature needs.
MOST_ROWS, LEAST_DOCS, LEAST_RATIO = 24_000, 5, 25.0
PENALTY, STEPS = 0.5, 400

_word = re.compile(r"\w+")


def spellings(word: str) -> list[str]:
    """A word's features: itself, and its beginnings with a mark."""
    return [word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self) -> None:
        self._known: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = self._known.get(word)
        if found is None:
            if len(self._known) > 300_000:
                self._known.clear()
            found = self._known[word] = tuple(self.index[f] for f in spellings(word) if f in self.index)
        return found

    def vector(self, text: str) -> dict[int, float]:
        words = _word.findall(text.lower())
        counts: dict[int, int] = {}
        for found in map(self.of_word, words):
            for i in found:
                counts[i] = counts.get(i, 0) + 1
        n = max(len(words), 1)
        return {i: float(np.log1p(100 * c / n)) for i, c in counts.items()}

    def exceeds(self, text: str) -> np.ndarray:
        """P(grade > j) for each threshold j."""
        return sigmoid(sum(self.weights[i] * v for i, v in self.vector(text).items()) - self.thresholds)


def _fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grade: np.ndarray, n_features: int, n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds by gradient steps (Adam) on the cumulative logits.

    A threshold is the one before plus exp(g), so their order holds throughout.
    """
    n, m = len(grade), n_grades - 1
    above = (grade[:, None] > np.arange(m)[None, :]).astype(float)
    p = np.zeros(n_features + m)
    p[n_features] = 2.0
    first, second = np.zeros_like(p), np.zeros_like(p)
    for it in range(1, STEPS + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1 :])
        t = p[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(rows, values * w[cols], n) if len(rows) else np.zeros(n)
        err = sigmoid(z[:, None] - t[None, :]) - above
        by_t = -err.sum(0)
        gw = np.bincount(cols, values * err.sum(1)[rows], n_features) if len(rows) else np.zeros(n_features)
        g = np.concatenate([gw + PENALTY * w, [by_t.sum()], np.cumsum(by_t[::-1])[::-1][1:] * gaps]) / max(n, 1)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        p -= 0.05 * (first / (1 - 0.9**it)) / (np.sqrt(second / (1 - 0.99**it)) + 1e-8)
    return p[:n_features], p[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_features + 1 :]))])


def graded(labels: DataFrame, label_col: str = "toxic", quality_col: str | None = "quality", id_col: str = "doc_id") -> DataFrame:
    """(id, grade) of labels: 0 clean, 1 toxic, 2 toxic and of quality 0. Without a quality, toxic is 1."""
    worse = F.coalesce(F.col(quality_col) == 0, F.lit(False)).cast("int") if quality_col else F.lit(0)
    return labels.select(F.col(id_col), F.when(F.col(label_col) > 0, 1 + worse).when(F.col(label_col).isNotNull(), 0).alias("grade"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", quality_col: str | None = "quality", most: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from at most `most` labelled rows. Without toxic ones, every document is clean.

    A null label is none. Of labels of one id that differ, the highest grade counts.
    """
    texts = training_texts(docs, graded(labels, label_col, quality_col, id_col), "grade", most, id_col, text_col)

    totals = texts.agg(F.count_if(F.col("y") > 0).alias("t"), F.count_if(F.col("y") <= 0).alias("c")).first()
    nt, nc = totals["t"], totals["c"]
    if not nt or not nc:
        return Model({}, np.zeros(0), np.array([40.0, 41.0]))

    def count_batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in range(0, len(p), 500):
                toxic, clean = Counter(), Counter()
                for text, y in zip(p["text"][at : at + 500], p["y"][at : at + 500]):
                    (toxic if y > 0 else clean).update({f for w in set(_word.findall(text.lower())) for f in spellings(w)})
                yield pd.DataFrame([(f, toxic[f], clean[f]) for f in toxic.keys() | clean.keys()], columns=["f", "toxic", "clean"])

    a, b, n = F.col("toxic"), F.col("clean"), float(nt + nc)
    part = lambda o, row, col: F.when(o > 0, o * F.log(o * n / (row * F.lit(float(col))))).otherwise(0.0)
    ratio = 2 * (part(a, a + b, nt) + part(b, a + b, nc) + part(nt - a, n - a - b, nt) + part(nc - b, n - a - b, nc))
    counts = texts.mapInPandas(frugal(count_batches), "f string, toxic bigint, clean bigint").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    chosen = counts.filter((a >= LEAST_DOCS) & (a * nc > b * nt)).withColumn("g", ratio).filter(F.col("g") > LEAST_RATIO)
    names = [r["f"] for r in chosen.orderBy(F.desc("g"), "f").collect()]  # words that are telling in `most` documents
    model = Model({f: i for i, f in enumerate(names)}, np.zeros(len(names)), np.array([40.0, 41.0]))

    def vectors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = [model.vector(t) for t in p["text"]]
            yield pd.DataFrame({"i": [list(x) for x in found], "v": [list(x.values()) for x in found], "y": p["y"]})

    train = texts.mapInPandas(frugal(vectors), "i array<int>, v array<double>, y int").toPandas()  # `most` rows at most, each of few features
    rows = np.repeat(np.arange(len(train)), train["i"].map(len))
    flat = lambda c, kind: np.concatenate([np.asarray(x, kind) for x in train[c]]) if len(rows) else np.zeros(0, kind)
    model.weights, model.thresholds = _fit(rows, flat("i", np.int64), flat("v", float), train["y"].to_numpy(), len(names), 3)
    return model


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, severity (expected grade, 0 to 2), score (that of being toxic), grade
    (the median), toxic (score >= 0.5).

    A null text counts as empty, and an empty one has no features. Repeated rows are scored each, very long texts as a
    whole; other columns are ignored, and an empty table gives an empty result.
    """

    @F.pandas_udf("array<double>")
    def exceeds(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept_here("")
        for s in parts:
            yield s.map(lambda t: model.exceeds(t).tolist())

    p0, p1 = F.col("_p")[0], F.col("_p")[1]
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), exceeds(whole(text_col)).alias("_p"))
    median = (p0 >= 0.5).cast("int") + (p1 >= 0.5).cast("int")
    return rows.select("doc_id", "held_out", (p0 + p1).alias("severity"), p0.alias("score"), median.alias("grade"), (p0 >= 0.5).alias("toxic"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not toxic (score < 0.5), with all their columns as they were, whatever their names.

    Null and empty texts have no features; repeated rows go or stay together; an empty table gives an empty one.
    """

    @F.pandas_udf("boolean")
    def toxic(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept_here("")
        for s in parts:
            yield s.map(lambda t: bool(model.exceeds(t)[0] >= 0.5)).astype(bool)

    return docs.filter(~toxic(whole(text_col)))
