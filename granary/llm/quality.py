"""Quality classifier: ridge regression on random Fourier features of document statistics, with isotonic calibration.

The features approximate a Gaussian kernel over standardised statistics of a text. Normal equations are summed by
partition and the sums added up, so what reaches the driver is some matrices of fixed size; calibration pairs are at
most a fifth of the training sample. Scoring is one narrow pass over all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import kept_table, whole
from granary.llm.labelled import held_out, training_texts

#: Documents learned from, at most; random features; ridge penalty a row; kernel width in standard deviations.
MOST_ROWS, FEATURES, PENALTY, WIDTH, SEED = 24_000, 256, 1e-3, 4.0, 11

_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".,;:'\"()-?", "!", "|<>[]{}=_+/\\~^`", "#$%&*@")
_CLASS_OF = np.zeros((256, len(_CLASSES) + 2))
for _i, _c in enumerate(_CLASSES):
    for _x in _c:
        _CLASS_OF[ord(_x), _i] = 1
_CLASS_OF[128:, len(_CLASSES)] = 1
_CLASS_OF[:128, len(_CLASSES) + 1] = _CLASS_OF[:128, : len(_CLASSES)].sum(1) == 0


def statistics(text: str) -> np.ndarray:
    """The statistics of one text: sizes, shares of byte classes, repetition of words and lines."""
    raw = np.frombuffer(text.encode(), np.uint8)
    shares = np.bincount(raw, minlength=256) @ _CLASS_OF / max(len(raw), 1)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    counts = Counter(words)
    n = max(len(words), 1)
    letters = shares[0] + shares[1]
    return np.concatenate(
        [
            np.sqrt(shares),
            [
                np.log1p(len(words)),
                np.log1p(len(raw) / n),
                len(counts) / n,
                np.log1p(len(counts)) / np.log1p(n),
                max(counts.values(), default=0) / n,
                sum(v for v in counts.values() if v > 3) / n,
                len(set(lines)) / max(len(lines), 1),
                np.log1p(len(words) / max(len(lines), 1)),
                shares[1] / max(letters, 1e-9),
            ],
        ]
    )


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # calibration: raw scores, and the probability at each
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2.0 / len(self.phase)) * np.cos((x - self.mean) / self.scale @ self.frequency + self.phase)
        return np.hstack([z, np.ones((len(x), 1))])

    def score(self, texts: pd.Series) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        raw = self.features(np.vstack([statistics(t) for t in texts])) @ self.weights
        return np.clip(np.interp(raw, self.steps, self.levels), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the non-decreasing steps nearest to y in the order of x."""
    blocks: list[list[float]] = []  # sum of x, sum of y, rows
    for i in np.argsort(x, kind="stable"):
        blocks.append([x[i], y[i], 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = MOST_ROWS, **cols: str) -> Model:
    """Learns from at most `most` labelled rows. Without any, or with one class only, the score is the same for all.

    A null label is none. Of labels of one id that differ, the highest counts.
    """
    texts = training_texts(docs, labels, label_col, most, **cols)
    probe = len(statistics(""))

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"x": [statistics(t) for t in p["text"]], "y": p["y"], "part": p["part"]})

    rows = kept_table(texts.mapInPandas(measure, "x array<double>, y int, part int"), "quality-statistics")
    each = [F.struct(F.avg(F.get("x", F.lit(i))).alias("m"), F.stddev_pop(F.get("x", F.lit(i))).alias("s")) for i in range(probe)]
    facts = rows.agg(F.array(*each).alias("v"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).first()
    base = facts["y"] if facts["y"] is not None else 0.5
    rng = np.random.default_rng(SEED)
    model = Model(
        np.array([v["m"] or 0.0 for v in facts["v"]]),
        np.array([max(v["s"] or 0.0, 1e-6) for v in facts["v"]]),
        rng.normal(size=(probe, FEATURES)) / WIDTH,
        rng.uniform(0, 2 * np.pi, FEATURES),
        np.zeros(FEATURES + 1),
        np.array([0.0]),
        np.array([base]),
    )
    if not 0 < base < 1:
        return model

    def equations(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for p in parts:
            if len(p):
                z = model.features(np.vstack(p["x"]))
                a += z.T @ z
                b += z.T @ p["y"].to_numpy(float)
        yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()]})

    fit, rest = rows.filter("part <> 0"), rows.filter("part = 0")
    sums = fit.repartition(6).mapInPandas(equations, "a binary, b binary").collect()  # six matrices of fixed size
    a = sum(np.frombuffer(r["a"]).reshape(FEATURES + 1, -1) for r in sums)
    b = sum(np.frombuffer(r["b"]) for r in sums)
    ridge = PENALTY * facts["n"] * np.eye(FEATURES + 1) / FEATURES
    ridge[-1, -1] = 0
    model.weights = np.linalg.lstsq(a + ridge, b, rcond=None)[0]
    pairs = rest.select("x", "y").toPandas()  # a fifth of `most` rows at most
    if pairs["y"].nunique() == 2:
        raw = model.features(np.vstack(pairs["x"])) @ model.weights
        model.steps, model.levels = isotonic(raw, pairs["y"].to_numpy(float))
    else:
        model.steps, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted. A null text counts as empty and has a score.

    A null id counts as not held out. Nothing but the text enters a score. Repeated rows are scored each, very long texts
    as a whole; other columns are ignored, and an empty table gives an empty result.
    """

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(np.concatenate([model.score(s[i : i + 1000]) for i in range(0, len(s), 1000)] or [np.zeros(0)]))

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), score(whole(text_col)).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))
