"""A bounded sample of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import kept_table, whole


def held_out(id_col: str) -> Column:
    """The fold that is never learned from: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y, part) of at most `most` labelled documents outside the held-out fold, chosen by a hash of the id.

    The labels that are joined are at most `most` rows, which is what makes their broadcast safe at any input size;
    the texts stay where they are. part: a fifth of the rows has 0, for calibration.
    """
    usable = labels.select(F.col(id_col).cast("bigint").alias("_id"), F.col(label_col).cast("int").alias("y")).filter("_id is not null and y is not null")
    usable = usable.filter(~held_out("_id")).groupBy("_id").agg(F.max("y").alias("y"))
    sample = usable.orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), whole(text_col).alias("text")).join(F.broadcast(sample), "_id")
    return kept_table(rows.select("text", "y", F.pmod(F.xxhash64("_id"), F.lit(5)).cast("int").alias("part")), f"train-{label_col}")
