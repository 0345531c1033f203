"""A corpus pipeline of five of the operators in granary.llm: documents in, piece ids out.

Each stage works on all that its predecessor kept; its result is written as Parquet to the shared folder and read
again, so a lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm.common import kept_table, table
from granary.llm.exact_dedup import distinct_documents
from granary.llm.mixing import mixed_documents
from granary.llm.ngram_join import one_of_each_component
from granary.llm.pieces import encode_documents
from granary.llm.queries import tokenizer_file
from granary.llm.toxicity import fit_toxicity, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose probability of being toxic is 0.5 or more."""
    return without_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row of the largest doc_id."""
    return distinct_documents(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that reach each other by links of 0.8 or more over five-word shingles, the smallest doc_id."""
    return one_of_each_component(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice."""
    return mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids, exact of each document of the mix."""
    return encode_documents(docs, tokenizer_file())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("ngram_join", near_dedup), ("mix_sources", mix), ("pieces", pieces)]

#: The regression, the rounding and the segmentation have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
