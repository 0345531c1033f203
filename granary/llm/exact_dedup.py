"""Exact dedup: groups by a 128-bit content hash and, inside a hash, by the bytes themselves.

Plan. One row per distinct text comes from an aggregation on (md5, text): map-side combining folds a hot group of
copies to one row per input partition before the shuffle, and the text in the grouping key is the byte comparison
that keeps colliding hashes apart. Verdicts go back to the documents by a join on the 128-bit hash and SHA-256,
which moves 48 bytes a row instead of the text. The join's keys differ from the aggregation's, so both sides are
exchanged for the join, and adaptive execution can split a hot key's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import whole


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "min" or "max", the id that stays in a group of equal texts. A null text counts as empty. A null id stays
    only in a group whose ids are all null. Rows that repeat an id and text share its verdict: a row that repeats the
    kept one is marked kept as well, where distinct_documents returns one of the two. An empty table gives
    an empty result; other columns, whatever their names, are ignored.
    """
    choose = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_t"))
    digest = lambda: (F.unhex(F.md5("_t")).alias("_h"), F.unhex(F.sha2("_t", 256)).alias("_s"))
    groups = (
        rows.groupBy(F.unhex(F.md5("_t")).alias("_h"), "_t")
        .agg(choose("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_h", F.unhex(F.sha2("_t", 256)).alias("_s"), "keep_id", "group_size")
    )
    return (
        rows.select("_id", *digest())
        .join(groups, ["_h", "_s"])
        .select(
            F.col("_id").alias("doc_id"),
            "keep_id",
            "group_size",
            F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("_s")).alias("text_sha256"),
        )
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs whose text is the first of its kind by id (or the last, keep="max"), with all their columns.

    One shuffle: the row that stays is an aggregate beside the text, so no join is needed. A null text counts as
    empty in comparing, and comes back as it was. Of rows with equal text and id, one stays (the least or greatest by
    the other columns). A row without an id stays only where no equal text has one. Columns may have any names and types; maps, which have no
    order, are compared by their text.
    """
    of_text, of_id = docs.columns.index(text_col), docs.columns.index(id_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    others = [i for i in range(len(docs.columns)) if i not in (of_id, of_text)]
    unordered = [i for i, field in enumerate(docs.schema) if "map<" in field.dataType.simpleString() or field.dataType.simpleString() == "variant"]
    lead = F.col(f"c{of_id}").isNull() if keep == "min" else F.col(f"c{of_id}").isNotNull()
    body = F.struct(lead.alias("lead"), F.col(f"c{of_id}"), *(F.col(f"c{i}") for i in others), F.col(f"c{of_text}").isNull().alias("null_text"))
    order = F.struct(lead, *(F.col(f"c{i}").cast("string") if i in unordered else F.col(f"c{i}") for i in (of_id, *others)))
    choose = {"min": (F.min, F.min_by), "max": (F.max, F.max_by)}[keep]
    best = choose[1]("row", "order") if unordered else choose[0]("row")
    rows = plain.select(whole(f"c{of_text}").alias("text"), body.alias("row"), order.alias("order"))
    groups = rows.groupBy(F.unhex(F.md5("text")).alias("hash"), "text").agg(best.alias("row"))
    back = [F.when(~F.col("row.null_text"), F.col("text")) if i == of_text else F.col(f"row.c{i}") for i in range(len(docs.columns))]
    return groups.select(*(c.alias(f"c{i}") for i, c in enumerate(back))).toDF(*docs.columns)
