"""Writers: JSON lines, routed and partitioned output, splits with a backup, reports and documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import ascii_json


def jsonl(df: DataFrame, path: str, mode: str = "overwrite", ascii: bool = False) -> None:
    """Null fields left out; raw UTF-8, or what is not ASCII as escapes."""
    if ascii:
        df.select(ascii_json(F.to_json(F.struct("*"))).alias("value")).write.mode(mode).text(path)
    else:
        df.write.mode(mode).json(path)


def routed(df: DataFrame, path: str, *keys: str, mode: str = "append") -> None:
    """A folder for each value of the keys, such as domain and difficulty."""
    df.write.mode(mode).partitionBy(*keys).json(path)


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copies a file or folder inside the store that holds it."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    a, b = hadoop.Path(source), hadoop.Path(target)
    hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)


def split(df: DataFrame, is_test: Column, train: str, test: str, original: str | None = None, backup: str | None = None) -> None:
    """Train and test rows to two paths, neither of them the input's, after a copy of the original if a backup is named."""
    if original and backup:
        copy(df.sparkSession, original, backup)
    df.filter(is_test).write.mode("overwrite").json(test)
    df.filter(~is_test).write.mode("overwrite").json(train)


def document(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON document (metrics, manifest, split statistics, checkpoint) in the store that the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    out.close()


def row_document(df: DataFrame, path: str) -> None:
    """The one row of df as a JSON document."""
    document(df.sparkSession, df.first().asDict(recursive=True), path)


def ledger(done: DataFrame, path: str, key: str) -> None:
    """Appends completed keys to the ledger."""
    done.select(key).distinct().write.mode("append").parquet(path)


def size_bytes(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def report(df: DataFrame, rows: int = 50) -> str:
    """A table as text, for consoles."""
    return df.limit(rows).toPandas().to_string(index=False)


def size_report(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.createDataFrame([(p, size_bytes(spark, p)) for p in paths], "path string, bytes bigint").withColumn("mb", F.round(F.col("bytes") / 1e6, 2))
