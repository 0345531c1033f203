"""Incremental processing: files in, micro-batches with a ledger of completed keys, exact dedup across batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from granary.operators.dedup import first_of_key


def files(spark: SparkSession, folder: str, schema: StructType | str, kind: str = "parquet", per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(kind).load(folder)


def process_pending(stream: DataFrame, work: Callable[[DataFrame], DataFrame], key: Column, seq: str, out: str, ledger: str, checkpoint: str, earlier: bool = False) -> StreamingQuery:
    """Each micro-batch: the first rows of keys that the ledger has not are worked on and written to out/batch=N, and only
    then do their keys enter ledger/batch=N.

    A batch that is run again after a failure overwrites its own folders and doesn't see its own ledger entries, so no
    row is lost or written twice. Null and empty keys count as duplicates.

    Batches come in any order of seq. earlier: a row of less seq than those of its key so far is worked on too, so the
    row of least seq of all batches is in out, beside others of its key that it overtook.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = first_of_key(batch.withColumn("_key", key), F.col("_key"), seq)
        done = _ledger_before(spark, ledger, n, batch.select(F.col(seq).alias("_seq")).schema)
        if done is not None:
            known = rows["_key"] == done["_key"]
            if earlier:
                known &= done["_seq"].isNull() | (done["_seq"] <= rows[seq])
            rows = rows.join(done, known, "left_anti")
        rows = rows.persist()
        try:
            work(rows.drop("_key")).write.mode("overwrite").parquet(f"{out}/batch={n}")
            rows.select("_key", F.col(seq).alias("_seq")).write.mode("overwrite").parquet(f"{ledger}/batch={n}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _ledger_before(spark: SparkSession, path: str, n: int, seq: StructType) -> DataFrame | None:
    """Keys and the _seq of their rows, null in ledgers that were written without."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    kept = StructType([StructField("_key", StringType()), *seq.fields, StructField("batch", IntegerType())])
    return spark.read.option("basePath", path).schema(kept).parquet(path).filter(F.col("batch") < n).drop("batch")


def distinct_stream(stream: DataFrame, key: Column, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """First row of each key. Exact, with a state of all keys; with an event time, state is bounded by the delay, and a
    copy that comes later than that passes."""
    rows = stream.withColumn("_key", key).filter("_key <> ''")
    if event_time:
        return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
    return rows.dropDuplicates(["_key"]).drop("_key")


def windowed_counts(stream: DataFrame, event_time: str, key: str, width: str = "1 hour", delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts by window and key with a watermark; works on tables too."""
    window = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    return stream.withWatermark(event_time, delay).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(stream: DataFrame, event_time: str, key: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(event_time, delay).groupBy(F.session_window(event_time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
