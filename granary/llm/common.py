"""What the operators of this subpackage share: table loading and tables kept in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(col: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. In local mode one of our own where the session names none; elsewhere that
    is an error, as executors would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="granary-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here, and a lost executor costs one read.

    The size of the written files is known to the optimizer, which can then broadcast a small table on its own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/granary/{name}-{uuid.uuid4().hex}"
    # Shuffle files of this execution go when it ends instead of when the driver happens to collect its garbage.
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def free(*tables: DataFrame) -> None:
    """Deletes tables of kept_table that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.kept_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def packed(docs: DataFrame, **named: str) -> DataFrame:
    """One column `row` with all columns of docs, and a copy of each column that `named` gives under the name wanted.

    Columns of docs are taken by place, so no name of theirs can clash with those of an operator.
    """
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.select(F.struct("*").alias("row"), *(F.col(f"c{docs.columns.index(c)}").alias(name) for name, c in named.items()))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from the column `row` of packed()."""
    return rows.select("row.*").toDF(*docs.columns)


def id_text(col: str) -> Column:
    """An id as text, for the way through pandas: there a null would turn a batch of numbers into floats."""
    return F.col(col).cast("string")


def few(parts: Iterator[pd.DataFrame], rows: int = 400) -> Iterator[pd.DataFrame]:
    """Arrow's batches in pieces of so many rows, so that what is made of them is small at any time."""
    for p in parts:
        for at in range(0, len(p), rows):
            yield p.iloc[at : at + rows]


#: What this Python worker keeps from one task to the next, by name.
_kept_here: dict[str, Any] = {}


def give_back() -> None:
    """Memory that Python and Arrow have freed but hold on to goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def kept_here(name: str, make: Callable[[], Any] | None = None) -> Any:
    """What the worker keeps under `name`, made on first use. All that is kept under other names goes.

    Workers serve the tasks of all operators in turn, so tables that one operator bounds would otherwise add up with
    those of the others.
    """
    if _kept_here.keys() - {name}:
        for other in _kept_here.keys() - {name}:
            del _kept_here[other]
        gc.collect()
        give_back()
    if make and name not in _kept_here:
        _kept_here[name] = make()
    return _kept_here.get(name)


def frugal(work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """work for mapInPandas, in a worker that keeps nothing before it and nothing after it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept_here("")
        try:
            yield from work(parts)
        finally:
            give_back()

    return run


#: Bits of the map of ids by which rows are sifted: 2^26 bits are 2048 rows of 4 KB (MAP_BYTES), whatever the input.
SIFT_BITS, MAP_BYTES = 1 << 26, 4096


def sift(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of df that may have one of the ids of the one-column table `ids`: all that have, and few others.

    A map of hashed ids of fixed size is broadcast, so rows are dropped before they are moved for the exact join that
    must follow. With very many ids the map fills up and drops less.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SIFT_BITS))
    maps = ids.select(place(F.col(ids.columns[0])).alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_sift_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_sift_map"))
    bit = F.bitmap_bit_position(place(F.col(id_col)))
    byte = F.conv(F.hex(F.substring("_sift_map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    # Rows for empty parts too, so that what is broadcast has one size for all inputs.
    every = df.sparkSession.range(SIFT_BITS // (8 * MAP_BYTES) + 1).select(F.col("id").alias("_sift_bucket"))
    maps = every.join(maps, "_sift_bucket", "left").withColumn("_sift_map", F.coalesce("_sift_map", F.unhex(F.repeat(F.lit("00"), MAP_BYTES))))
    met = df.join(F.broadcast(maps), F.bitmap_bucket_number(place(F.col(id_col))) == F.col("_sift_bucket"))
    return met.filter(byte.bitwiseAND(F.expr("cast(1 as int)") * F.pow(F.lit(2), F.pmod(bit, F.lit(8))).cast("int")) != 0).drop("_sift_bucket", "_sift_map")


def map_runs(df: DataFrame, keys: list[str], order: list[str], work: Callable[[list[tuple]], list[tuple]], schema: str, dealt: bool = False) -> DataFrame:
    """work(rows) for each group of rows with equal keys; rows are tuples of df's other columns, sorted by `order`.

    Groups come as sorted runs in a stream, so a task holds one group at a time, and many small groups cost little.
    Callers bound the size of a group. dealt: df is partitioned by the keys already.
    """
    others = [c for c in df.columns if c not in keys]
    names = [x.split()[0] for x in schema.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for p in parts:
            out: list[tuple] = []
            for k, row in zip(zip(*(p[c] for c in keys)), zip(*(p[c] for c in others))):
                if k != key:
                    if held:
                        out.extend(work(held))
                    key, held = k, []
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(work(held) if held else [], columns=names)

    return (df if dealt else df.repartition(*keys)).sortWithinPartitions(*keys, *order).mapInPandas(frugal(run), schema)
