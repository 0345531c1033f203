"""Readers: JSON lines in three strictnesses, documents, TSV, gzip, globs, shards and fallbacks.

A file's order matters to some operators ("first wins"), and Spark has none: `with_seq` adds an order at ingest, from
file name and position. A stored id is better where there is one.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def jsonl(spark: SparkSession, path: str | list[str], schema: str, mode: str = "strict") -> DataFrame:
    """mode: "strict" (a bad line fails the read), "drop" (bad lines go), "keep" (they stay, in column _corrupt_record).

    Blank lines are skipped, gzip files are read as they are, path may be a glob or a list.
    """
    if mode == "strict":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    # Lines are parsed by an expression, so that dropping or counting bad ones doesn't depend on which columns are used.
    lines = spark.read.text(path).filter("trim(value) <> ''")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    rows = lines.select(F.from_json("value", f"{schema}, _corrupt_record STRING", options).alias("r")).select("r.*")
    return rows if mode == "keep" else rows.filter("_corrupt_record is null").drop("_corrupt_record")


def bad_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """How many lines of each file don't parse."""
    rows = jsonl(spark, path, schema, "keep").select(F.col("_corrupt_record").isNotNull().alias("bad"), F.input_file_name().alias("file"))
    return rows.groupBy("file").agg(F.count_if("bad").alias("bad"), F.count(F.lit(1)).alias("lines"))


def converted(spark: SparkSession, path: str, schema: str, convert: Callable[[DataFrame], DataFrame], required: str = "response") -> DataFrame:
    """Rows that parse and convert; a row whose required field comes out null goes."""
    return convert(jsonl(spark, path, schema, "drop")).filter(F.col(required).isNotNull())


def with_seq(df: DataFrame, seq: str = "seq") -> DataFrame:
    return df.withColumn(seq, F.monotonically_increasing_id())


def checkpoints(spark: SparkSession, glob: str, schema: str, key: Column, seq: str = "seq") -> DataFrame:
    """All files of a glob, of which later ones repeat the rows of earlier ones: the first row of each key."""
    from granary.operators.dedup import first_of_key

    return first_of_key(with_seq(jsonl(spark, glob, schema, "drop"), seq), key, seq)


def first_rows(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    return df.orderBy(seq).limit(n)


def quota_rows(df: DataFrame, key: Column, quotas: dict[str, int], seq: str = "seq") -> DataFrame:
    """The first rows of each class, so many as its quota says."""
    from granary.operators.sampling import first_n_per

    got = first_n_per(df.withColumn("_class", key).filter(F.col("_class").isin(*quotas)).withColumn("_s", F.col(seq)), max(quotas.values()), ["_class"], "_s")
    rank = F.row_number().over(Window.partitionBy("_class").orderBy("_s"))
    bound = F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col("_class"))
    return got.withColumn("_rn", rank).filter(F.col("_rn") <= bound).drop("_class", "_s", "_rn")


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _readable(spark: SparkSession, path: str, read: Callable[[str], DataFrame]) -> DataFrame | None:
    """What `read` gives of the path, or None if that is not there or fails somewhere.

    Spark reads late, so a failure in the middle of a file shows only in a pass over all of it, whose rows go nowhere.
    """
    if not _exists(spark, path):
        return None
    try:
        rows = read(path)
        rows.write.format("noop").mode("overwrite").save()
    except (PySparkException, Py4JJavaError):
        return None
    return rows


def first_available(spark: SparkSession, *sources: tuple[str, str], read: Callable[[str], DataFrame]) -> tuple[str, DataFrame]:
    """(name, rows) of the first source (name, path) that is there and can be read to its end."""
    for name, path in sources:
        rows = _readable(spark, path, read)
        if rows is not None:
            return name, rows
    raise FileNotFoundError(", ".join(p for _, p in sources))


def shards(spark: SparkSession, paths: dict[str, str], read: Callable[[str], DataFrame], tag: str = "subject") -> DataFrame:
    """Rows of all shards that are there and can be read to their end, each tagged with its name."""
    tried = [(name, _readable(spark, p, read)) for name, p in sorted(paths.items())]
    found = [rows.withColumn(tag, F.lit(name)) for name, rows in tried if rows is not None]
    if not found:
        raise FileNotFoundError(", ".join(paths.values()))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def env_file(text: str) -> dict[str, str]:
    """KEY=value lines; blank lines, comments and lines without = are skipped."""
    pairs = (line.split("=", 1) for line in map(str.strip, text.splitlines()) if line and not line.startswith("#") and "=" in line)
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}
