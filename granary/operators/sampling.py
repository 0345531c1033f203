"""Seeded sampling, splits, permutation and batches. A rank is the order of md5(seed:id), so reruns and engines agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: md5's first digits that cut a table in even buckets for a global position.
BUCKET_DIGITS = 3


def shuffle_key(seed: int, *ids: str | Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]))


def simple_sample(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """min(n, rows) rows."""
    return df.orderBy(shuffle_key(seed, id_col), id_col).limit(n)


def first_n(df: DataFrame, n: int, seq: str) -> DataFrame:
    return df.orderBy(seq).limit(n)


def first_n_per(df: DataFrame, n: int, keys: list[str], *order: Column | str) -> DataFrame:
    """At most n rows of each group; the literal bound lets each task drop the rest before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def cap_per(df: DataFrame, n: int, keys: list[str], seed: int, id_col: str) -> DataFrame:
    return first_n_per(df, n, keys, shuffle_key(seed, id_col), id_col)


def quota_per(df: DataFrame, quotas: DataFrame, keys: list[str], most: int, seed: int, id_col: str) -> DataFrame:
    """At most `quota` rows of each group of the table quotas (keys, quota), none of other groups. most: the largest quota."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(shuffle_key(seed, id_col), id_col))).filter(F.col("_rn") <= most)
    return ranked.join(quotas, keys).filter("_rn <= quota").drop("_rn", "quota")


def allocation(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys, size, alloc = min(size, max(1, int(size / N * n))), the division first."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))  # one row
    share = F.floor(F.col("size").cast("double") / F.col("_total") * F.lit(n))
    return per.crossJoin(F.broadcast(total)).select(*keys, "size", F.least("size", F.greatest(F.lit(1).cast("bigint"), share)).alias("alloc"))


def stratified_split(df: DataFrame, keys: list[str], n: int, seed: int, id_col: str) -> DataFrame:
    """df with is_test: alloc rows of each stratum, so about n in all (each stratum has one at least). Keys are not null."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(shuffle_key(seed, id_col), id_col)))
    return ranked.join(allocation(df, keys, n).drop("size"), keys).withColumn("is_test", F.col("_rn") <= F.col("alloc")).drop("_rn", "alloc")


def stratified_sample(df: DataFrame, keys: list[str], n: int, seed: int, id_col: str) -> DataFrame:
    """Exactly min(n, rows) rows: the allocation, topped up by rank from the rest or cut by rank if it is above n.

    Rows that equal a chosen one in all columns but the id are not in the pool to top up from.
    """
    if df.count() <= n:
        return df
    values = [c for c in df.columns if c != id_col]
    split = stratified_split(df, keys, n, seed, id_col).withColumn("_v", F.xxhash64(*[F.col(c) for c in values]))
    chosen = split.filter("is_test")
    pool = split.filter("not is_test").join(chosen.select("_v").distinct(), "_v", "left_anti")
    both = chosen.unionByName(pool.select(*chosen.columns))
    return both.orderBy(F.when(F.col("is_test"), 0).otherwise(1), shuffle_key(seed + 1, id_col), id_col).limit(n).drop("is_test", "_v")


def permuted(df: DataFrame, seed: int, id_col: str, pos: str = "pos") -> DataFrame:
    """df with its position (from 0) in a seeded permutation. Positions come from ranks inside even buckets of the key and the
    buckets' sizes, so no task sees the whole table."""
    keyed = df.withColumn("_k", shuffle_key(seed, id_col)).withColumn("_b", F.left("_k", F.lit(BUCKET_DIGITS)))
    sizes = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_k", id_col)) - 1)
    return ranked.join(F.broadcast(sizes), "_b").withColumn(pos, F.col("_before") + F.col("_r")).drop("_k", "_b", "_r", "_before")  # 16^BUCKET_DIGITS rows at most


def batches(df: DataFrame, size: int, pos: str = "pos", batch: str = "batch") -> DataFrame:
    return df.withColumn(batch, F.floor(F.col(pos) / size).cast("bigint"))


def interleaved(df: DataFrame, keys: list[str], seed: int, id_col: str) -> DataFrame:
    """df with rank in its stratum; ordered by (rank, keys) strata take turns."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(shuffle_key(seed, id_col), id_col)))


def until_target(df: DataFrame, keys: list[str], batch: str, target: int) -> DataFrame:
    """Whole batches of each group in order until the target is reached; the last may overshoot it."""
    per = df.groupBy(*keys, batch).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.join(per.withColumn("_before", before).filter(F.col("_before") < target).select(*keys, batch), [*keys, batch])


def episodes(df: DataFrame, domain: str, tasks: int, support: int, query: int, seed: int, step: int, id_col: str) -> DataFrame:
    """domain, id, role of `tasks` domains drawn for a step, each with disjoint support and query rows.

    Domains of fewer rows than support + query draw with replacement: draw i takes the row of rank hash(seed, step, i) mod n.
    """
    counts = df.groupBy(domain).agg(F.count(F.lit(1)).alias("n"))
    drawn = counts.orderBy(shuffle_key(seed, F.lit(step), F.col(domain)), domain).limit(tasks)
    ranked = df.select(domain, id_col, F.row_number().over(Window.partitionBy(domain).orderBy(shuffle_key(seed, F.lit(step), F.col(id_col)), id_col)).alias("rn")).filter(F.col("rn") <= support + query)
    enough = ranked.join(F.broadcast(drawn.filter(F.col("n") >= support + query)), domain)
    enough = enough.select(domain, id_col, F.when(F.col("rn") <= support, "support").otherwise("query").alias("role"))
    draws = drawn.filter(F.col("n") < support + query).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(support + query))))
    draws = draws.select(domain, "i", (F.pmod(F.conv(F.substring(shuffle_key(seed, F.lit(step), F.col(domain), F.col("i")), 1, 8), 16, 10).cast("bigint"), F.col("n")) + 1).cast("int").alias("rn"))
    few = draws.join(ranked, [domain, "rn"]).select(domain, id_col, F.when(F.col("i") <= support, "support").otherwise("query").alias("role"))
    return enough.unionByName(few)


def mixed_tasks(df: DataFrame, domain: str, kind: Column, mix: dict[str, int], seed: int, id_col: str) -> DataFrame:
    """domain, id, kind, role: one task for each domain, with so many support rows of each kind as `mix` says, and as many others
    for its query. What a domain lacks is lacking in the query first."""
    most = max(mix.values())
    ranked = df.select(domain, F.col(id_col), kind.alias("kind")).withColumn("_rn", F.row_number().over(Window.partitionBy(domain, "kind").orderBy(shuffle_key(seed, id_col), id_col)))
    wanted = F.element_at(F.create_map(*[F.lit(x) for kv in mix.items() for x in kv]), F.col("kind"))
    near = ranked.filter(F.col("_rn") <= 2 * most).filter(F.col("kind").isin(*mix)).filter(F.col("_rn") <= 2 * wanted)
    return near.select(domain, id_col, "kind", F.when(F.col("_rn") <= wanted, "support").otherwise("query").alias("role"))


def steps_per_epoch(rows: int, tasks: int, support: int, query: int) -> int:
    return rows // (tasks * (support + query))


def latest_checkpoint(paths: DataFrame, path: str = "path") -> DataFrame:
    """The path of the largest number after checkpoint-, as a number."""
    step = F.try_to_number(F.regexp_extract(path, r"checkpoint-(\d+)$", 1), F.lit("9999999999")).cast("bigint")
    return paths.filter(step.isNotNull()).agg(F.max_by(path, step).alias(path))
