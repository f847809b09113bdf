"""De-duplication, latest-of, coverage, batching and paging. Ties always have a rule of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.tables import settled


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def keep_best(df: DataFrame, key: str, score: str, pos: str) -> DataFrame:
    """Each key's row of the highest score (first position on ties); rows without a key all stay."""
    w = Window.partitionBy(key).orderBy(F.desc(score), F.asc(pos))
    keyed = df.filter(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return keyed.unionByName(df.filter(F.col(key).isNull()))


def latest(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each key's value at the largest order; an aggregation, so no sort and no skew."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def ordered_distinct(df: DataFrame, keys: list[str], value: str, pos: str, fold: Column | None = None) -> DataFrame:
    """keys and the list of their values in order of first occurrence; values equal under fold count once."""
    once = df.filter(F.col(value).isNotNull()).groupBy(*keys, (fold if fold is not None else F.col(value)).alias("_fold"))
    firsts = once.agg(F.min(F.struct(pos, value)).alias("_first"))
    listed = firsts.groupBy(*keys).agg(F.array_sort(F.collect_list("_first")).alias("_list"))
    return listed.select(*keys, F.transform("_list", lambda x: x[value]).alias(f"{value}s"))


def last_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def numbered(df: DataFrame, key: str | list[str], order: list[Column], name: str = "number") -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def places(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """df with name: 1, 2, 3 ... within each key, in order, without a task for a key.

    Rows are dealt out by ranges of (keys, order), so a key with a third of all rows has a third of the ranges; each range
    is numbered by itself, after the rows of its keys that lie in ranges before it. The ranges are written to the shared folder first,
    since a second shuffle would draw other ones.
    """
    sorts = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    by = [f"_o{i}" for i in range(len(order))]
    held = df.select("*", F.struct(*keys).alias("_k"), *sorts)
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = settled(held.repartitionByRange(ranges, "_k", *by).withColumn("_range", F.spark_partition_id()))
    sizes = held.groupBy("_k", "_range").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.partitionBy("_k").orderBy("_range")) - F.col("_size")).drop("_size")
    within = F.row_number().over(Window.partitionBy("_k", "_range").orderBy(*by))
    return held.join(before, ["_k", "_range"]).withColumn(name, within + F.col("_before")).select(*df.columns, name)


def item_ids(df: DataFrame, key: str, kind: str, order: list[Column], prefixes: dict[str, str]) -> DataFrame:
    """Ids such as A001, counted for each key and kind."""
    prefix = F.coalesce(*[F.when(F.col(kind) == k, p) for k, p in prefixes.items()])
    # lpad would cut numbers of more than three digits
    digits = F.col("_n").cast("string")
    return places(df, [key, kind], order, "_n").withColumn("item_id", F.concat(prefix, F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), F.lit("0")))).drop("_n")


def batches(df: DataFrame, key: str, order: list[Column], size: int) -> DataFrame:
    """Batch numbers of `size` rows each within every key."""
    return places(df, [key], order, "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def page(df: DataFrame, *order: Column, skip: int = 0, limit: int = 20, most: int = 100) -> DataFrame:
    return df.orderBy(*order).offset(max(0, skip)).limit(max(0, min(limit, most)))


def coverage(placed: DataFrame, known: DataFrame, key: str, bucket: str, pos: str, order: dict[str, int], rest: str) -> DataFrame:
    """Every known key once: where it was placed first (buckets in `order`, then pos), the others in `rest`.

    Keys that are not known are dropped. Columns: key, bucket, repaired.
    """
    rank = F.coalesce(*[F.when(F.col(bucket) == b, n) for b, n in order.items()], F.lit(len(order)))
    first = placed.groupBy(key).agg(F.min(F.struct(rank.alias("r"), F.col(pos).alias("p"), F.col(bucket).alias("b"))).alias("f"))
    out = known.select(key).distinct().join(first, key, "left")
    return out.select(key, F.coalesce("f.b", F.lit(rest)).alias(bucket), F.col("f").isNull().alias("repaired"))


def append_or_reset(df: DataFrame, key: str, seq: str, reset: Column) -> DataFrame:
    """The rows after each key's last reset."""
    last = F.max(F.when(reset, F.col(seq))).over(Window.partitionBy(key))
    marked = df.withColumns({"_last": last, "_reset": reset})
    return marked.filter(~F.col("_reset") & (F.col("_last").isNull() | (F.col(seq) > F.col("_last")))).drop("_last", "_reset")


def keep_non_null(df: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """Each key's last value that is not null."""
    at = F.when(F.col(value).isNotNull(), F.col(seq))
    return df.groupBy(key).agg(F.max_by(value, at).alias(value))


def max_merge(df: DataFrame, key: str, counter: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(counter).alias(counter))


def first_capped(df: DataFrame, step: str, seq: str, cap: int) -> DataFrame:
    """The first step (by name) with at least `cap` failures, and its last error."""
    counted = df.groupBy(step).agg(F.count("*").alias("failures"), F.max_by("error", seq).alias("last_error"))
    return counted.filter(F.col("failures") >= cap).orderBy(step).limit(1)
