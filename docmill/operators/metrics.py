"""Counts and latencies that are stored by period and label and merged over any span of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds in seconds of the usual latency histogram.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
ERROR = 0.01
LEAST = 1e-9


def histogram(rows: DataFrame, labels: list[str], value: str, bounds: tuple[float, ...] = LATENCY_BOUNDS) -> DataFrame:
    """labels, le, n, sum: how many values are at most le (the last le is infinite), and the sum of all; nulls aren't counted."""
    counts = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    made = rows.groupBy(*labels).agg(*counts, F.count(value).alias("_all"), F.sum(value).alias("sum"))
    each = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)]
    each.append(F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("n")))
    return made.select(*labels, F.inline(F.array(*each)), "sum")


def _ratio(error: float) -> float:
    return (1 + error) / (1 - error)


def sketch(rows: DataFrame, labels: list[str], value: str, who: str | None = None, error: float = ERROR) -> tuple[DataFrame, DataFrame | None]:
    """Mergeable sketches: (labels, bucket, n), and (labels, seen) for the different values of `who`.

    Bucket i holds the values of (r^(i-1), r^i], r = (1 + error) / (1 - error), so whatever is in it is within `error` of its
    middle; values up to 1e-9 (zero and negative ones too) share one bucket, nulls are left out. Merging adds up counts.
    A label has some hundred buckets for any number of rows. `seen` is a HyperLogLog sketch.
    """
    small = F.col(value) <= LEAST
    bucket = F.when(small, F.lit(-(1 << 31))).otherwise(F.ceil(F.ln(F.when(~small, F.col(value))) / math.log(_ratio(error))).cast("long"))
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*labels, bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    return counts, rows.groupBy(*labels).agg(F.hll_sketch_agg(who, 14).alias("seen")) if who else None


def middle(bucket: Column, error: float = ERROR) -> Column:
    r = _ratio(error)
    return F.when(bucket == -(1 << 31), 0.0).otherwise(2 * F.pow(F.lit(r), bucket) / (r + 1))


def quantiles(sketches: DataFrame, labels: list[str], shares: tuple[float, ...], error: float = ERROR) -> DataFrame:
    """labels, share, value, n of sketches merged over everything but the labels; value is within `error` of the exact quantile
    (the ceil(share * n)-th smallest value). Buckets are few, so a label's are sorted as one array."""
    merged = sketches.groupBy(*labels, "bucket").agg(F.sum("n").alias("n"))
    listed = merged.groupBy(*labels).agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("_b"), F.sum("n").alias("n"))
    each = listed.select(*labels, "_b", "n", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    wanted = F.greatest(F.ceil(F.col("share") * F.col("n") - 1e-9), F.lit(1)).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("at"))

    def step(acc: Column, b: Column) -> Column:
        total = acc["sum"] + b["n"]
        return F.struct(total.alias("sum"), F.coalesce(acc["at"], F.when(total >= F.col("_w"), b["bucket"])).alias("at"))

    at = F.aggregate("_b", start, step, lambda acc: acc["at"])
    return each.withColumn("_w", wanted).select(*labels, "share", middle(at, error).alias("value"), "n")


def distinct(seen: DataFrame, labels: list[str]) -> DataFrame:
    """labels, n: different values over merged sketches."""
    return seen.groupBy(*labels).agg(F.hll_sketch_estimate(F.hll_union_agg("seen")).alias("n"))
