"""Rate limits, caches, memories and counters: batch forms and their Structured Streaming twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from docmill.functions import vectors
from docmill.workers import ship


def rate_limited(events: DataFrame, key: str, ts: str, seq: str, limit: int = 100, seconds: int = 60) -> DataFrame:
    """Events with window_start, n (its number in the window) and allowed.

    A key's window begins at its first event and lasts `seconds`; the next event after it begins
    another. Events are sorted by (key, ts, seq) within partitions by key and folded as they stream
    past, so a key of any number of events needs the memory of one batch.
    """
    ship(events.sparkSession)
    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in events.schema)}, window_start timestamp, n bigint, allowed boolean"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, n = object(), None, 0
        for pdf in batches:
            starts, ns = [], []
            for k, t in zip(pdf[key], pdf[ts]):
                if k != now or (t - start).total_seconds() >= seconds:
                    now, start, n = k, t, 0
                n += 1
                starts.append(start)
                ns.append(n)
            yield pdf.assign(window_start=starts, n=ns, allowed=[x <= limit for x in ns])

    return events.repartition(key).sortWithinPartitions(key, ts, seq).mapInPandas(fold, out)


def ttl_hits(events: DataFrame, key: list[str], ts: str, seq: str, seconds: int) -> DataFrame:
    """Events with hit: the same key was seen at most `seconds` (exclusive) before."""
    w = Window.partitionBy(*key).orderBy(ts, seq)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    age = at - F.lag(at).over(w)
    return events.withColumn("hit", F.coalesce(age < seconds * 1_000_000, F.lit(False)))


def semantic_hits(probes: DataFrame, cached: DataFrame, prefix: str, probe_id: str, cache_id: str, seq: str, threshold: float = 0.97, keep: int = 500) -> DataFrame:
    """probe_id, cache_id, similarity: the nearest of a prefix's last `keep` cached vectors, if near enough.

    Both have the prefix and a unit vector `v`; of equally near ones the one cached first wins.
    """
    w = Window.partitionBy(prefix).orderBy(F.desc(seq))
    held = cached.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep).select(prefix, cache_id, seq, F.col("v").alias("_v"))
    near = probes.join(held, prefix).withColumn("similarity", F.round(vectors.dot(F.col("v"), F.col("_v")), 6)).filter(F.col("similarity") >= threshold)
    best = near.groupBy(probe_id).agg(F.max_by(F.struct(cache_id, "similarity"), F.struct("similarity", (-F.col(seq)).alias("s"))).alias("_b"))
    return best.select(probe_id, f"_b.{cache_id}", "_b.similarity")


def counters(turns: DataFrame, key: str, order: str, every: int = 20, per_turn: int = 2) -> DataFrame:
    """Turns with turn_count, messages_since_summary and summarize: each `every` messages the counter starts anew."""
    w = Window.partitionBy(key).orderBy(order)
    n = F.row_number().over(w)
    period = -(-every // per_turn)
    since = ((n - 1) % period + 1) * per_turn
    return turns.withColumns({"turn_count": n, "messages_since_summary": F.when(since >= every, 0).otherwise(since), "summarize": since >= every})


def counter_fold(sizes: Column, every: int) -> Column:
    """The same for steps of any size: positions (from 1) at which the running sum reaches `every` and is reset."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits"))

    def step(acc: Column, n: Column) -> Column:
        total, at = acc["sum"] + n, acc["at"] + 1
        full = total >= every
        return F.struct(F.when(full, 0).otherwise(total).alias("sum"), at.alias("at"), F.when(full, F.concat(acc["hits"], F.array(at))).otherwise(acc["hits"]).alias("hits"))

    return F.aggregate(sizes, start, step, lambda acc: acc["hits"])


def messages(turns: DataFrame, keep: list[str], query: str, response: str) -> DataFrame:
    """A turn as two messages, the user's first."""
    pair = F.array(F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col(query).alias("content")), F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col(response).alias("content")))
    return turns.select(*keep, F.inline(pair))


def windowed_counts(stream: DataFrame, ts: str, kind: str, value: str, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """[extension] Tumbling counts and sums of a stream; events later than the watermark are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sliding_counts(stream: DataFrame, ts: str, kind: str, value: str, size: str, slide: str, late: str = "10 minutes") -> DataFrame:
    """[extension] Counts and sums over overlapping windows; an event is in size / slide of them, late ones in none."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size, slide), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def deduplicated(stream: DataFrame, key: list[str], ts: str, within: str) -> DataFrame:
    """[extension] The first event of each key; repeats that come within that time are dropped, and the key is then forgotten."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(key)
