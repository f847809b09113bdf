"""Caches that answer while requests come in, and work that is put off until a key is quiet: streams with their batch twins.

The streams keep state by key in transformWithState. Time is the requests' own: a state is cleared by
an event-time timer once nothing that is not late can need it, so the state is bounded by the keys
of the last `seconds` before the watermark. Within a micro-batch a key's requests are taken in the order
(ts, seq); a request that is later than the watermark is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docmill.functions import vectors
from docmill.workers import ship

GET, SET, CLEAR = "get", "set", "clear"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ready(spark: SparkSession) -> None:
    """State with timers needs Spark's RocksDB store; it is chosen for the session."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _millis(ts: Any) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


def _micros(ts: Any) -> int:
    return int(pd.Timestamp(ts).value // 1_000)


class _Timed(StatefulProcessor):
    """One timer for each key, put off with every change."""

    def _put_off(self, until: int) -> None:
        for t in list(self.handle.listTimers()):
            if t == until:
                return
            self.handle.deleteTimer(t)
        self.handle.registerTimer(until)

    def _no_timer(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def close(self) -> None:
        pass


# -- response and title cache ---------------------------------------------------------------------


def reads(requests: DataFrame, key: list[str], ts: str, seq: str, op: str, value: str, seconds: int) -> DataFrame:
    """The requests of op get with found: what the key was set to last, if less than `seconds` ago and not cleared since; else null.

    A window by key; requests of one key that make a hot task are as many as its history.
    """
    w = Window.partitionBy(*key).orderBy(ts, seq).rowsBetween(Window.unboundedPreceding, -1)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    change = F.when(F.col(op).isin(SET, CLEAR), F.struct(F.col(op).alias("op"), F.col(value).alias("value"), at.alias("at")))
    last = F.last(change, ignorenulls=True).over(w)
    fresh = (F.col("_last.op") == SET) & (at - F.col("_last.at") < seconds * 1_000_000)
    return requests.withColumn("_last", last).filter(F.col(op) == GET).withColumn("found", F.when(fresh, F.col("_last.value"))).drop("_last")


class _Responses(_Timed):
    def __init__(self, key: list[str], ts: str, seq: str, op: str, value: str, seconds: int):
        self.key, self.ts, self.seq, self.op, self.value, self.seconds = key, ts, seq, op, value, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.entry.get() if self.entry.exists() else None
        before, answers = held, []
        asked = pd.concat(list(rows)).sort_values([self.ts, self.seq])
        for r in asked.itertuples(index=False):
            at, op = _micros(getattr(r, self.ts)), getattr(r, self.op)
            if op == SET:
                held = (getattr(r, self.value), at)
            elif op == CLEAR:
                held = None
            elif op == GET:
                fresh = held is not None and at - held[1] < self.seconds * 1_000_000
                answers.append((*key, getattr(r, self.ts), getattr(r, self.seq), held[0] if fresh else None))
        if held is None:
            self.entry.clear()
            self._no_timer()
        elif held != before:
            self.entry.update(held)
            self._put_off(held[1] // 1000 + self.seconds * 1000 + 1)
        yield pd.DataFrame(answers, columns=[*self.key, self.ts, self.seq, "found"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entry.clear()
        return iter([])


def _schema(df: DataFrame, names: list[str], more: str) -> str:
    return ", ".join([*[f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names], more])


def reads_stream(requests: DataFrame, key: list[str], ts: str, seq: str, op: str, value: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """key, ts, seq, found of a stream's gets: reads() with one value (a string) and one timer for each key that is alive."""
    _ready(requests.sparkSession)
    keyed = requests.withWatermark(ts, late).withColumn(value, F.col(value).cast("string")).groupBy(*key)
    out = _schema(requests, [*key, ts, seq], "found string")
    return keyed.transformWithStateInPandas(_Responses(key, ts, seq, op, value, seconds), out, "append", "EventTime")


# -- rate limits ----------------------------------------------------------------------------------


class _Limited(_Timed):
    def __init__(self, key: str, ts: str, limit: int, seconds: int):
        self.key, self.ts, self.limit, self.seconds = key, ts, limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start bigint, n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, n = self.window.get() if self.window.exists() else (None, 0)
        out = []
        for t in pd.concat([part[[self.ts]] for part in rows])[self.ts].sort_values():
            at = _micros(t)
            if start is None or at - start >= self.seconds * 1_000_000:
                start, n = at, 0
            n += 1
            out.append((*key, t, n, n <= self.limit))
        self.window.update((start, n))
        self._put_off(start // 1000 + self.seconds * 1000 + 1)
        yield pd.DataFrame(out, columns=[self.key, self.ts, "n", "allowed"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter([])


def rate_limited_stream(events: DataFrame, key: str, ts: str, limit: int = 100, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """key, ts, n, allowed of a stream of events: the windows of stateful.rate_limited. A key is forgotten when its window is over."""
    _ready(events.sparkSession)
    keyed = events.withWatermark(ts, late).groupBy(key)
    return keyed.transformWithStateInPandas(_Limited(key, ts, limit, seconds), _schema(events, [key, ts], "n bigint, allowed boolean"), "append", "EventTime")


# -- semantic cache -------------------------------------------------------------------------------


def nearest_reads(requests: DataFrame, prefix: str, seq: str, op: str, vector: str, threshold: float, keep: int = 500) -> DataFrame:
    """seq, found, similarity of the gets: the nearest of the `keep` vectors that the prefix was given last before it, if near enough.

    Vectors are of unit length; found is the seq of the one cached, of equally near ones the first. The n-th entry of a prefix is
    in block n // keep, and a get looks into two blocks at most, so a prefix of any size is many small joins.
    """
    w = Window.partitionBy(prefix).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    counted = requests.select(prefix, seq, op, vector, F.count_if(F.col(op) == SET).over(w).alias("_n"))
    block = lambda n: F.floor(n / keep).cast("long")
    held = counted.filter(F.col(op) == SET).select(prefix, F.col(seq).alias("found"), (F.col("_n") - 1).alias("_i"), F.col(vector).alias("_v")).withColumn("_block", block(F.col("_i")))
    asked = counted.filter((F.col(op) == GET) & (F.col("_n") > 0))
    last = block(F.col("_n") - 1)
    asked = asked.withColumn("_block", F.explode(F.when(last > 0, F.array(last - 1, last)).otherwise(F.array(last))))
    near = asked.join(held, [prefix, "_block"]).filter((F.col("_i") < F.col("_n")) & (F.col("_i") >= F.col("_n") - keep))
    scored = near.withColumn("similarity", F.round(vectors.dot(F.col(vector), F.col("_v")), 6)).filter(F.col("similarity") >= threshold)
    best = scored.groupBy(seq).agg(F.max(F.struct("similarity", (-F.col("_i")).alias("_first"), "found")).alias("_b"))
    return best.select(seq, "_b.found", "_b.similarity")


class _Nearest(StatefulProcessor):
    def __init__(self, seq: str, op: str, vector: str, threshold: float, keep: int):
        self.seq, self.op, self.vector, self.threshold, self.keep = seq, op, vector, threshold, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", "seq bigint, v array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(int(s), np.asarray(v, float)) for s, v in self.entries.get()] if self.entries.exists() else []
        block = np.array([v for _, v in held])
        changed, answers = False, []
        for r in pd.concat(list(rows)).sort_values(self.seq).itertuples(index=False):
            op, v = getattr(r, self.op), np.asarray(getattr(r, self.vector), float)
            if op == CLEAR:
                held, block, changed = [], np.array([]), True
            elif op == SET:
                held = [*held, (int(getattr(r, self.seq)), v)][-self.keep :]
                block, changed = np.array([x for _, x in held]), True
            elif op == GET and held:
                near = np.round(block @ v, 6)
                best = int(near.argmax())  # the first of equally near ones
                if near[best] >= self.threshold:
                    answers.append((getattr(r, self.seq), held[best][0], float(near[best])))
        if changed and held:
            self.entries.put([(s, v.tolist()) for s, v in held])
        elif changed:
            self.entries.clear()
        yield pd.DataFrame(answers, columns=[self.seq, "found", "similarity"])

    def close(self) -> None:
        pass


def nearest_reads_stream(requests: DataFrame, prefix: str, seq: str, op: str, vector: str, threshold: float, keep: int = 500) -> DataFrame:
    """seq, found, similarity of a stream's gets: nearest_reads() with at most `keep` vectors of each prefix in the state, the oldest going first."""
    _ready(requests.sparkSession)
    keyed = requests.withColumn(seq, F.col(seq).cast("long")).withColumn(vector, F.col(vector).cast("array<double>")).groupBy(prefix)
    return keyed.transformWithStateInPandas(_Nearest(seq, op, vector, threshold, keep), f"`{seq}` bigint, found bigint, similarity double", "append", "None")


# -- postponed work -------------------------------------------------------------------------------


class _Postponed(_Timed):
    def __init__(self, key: str, ts: str, seq: str, seconds: int):
        self.key, self.ts, self.seq, self.seconds = key, ts, seq, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint, seq bigint")

    def _told(self, key: tuple, due: list[tuple[int, int]]) -> pd.DataFrame:
        wait = self.seconds * 1_000_000
        return pd.DataFrame([(*key, s, pd.Timestamp((at + wait) * 1000)) for at, s in due], columns=[self.key, self.seq, "due"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        due = []
        for r in pd.concat(list(rows)).sort_values([self.ts, self.seq]).itertuples(index=False):
            now = (_micros(getattr(r, self.ts)), int(getattr(r, self.seq)))
            if held is not None and now < tuple(held):
                continue  # something later of this key has put the work off already
            if held is not None and now[0] - held[0] > self.seconds * 1_000_000:
                due.append(tuple(held))
            held = now
        self.last.update(held)
        self._put_off(held[0] // 1000 + self.seconds * 1000 + 1)
        yield self._told(key, due)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = tuple(self.last.get())
        self.last.clear()
        yield self._told(key, [held])


def postponed_stream(events: DataFrame, key: str, ts: str, seq: str, seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """key, seq, due: the events of a stream after which nothing of the key happened for `seconds`.

    Each event of a key sets its timer anew, which cancels the one before; it fires when the watermark has passed it.
    """
    _ready(events.sparkSession)
    keyed = events.withWatermark(ts, late).withColumn(seq, F.col(seq).cast("long")).groupBy(key)
    return keyed.transformWithStateInPandas(_Postponed(key, ts, seq, seconds), _schema(events, [key], f"`{seq}` bigint, due timestamp"), "append", "EventTime")
