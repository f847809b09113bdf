"""Language identification by rank-order n-gram profiles and the out-of-place distance.

A profile is the PROFILE most frequent n-grams (1 to 3 characters of lower-cased words, each
word between two blanks) in order of frequency; ties go by the characters' codes. A language's
profile counts the n-grams of all its training texts. A document is compared with each language:
every n-gram of its own profile costs the distance between its two ranks, or PROFILE if the
language lacks it; the language with the least cost wins, ties by name.

Null texts and texts without a letter are `und` with score 0. Rows without a language are not
learned from. Repeated rows count as often as they occur. With nothing to learn from, every
text is `und`. The model (languages x PROFILE numbers) goes through the driver; its size depends
on the number of languages only. Counting sums within each batch and task before it shuffles. Empty tables give
empty results, and columns besides the named ones may have any name. A very long text is counted
whole: some numbers of eight bytes for each of its characters are held at a time.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.workers import ship

PROFILE = 300
#: Documents whose n-grams are held at a time.
SLICE = 200
UNKNOWN = "und"
BLANK, BITS = 0x20, 21


@cache
def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """All n-grams of a text as numbers, repeats included: three code points of 21 bits, the last first filled."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    known = letters()[codes]
    if not known.any():
        return np.empty(0, np.int64)
    codes[~known] = BLANK
    pairs = (codes[:-1] << BITS) | codes[1:]
    threes = (pairs[:-1] << BITS) | codes[2:]
    return np.concatenate([codes[known], pairs[known[:-1] | known[1:]], threes[known[1:-1]]])


def counted(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers in order, and how often each is there."""
    ordered = np.sort(found)
    if not len(ordered):
        return ordered, ordered
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.diff(np.append(first, len(ordered)))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of several counts."""
    values, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    if not len(values):
        return values, n
    order = np.argsort(values, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], values[order][1:] != values[order][:-1]]))
    return values[order][first], np.add.reduceat(n[order], first)


def profile(found: np.ndarray) -> np.ndarray:
    """The PROFILE most frequent numbers, most frequent first, ties by number."""
    values, n = counted(found)
    if len(values) > PROFILE:
        least = np.partition(n, len(n) - PROFILE)[len(n) - PROFILE]
        values, n = values[n >= least], n[n >= least]
    return values[np.argsort(-n, kind="stable")[:PROFILE]]


class Model:
    """Profiles of the languages, as ranks of all the n-grams that any of them has."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.names = sorted(profiles)
        self.known = np.unique(np.concatenate([np.array(profiles[n], np.int64) for n in self.names] or [np.empty(0, np.int64)]))
        self.rank = np.full((len(self.names), len(self.known) + 1), -1, np.int64)
        for row, name in enumerate(self.names):
            self.rank[row, np.searchsorted(self.known, profiles[name])] = np.arange(len(profiles[name]))

    def predict(self, text: str) -> tuple[str, float]:
        """The nearest language and how far the others are behind it, 0 to 1."""
        found = grams(text)
        if not len(found) or not self.names:
            return UNKNOWN, 0.0
        own = profile(found)
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        at = np.where(self.known[at] == own, at, len(self.known))
        ranks = self.rank[:, at]
        cost = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(cost))
        likeness = np.exp(-8.0 * (cost - cost[best]) / (PROFILE * len(own)))
        return self.names[best], float(1.0 / likeness.sum())


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """Each language's profile over all rows with a language."""
    ship(df.sparkSession)

    def counts(batches):
        for batch in batches:
            parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for at in range(0, batch.num_rows, SLICE):
                texts: dict[str, list[str]] = {}
                part = batch.slice(at, SLICE)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    texts.setdefault(lang, []).append(text)
                for lang, held in texts.items():
                    parts.setdefault(lang, []).append(counted(np.concatenate([grams(t) for t in held])))
            for lang, held in parts.items():
                values, n = merged(held)
                if len(values):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    rows = df.filter(F.col(lang_col).isNotNull() & (F.coalesce(text_col, F.lit("")) != "")).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    summed = rows.mapInArrow(counts, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = summed.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= PROFILE)
    profiles: dict[str, list[tuple[int, int]]] = {}
    for row in top.collect():
        profiles.setdefault(row.lang, []).append((row.r, row.gram))
    return {lang: [g for _, g in sorted(found)] for lang, found in profiles.items()}


def identify(df: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", rows: int = 1000) -> DataFrame:
    """id_col, lang_pred string, score double for every whole text."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        model = Model(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                out = [model.predict(text or "") for text in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())],
                    names=[id_col, "lang_pred", "score"],
                )

    out = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, lang_pred string, score double"
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, out)
