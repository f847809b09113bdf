"""Importance resampling of documents towards a target distribution.

Words are runs of ASCII letters and digits and of characters beyond ASCII, lower-cased in A-Z
only; features are all runs of one to `ngram` consecutive words, joined by a space, repeats
counted. A feature's bucket is the crc32 of its UTF-8 bytes modulo BUCKETS. The gain of a bucket
is the floored 1000-fold log ratio of its smoothed shares in target and corpus; a document's weight
is the floored mean of its features' gains, and its score adds Gumbel noise that follows from its
id and the seed, so that the highest scores are a weighted draw without replacement.

Scoring explodes nothing: higher-order functions make each document's array of buckets, and
`aggregate` adds up element_at of one literal array of gains. Of the features only the counts of
buckets are shuffled, at most BUCKETS rows from a task. The driver sees at most BUCKETS counts of
either table, and not a row of a document.

The draw needs no global sort. Scores are integers within a fixed range (gains of at most some
tens of thousands, noise within -3,100 and 23,000), so the rows above a score are counted from a
histogram of the scores of long enough documents, which stays below a hundred thousand rows at any
size, and rows of one score are numbered by id within their score.

Null and empty texts have no feature, weight 0 and a score of noise alone; they are never drawn
unless least_words is 0. Null ids draw noise as the empty id and come last among ties. Rows that repeat an id
score apart and hold ranks of their own. An empty corpus gives no rows, an empty target gains from
smoothing alone. Other columns may have any name; they are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import checkpoint

BUCKETS = 10_000
SEED = 2024
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(word: Column) -> Column:
    """A-Z lower-cased; the quick function does no more than that to a word of ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def feature_buckets(text: Column, ngram: int = 1, buckets: int = BUCKETS) -> Column:
    """The buckets of a text's features, as an array that is never null."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    if ngram == 1:
        return F.transform(words, lambda w: _bucket(_lowered(w), buckets))

    def runs(words: Column, n: int) -> Column:
        first = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(first, lambda i: _bucket(F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]), buckets))

    # an array of one array: its words are made once, not for every run
    held = F.transform(F.array(F.transform(words, _lowered)), lambda w: F.concat(*[runs(w, n) for n in range(1, ngram + 1)]))
    return F.get(held, F.lit(0))


def bucket_counts(docs: DataFrame, text: str = "text", ngram: int = 1, buckets: int = BUCKETS) -> dict[int, int]:
    """Features of a table in each bucket: added up in each task first, then at most `buckets` rows."""
    each = docs.select(F.explode(feature_buckets(F.col(text), ngram, buckets)).alias("bucket"))
    return {r.bucket: r.n for r in each.groupBy("bucket").agg(F.count("*").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket: floor(1000 ln of the smoothed target share over the smoothed corpus share)."""
    s_all, t_all = sum(corpus.values()) + float(buckets), sum(target.values()) + float(buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((corpus.get(b, 0) + 1.0) * t_all))) for b in range(buckets)]


def _literal(values: list[int]) -> Column:
    """A constant array; one string that the optimizer folds once, not ten thousand literals."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _floor_div(a: Column, b: Column) -> Column:
    return ((a - F.pmod(a, b)) / b).cast("long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln(u))), u from the first 32 bits of sha256 of seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(u))).cast("long")


def score(docs: DataFrame, gain: list[int], doc_id: str = "doc_id", text: str = "text", ngram: int = 1, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document."""
    buckets = len(gain)
    # features of one word are counted with the words; for longer ones words are counted apart
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)) if ngram > 1 else F.lit(None)
    held = docs.select(F.col(doc_id).alias("doc_id"), feature_buckets(F.col(text), ngram, buckets).alias("f"), words.cast("long").alias("w"))
    table = _literal(gain)
    total = F.aggregate("f", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table, b + 1))
    n = F.size("f").cast("long")
    counted = held.select("doc_id", F.coalesce("w", n).alias("n_words"), n.alias("n_features"), total.alias("_total"))
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(_floor_div(F.col("_total"), F.col("n_features")))
    return counted.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def draw(scored: DataFrame, percent: int = 10, least_words: int = 20) -> DataFrame:
    """scored with rank: 1, 2, 3 ... over the floor(percent * N / 100) highest scores of N long enough documents, else null.

    scored is read several times: pass a table.
    """
    long_enough = F.col("n_words") >= least_words
    heights = scored.filter(long_enough).groupBy("score").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")
    total = F.sum("n").over(Window.partitionBy())
    drawn = ((total * percent - (total * percent) % 100) / 100).cast("long")
    offsets = checkpoint(heights.select("score", above.alias("_above"), drawn.alias("_drawn")).filter("_above < _drawn"))
    least = offsets.agg(F.min("score")).first()[0]
    if least is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    in_reach = F.coalesce(long_enough & (F.col("score") >= least), F.lit(False))
    at = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())
    place = F.row_number().over(at) + F.col("_above")
    top = scored.filter(in_reach).join(F.broadcast(offsets), "score").withColumn("_place", place)
    ranked = top.select(*scored.columns, F.when(F.col("_place") <= F.col("_drawn"), F.col("_place")).cast("long").alias("rank"))
    return ranked.unionByName(scored.filter(~in_reach).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, ngram: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document of docs, drawn towards target."""
    gain = gains(bucket_counts(docs, ngram=ngram, buckets=buckets), bucket_counts(target, ngram=ngram, buckets=buckets), buckets)
    return draw(checkpoint(score(docs, gain, ngram=ngram, seed=seed)), percent, least_words)
