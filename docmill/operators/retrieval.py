"""Filtered vector top-k, its merging, reranking, diversity, fallback levels and grading."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import guards, vectors
from docmill.operators import reports
from docmill.tables import settled
from docmill.workers import ship

#: Vectors that are multiplied at a time.
BLOCK = 1024


def scope(df: DataFrame, **equal) -> DataFrame:
    """Conjunction of equalities; None leaves a condition out. Plain filters, so they reach the scan."""
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def top_k(corpus: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float | None = None) -> DataFrame:
    """The k nearest by cosine, then (only then) those at or above the threshold. No shuffle but the k rows."""
    scored = corpus.withColumn("score", F.round(vectors.cosine(F.col(vec_col), F.lit([float(x) for x in query]).cast("array<double>")), 6))
    best = scored.drop(vec_col).orderBy(F.desc("score"), id_col).limit(k)
    return best if threshold is None else best.filter(F.col("score") >= threshold)


def _blocks(df: DataFrame, name: str, vec: str, salt: Column) -> DataFrame:
    """Rows as blocks of BLOCK vectors of unit length: _ids, _matrix, _salt."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                v = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(float)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                ids = np.asarray(part.column(0).to_numpy(zero_copy_only=False), np.int64)
                yield pa.RecordBatch.from_pydict({"_ids": pa.array([ids.tobytes()], pa.binary()), "_matrix": pa.array([v.tobytes()], pa.binary())})

    whole = df.filter(F.col(name).isNotNull() & F.col(vec).isNotNull()).select(F.col(name).cast("long"), F.col(vec).cast("array<double>"))
    return whole.mapInArrow(pack, "_ids binary, _matrix binary").withColumn("_salt", salt)


def top_k_many(corpus: DataFrame, queries: DataFrame, k: int, query_id: str = "query_id", id_col: str = "vec_id", vec_col: str = "embedding", salts: int = 32) -> DataFrame:
    """query_id, id, score, rank of the k nearest of every query vector (column q).

    Both sides are packed into blocks of vectors. Corpus blocks are dealt to `salts` groups, query blocks go to each group, and
    a task multiplies the matrices of the blocks that meet and passes on each query's k best of them. Nothing passes through
    the driver, and any number of queries is one pass over the corpus.
    """
    ship(corpus.sparkSession)
    asked = _blocks(queries, query_id, "q", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).toDF("_names", "_asked", "_salt")
    held = _blocks(corpus, id_col, vec_col, F.pmod(F.xxhash64("_ids"), F.lit(salts)).cast("int"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, a, ids, b in zip(*batch.columns):
                names, ids = (np.frombuffer(x.as_py(), np.int64) for x in (names, ids))
                q, v = np.frombuffer(a.as_py()).reshape(len(names), -1), np.frombuffer(b.as_py()).reshape(len(ids), -1)
                s = np.round(q @ v.T, 6)
                keep = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(names, keep.shape[1])), pa.array(ids[keep].ravel()), pa.array(np.take_along_axis(s, keep, 1).ravel())], names=[query_id, id_col, "score"]
                )

    met = asked.join(held, "_salt").select("_names", "_asked", "_ids", "_matrix")
    found = met.mapInArrow(best, f"{query_id} bigint, {id_col} bigint, score double")
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rerank(df: DataFrame, relevance: Column, top: int, id_col: str, name: str = "rerank_score") -> DataFrame:
    """The `top` rows by a relevance column, ties in the order they had."""
    return df.withColumn(name, relevance).orderBy(F.desc(name), F.desc("score"), id_col).limit(top)


def lexical_overlap(question: Column, text: Column) -> Column:
    """Default relevance: the share of the question's different words that the text has."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+", -1), lambda w: w != ""))
    q = words(question)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, words(text))), F.size(q)), F.lit(0.0))


def confidence(df: DataFrame) -> DataFrame:
    """n_docs, confidence (mean score, 0 where missing, three digits)."""
    return df.agg(F.count("*").alias("n_docs"), F.coalesce(F.round(F.avg(F.coalesce("score", F.lit(0.0))), 3), F.lit(0.0)).alias("confidence"))


def grade(df: DataFrame, retries: int = 0) -> DataFrame:
    found = confidence(df)
    graded = guards.retrieval_grade(F.lit(retries), F.col("n_docs"), F.col("confidence"))
    return found.withColumn("grade", graded).withColumn("route", guards.grader_route(F.col("grade")))


def fallback_levels(corpus: DataFrame, levels: list[Column], query: list[float], k: int, **how) -> DataFrame:
    """The top k of the first condition that has any row: one pass sees which that is, one searches."""
    seen = corpus.agg(*[F.count_if(c).alias(f"l{i}") for i, c in enumerate(levels)]).first()
    at = next((i for i, n in enumerate(seen) if n), len(levels) - 1)
    return top_k(corpus.filter(levels[at]), query, k, **how).withColumn("level", F.lit(at + 1))


def _diverse(ids: np.ndarray, vecs: list, query: list[float], k: int, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k chosen ones among candidates sorted by id, and their relevances."""
    v = np.stack(vecs).astype(float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    q = np.array(query, float) / max(np.linalg.norm(query), 1e-300)
    relevance, taken, left = v @ q, [], list(range(len(v)))
    while left and len(taken) < k:
        near = (v[left] @ v[taken].T).max(axis=1) if taken else np.zeros(len(left))
        taken.append(left.pop(int(np.argmax(np.round(weight * relevance[left] - (1 - weight) * near, 9)))))
    return np.array(taken, int), np.round(relevance[taken], 6)


def mmr(candidates: DataFrame, query: list[float], k: int, weight: float = 0.5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """k of one query's candidates (a top_k's, so as few as that) by maximal marginal relevance, in the order they are chosen."""
    asked = candidates.select(F.lit(1).alias("_key"), id_col, vec_col, F.lit([float(x) for x in query]).cast("array<double>").alias("q"))
    return mmr_many(asked, "_key", k, weight, id_col, vec_col).drop("_key")


def mmr_many(candidates: DataFrame, key: str, k: int, weight: float = 0.5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """key, id, place, score: for every query k of its candidates by maximal marginal relevance.

    candidates: key, id, vector, and the query's vector q. A key has as many as its search gave; queries are independent of each other.
    """
    ship(candidates.sparkSession)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col, ignore_index=True)
        taken, scores = _diverse(pdf[id_col].to_numpy(), pdf[vec_col].tolist(), pdf["q"].iloc[0], k, weight)
        return pd.DataFrame({key: pdf[key].iloc[taken].to_numpy(), id_col: pdf[id_col].iloc[taken].to_numpy(), "place": np.arange(1, len(taken) + 1), "score": scores})

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    return candidates.select(key, id_col, vec_col, "q").groupBy(key).applyInPandas(choose, f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, place int, score double")


def flow(corpus: DataFrame, asked: DataFrame, k: int, top: int, relevance: Column | None = None, question: str = "question_id", id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Retrieval in one: every wording of every question searched, documents once with their best score, the `top` of them
    by relevance (by score without one), and how sure that is.

    asked: question, variant_id (of its own for each wording), q (its vector), retries. relevance is a column over the corpus.
    Gives (question, id, score, place) of what is kept, and (question, n_docs, confidence, grade, route) of every question.
    """
    searched = top_k_many(corpus, asked.select("variant_id", "q"), k, "variant_id", id_col, vec_col)
    pairs = searched.select("variant_id", id_col, "score").join(asked.select("variant_id", question), "variant_id").drop("variant_id")
    if relevance is not None:
        pairs = pairs.join(corpus.select(id_col, relevance.alias("_relevance")), id_col)
    kept, sure = reports.reranked(pairs, None if relevance is None else F.col("_relevance"), top, question, id_col, "score")
    n = kept.groupBy(question).agg(F.count("*").alias("n_docs"))
    questions = asked.groupBy(question).agg(F.max("retries").alias("retries"))
    told = questions.join(n, question, "left").join(sure, question, "left").na.fill(0, ["n_docs"]).na.fill(0.0, ["confidence"])
    told = told.withColumn("grade", guards.retrieval_grade(F.coalesce("retries", F.lit(0)), F.col("n_docs"), F.col("confidence")))
    return kept, told.withColumn("route", guards.grader_route(F.col("grade"))).drop("retries")


def expand(question: Column, hyde: Column, paraphrases: Column) -> Column:
    """The question, a made-up answer and paraphrases, each once and not blank."""
    every = F.concat(F.array(question, hyde), F.coalesce(paraphrases, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (F.trim(x) != "")))


def retry_until(df: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], done: Column, most: int) -> DataFrame:
    """Rows that attempt(rows, n) settles, and after `most` tries whatever is left.

    Each try sees the unsettled rows only, is made once and written to the shared folder, so that no answer is asked for
    again; column attempts tells how many were made.
    """
    out, left = None, df
    for n in range(1, most + 1):
        tried = settled(attempt(left, n).withColumn("attempts", F.lit(n)))
        now = tried.filter(done) if n < most else tried
        out = now if out is None else out.unionByName(now)
        left = tried.filter(~done | done.isNull()).drop("attempts")
        if n < most and left.isEmpty():
            break
    return out


def mean_pair_similarity(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, n_pairs, mean_similarity: the mean dot product over all pairs of a key's vectors, without making pairs.

    The pairs' dot products add up to half of what the square of the summed vector has beyond the
    vectors' own squares, so one aggregation by key and place is enough; a key of one row has no pairs.
    """
    each = df.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("at", "x"))
    places = each.groupBy(key, "at").agg(F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("own"), F.count("*").alias("n"))
    found = places.groupBy(key).agg(F.sum(F.col("total") * F.col("total") - F.col("own")).alias("twice"), F.max("n").alias("n")).filter("n > 1")
    pairs = F.col("n") * (F.col("n") - 1)
    return found.select(key, (pairs / 2).cast("long").alias("n_pairs"), (F.col("twice") / pairs).alias("mean_similarity"))
