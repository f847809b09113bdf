import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docmill.llm import queries, toxicity as t
from docmill.llm.common import fold
from tests.llm.helpers import SF, clashing, docs, needs_data

CLEAN = ["river", "stone", "cloud", "green", "walks", "under", "table", "seven", "music", "paper"]


def corpus(n=400):
    pick = random.Random(1)
    rows = []
    for i in range(n):
        sentences = [[pick.choice(CLEAN) for _ in range(pick.randint(8, 12))] for _ in range(pick.randint(1, 6))]
        toxic = pick.random() < 0.3
        if toxic:
            pick.choice(sentences).insert(3, pick.choice(["scumbag", "scumling", "idiot"]))
        rows.append((i, ". ".join(" ".join(s) for s in sentences) + ".", int(toxic)))
    return rows


def test_sentences_and_spans_agree():
    pick = random.Random(2)
    for _ in range(200):
        text = "".join(pick.choice(["word ", "Ab ", ". ", "!", "\n", "12 ", "é "]) for _ in range(pick.randint(0, 300)))
        found, at = list(t.sentences(text)), t.spans(text)
        assert len(found) == len(at) and all(len(s) <= t.MOST for s in found)
        assert [w for s in found for w in s] == t.WORD.findall(text.lower())
        assert all(t.WORD.findall(text.lower()[a:b]) == s for s, (a, b) in zip(found, at))


def test_spans_lie_in_the_text_as_it_is(spark):
    weights = np.zeros(t.WEIGHTS)
    weights[0], weights[t.word_places("idiot")[0]] = -5.0, 12.0
    text = "İİİİ and seven words more to come here. You are such an idiot my dear old friend. The rest is fine and long enough to be one."
    worst = t.score(docs(spark, [(1, text)]), weights).first().worst
    assert text[worst.start : worst.end] == "You are such an idiot my dear old friend"


def plain_score(text, weights):
    """The noisy-or of the sentences, written out."""
    none = 1.0
    for sentence in t.sentences(text or ""):
        logit = weights[0] + sum(weights[p] for w in set(sentence) for p in t.word_places(w))
        none *= 1 / (1 + math.exp(logit))
    return 1 - none


def plain_fit(rows, labels, clean_weight):
    """fit without arrays: the same steps; slopes are held against differences of the loss."""
    bags = [[[p for w in dict.fromkeys(s) for p in t.word_places(w)] for s in t.sentences(x)] for x in rows]
    seen = Counter(p for doc in bags for p in {p for s in doc for p in s})
    bags = [[[p for p in s if seen[p] >= t.DOCUMENTS] for s in doc] for doc in bags]
    weights, moved = defaultdict(float, {0: -6.5}), defaultdict(lambda: 1e-8)
    order = np.random.default_rng(7)

    def logits(doc):
        return [weights[0] + sum(weights[p] for p in s) for s in doc]

    def loss(found, y):
        none = sum(math.log1p(math.exp(x)) for x in found)
        return -math.log(max(-math.expm1(-none), 1e-9)) if y else none

    def slopes(doc, y):
        found = logits(doc)
        toxic = max(-math.expm1(-sum(math.log1p(math.exp(x)) for x in found)), 1e-9)
        out = [(1 - y / toxic) / (1 + math.exp(-x)) for x in found]
        moved_by = lambda k, h: [x + h * (i == k) for i, x in enumerate(found)]
        for k, slope in enumerate(out):
            assert abs(slope - (loss(moved_by(k, 1e-5), y) - loss(moved_by(k, -1e-5), y)) / 2e-5) < 1e-4
        return out

    for _ in range(t.EPOCHS):
        shuffled = order.permutation(len(rows))
        for at in range(0, len(rows), t.BATCH):
            which = shuffled[at : at + t.BATCH]
            whole = sum(1.0 if labels[i] else clean_weight for i in which)
            down, bias = defaultdict(float), 0.0
            for i in which:
                for s, slope in zip(bags[i], slopes(bags[i], labels[i])):
                    slope *= (1.0 if labels[i] else clean_weight) / whole
                    bias += slope
                    for p in s:
                        down[p] += slope
            for p, g in down.items():
                g += t.DECAY * weights[p]
                moved[p] += g * g
                weights[p] -= t.RATE * g / math.sqrt(moved[p])
            moved[0] += bias * bias
            weights[0] -= 0.1 * t.RATE * bias / math.sqrt(moved[0])
    return weights


def test_fit_and_score_against_plain_loops(spark):
    rows = corpus(90)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    df = docs(spark, [(i, x) for i, x, _ in rows]).coalesce(1)
    weights = t.learn(df, labels)
    near = plain_fit([x for _, x, _ in rows], [y for *_, y in rows], 1.0)
    assert all(abs(weights[p] - w) < 0.02 for p, w in near.items() if p)
    scored = {r.doc_id: r.score for r in t.score(df, weights).collect()}
    assert all(abs(scored[i] - plain_score(x, weights)) < 1e-5 for i, x, _ in rows)


def test_clashing_columns(spark):
    rows = corpus(60)
    df, labels = clashing(spark, [(i, x) for i, x, _ in rows]), clashing(spark, [(i, "") for i, *_ in rows]).withColumn("toxic", F.col("doc_id").cast("int") % 2)
    scored = t.score(df, t.learn(df, labels), keep=["y", "c0", "_id"])
    assert scored.columns == ["doc_id", "y", "c0", "_id", "score", "worst"] and scored.count() == 60


def test_the_sample_is_bounded_in_characters(spark):
    rows = corpus(200)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    df = docs(spark, [(i, x) for i, x, _ in rows])
    assert np.flatnonzero(t.learn(df, labels)).size > np.flatnonzero(t.learn(df, labels, sample_chars=(800, 800))).size


def test_learns_and_locates(spark):
    rows = corpus()
    known = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4], "doc_id bigint, toxic int")
    text = {i: x for i, x, _ in rows}
    scored = t.score(docs(spark, [(i, x) for i, x, _ in rows]), t.learn(docs(spark, [(i, x) for i, x, _ in rows]), known)).collect()
    right = [(r.score >= 0.5) == bool(rows[r.doc_id][2]) for r in scored if r.doc_id % 4 == 0]
    assert sum(right) >= 0.95 * len(right)
    for r in scored:
        if r.worst and rows[r.doc_id][2]:
            assert "scum" in text[r.doc_id][r.worst.start : r.worst.end] or "idiot" in text[r.doc_id][r.worst.start : r.worst.end]


def test_sample_is_bounded_and_weighted(spark):
    labels = spark.range(0, 1000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    ids, totals = t.sampled(labels, sample=(20, 50))
    assert ids.groupBy("y").count().orderBy("y").collect() == [(0, 50), (1, 20)]
    assert totals == {1: 100, 0: 900}
    assert abs(t.clean_weight(np.repeat([1.0, 0.0], [20, 50]), totals) - (20 / 100) / (50 / 900)) < 1e-9
    assert t.clean_weight(np.ones(3), {1: 3}) == 1.0 == t.clean_weight(np.zeros(3), {0: 3})


@pytest.mark.parametrize("kind", [0, 1])
def test_one_long_text_displaces_no_others(spark, kind):
    """The longest text of either label comes first by its hash, and is larger than the sample."""
    rows = corpus(200)
    size = sum(len(x) for _, x, y in rows if y == kind) + 50
    first = min(range(1000, 3000), key=lambda i: xxhash.xxh64_intdigest(str(i).encode(), 42) ^ 1 << 63)
    long = (first, "plain words follow one another here. " * (size // 37 + 2), kind)
    labels = lambda rows: spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    df = docs(spark, [(i, x) for i, x, _ in [*rows, long]]).coalesce(1)
    bound = (size, 10**7) if kind else (10**7, size)
    same = t.learn(df, labels(rows))
    cut = t.learn(df, labels([*rows, long]), sample_chars=bound)
    score = lambda w: {r.doc_id: r.score for r in t.score(df, w).collect()}
    a, b = score(same), score(cut)
    assert all((a[i] >= 0.5) == (b[i] >= 0.5) for i, *_ in rows) and 20 < sum(b[i] >= 0.5 for i, *_ in rows) < 180


def test_a_label_that_has_nothing_but_a_long_text_keeps_it(spark):
    rows = [(1, "scum of all kinds " * 400, 1), *[(i, f"quite fine words number {i}", 0) for i in range(2, 40)]]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    df = docs(spark, [(i, x) for i, x, _ in rows])
    weights = t.learn(df, labels, sample_chars=(100, 10**6))
    assert abs(weights[0]) < 40  # fitted on both kinds, not on one alone


def test_odd_rows(spark):
    weights = np.zeros(t.WEIGHTS)
    weights[0] = -3.0
    weights[t.word_places("scum")[0]] = 9.0
    rows = [(1, None), (2, ""), (3, "scum"), (3, "scum"), (None, "12"), (4, "fine word " * 20000)]
    got = t.score(docs(spark, rows), weights, keep=["ids"]).collect()
    assert [r.score >= 0.5 for r in got] == [False, False, True, True, False, True]
    assert abs(got[0].score - 1 / (1 + np.exp(3))) < 1e-6 and got[0].score == got[1].score
    assert t.score(docs(spark, []).select("doc_id", "text"), weights).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert all(r.score < 1e-9 for r in t.score(docs(spark, rows), t.learn(docs(spark, rows), none)).collect())


@needs_data
def test_query_never_sees_the_held_out_fold(spark, tmp_path):
    rows = queries.op4_toxicity(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = F.when(fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int").alias("toxic")
    labels.select("doc_id", "quality", flipped).write.parquet(str(tmp_path / "labels.parquet"))
    again = queries.op4_toxicity(spark, str(tmp_path)).collect()
    assert {r.doc_id: round(r.score, 6) for r in rows} == {r.doc_id: round(r.score, 6) for r in again}
