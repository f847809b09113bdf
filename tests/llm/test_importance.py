import binascii
import hashlib
import math
import re
from collections import Counter

import duckdb

from docmill.llm import importance, oracles, queries
from tests.llm.helpers import SF, clashing, needs_data

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def features(text, ngram=1):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]


def expected(docs, target, percent, least, ngram=1, buckets=10_000):
    place = lambda f: binascii.crc32(f.encode()) % buckets
    s = Counter(place(f) for _, t in docs for f in features(t, ngram))
    t = Counter(place(f) for _, x in target for f in features(x, ngram))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        f = features(text, ngram)
        weight = sum(gain[place(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    ranks = Counter()
    for k, r in enumerate(long[: len(long) * percent // 100], 1):
        ranks[r[0]] = k
    return {r[0]: (*r[1:], ranks[r[0]] or None) for r in out}


def drawn(spark, docs, target, percent, least, **more):
    held = clashing(spark, docs)
    goal = spark.createDataFrame(target, "item_id long, text string")
    found = importance.resample(held, goal, percent, least, **more).collect()
    return {r.doc_id: tuple(r)[1:] for r in found}


DOCS = [(i, " ".join(f"{'Word' if i % 2 else 'mot-clé'} {j % (i + 3)} ÉTÉ" for j in range(i % 40))) for i in range(120)] + [(500, None), (501, ""), (502, "... !"), (503, "deep SEA " * 30_000), (None, "sea " * 30), (505, "\x00null\x00bytes " * 20)]
TARGET = [(1, "deep sea deep water"), (2, None), (3, "word word 1 2 3"), (4, "")]


def test_against_brute_force(spark):
    assert drawn(spark, DOCS, TARGET, 25, 20) == expected(DOCS, TARGET, 25, 20)
    assert drawn(spark, DOCS, TARGET, 100, 0) == expected(DOCS, TARGET, 100, 0)


def test_longer_features_and_few_buckets(spark):
    assert drawn(spark, DOCS, TARGET, 40, 5, ngram=3, buckets=50) == expected(DOCS, TARGET, 40, 5, 3, 50)


def test_nothing_drawn_no_target_no_rows(spark):
    assert drawn(spark, DOCS[:9], TARGET, 10, 20) == expected(DOCS[:9], TARGET, 10, 20)
    assert drawn(spark, DOCS, [], 10, 20) == expected(DOCS, [], 10, 20)
    assert drawn(spark, [], TARGET, 10, 20) == {}


def test_repeated_ids_hold_ranks_of_their_own(spark):
    goal = spark.createDataFrame(TARGET, "item_id long, text string")
    found = importance.resample(clashing(spark, [(7, "sea " * 25)] * 4 + [(8, "land " * 25)]), goal, 100, 20).collect()
    assert sorted(r["rank"] for r in found) == [1, 2, 3, 4, 5]


def test_scoring_neither_explodes_nor_shuffles(spark):
    plan = importance.score(clashing(spark, DOCS), [1] * 10)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Generate", "Exchange", "Python"))


def test_ranks_come_without_a_sort_of_all(spark):
    scored = importance.score(clashing(spark, DOCS), [1] * 10)
    plan = importance.draw(scored, 50, 5)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "rangepartitioning" not in plan


@needs_data
def test_query_against_the_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = con.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({oracles.RESAMPLING})").fetchall()
    assert Counter(rows) == Counter(map(tuple, queries.op12_importance_resampling(spark, SF).collect()))
