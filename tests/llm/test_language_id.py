import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from docmill.llm import language_id as lid, queries
from tests.llm.helpers import SF, clashing, docs, needs_data

EN, DE = "the cat and the dog were there with their other thing", "der Hund und die Katze sind nicht dort mit einer Sache"


def plain_profile(texts):
    n = Counter()
    for t in texts:
        word = ""
        for c in f"{t.lower()} ":
            if c.isalpha():
                word += c
                continue
            if word:
                padded = f" {word} "
                n.update(padded[i : i + k] for k in (1, 2, 3) for i in range(len(padded) - k + 1) if padded[i : i + k].strip())
            word = ""
    number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [number(g) for g, _ in sorted(n.items(), key=lambda x: (-x[1], number(x[0])))[: lid.PROFILE]]


def test_profiles_count_every_gram(spark):
    rows = [(EN, "en"), (EN + " Then", "en"), (DE, "de"), ("¡qué 12 días!", None), (None, "en"), ("123", "xx"), ("", "de")]
    got = lid.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert got == {"en": plain_profile([EN, EN + " Then"]), "de": plain_profile([DE])}


def test_odd_rows(spark):
    profiles = {"en": plain_profile([EN]), "de": plain_profile([DE])}
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "the other dog"), (5, "der Hund und die"), (4, "the other dog"), (6, "the " * 30000), (None, "中文 字"), (7, "ü")]
    got = lid.identify(docs(spark, rows), profiles).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "de", "en", "en", got[7].lang_pred, got[8].lang_pred]
    assert all(0 <= r.score <= 1 for r in got) and {got[7].lang_pred, got[8].lang_pred} <= {"de", "en"}
    assert {r.lang_pred for r in lid.identify(docs(spark, rows), {}).collect()} == {"und"}
    assert lid.identify(docs(spark, []).select("doc_id", "text"), profiles).count() == 0
    assert lid.learn(spark.createDataFrame([], "text string, lang string")) == {}


def plain_predict(text, profiles):
    """Language and score by the out-of-place distance, written out."""
    own = plain_profile([text])
    if not own:
        return lid.UNKNOWN, 0.0
    cost = {}
    for name, profile in profiles.items():
        rank = {g: i for i, g in enumerate(profile)}
        cost[name] = sum(abs(rank[g] - i) if g in rank else lid.PROFILE for i, g in enumerate(own))
    best = min(sorted(cost), key=cost.get)
    return best, 1 / sum(math.exp(-8 * (c - cost[best]) / (lid.PROFILE * len(own))) for c in cost.values())


@needs_data
def test_predictions_against_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    held_out = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    texts = {}
    for k, text, lang in rows:
        if lang and not held_out(k):
            texts.setdefault(lang, []).append(text)
    profiles = {lang: plain_profile(found) for lang, found in texts.items()}
    got = {r.doc_id: r for r in queries.op6_language_id(spark, SF).collect()}
    for k, text, _ in rows:
        lang, score = plain_predict(text, profiles)
        assert (got[k].lang_pred, got[k].held_out) == (lang, held_out(k)) and abs(got[k].score - score) < 1e-9


def test_clashing_columns(spark):
    df = clashing(spark, [(1, EN), (2, DE)]).withColumn("lang", F.when(F.col("doc_id") == 1, "en").otherwise("de")).withColumn("gram", F.lit(1))
    got = lid.identify(df, lid.learn(df))
    assert got.columns == ["doc_id", "lang_pred", "score"] and {(r.doc_id, r.lang_pred) for r in got.collect()} == {(1, "en"), (2, "de")}


@needs_data
def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in queries.op6_language_id(spark, SF).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
