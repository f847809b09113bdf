import random

from pyspark.sql import functions as F

import corpus_pipeline
from docmill.llm import near_copies, simhash
from docmill.llm.components import components
from tests.llm.helpers import docs


def edited(words, step):
    """Every step-th word replaced: too many bits of SimHash for two texts of this length."""
    return " ".join(f"new{i}" if i % step == step - 1 else w for i, w in enumerate(words))


def test_the_stage_drops_near_copies(spark):
    pick = random.Random(5)
    body = [f"w{pick.randrange(5000)}" for _ in range(300)]
    texts = [(1, " ".join(body)), (2, edited(body, 60)), (3, edited(body, 20)), (4, " ".join(reversed(body))), (5, None), (6, "")]
    sets = {i: near_copies.shingles(t) for i, t in texts}
    assert near_copies.similar(sets[1], sets[2]) and not near_copies.similar(sets[1], sets[3])
    near = {r.doc_id: r.fp for r in simhash.fingerprints(docs(spark, texts)).collect()}
    assert ((near[1] ^ near[2]) & (1 << 64) - 1).bit_count() > simhash.DISTANCE
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(spark, texts), "").collect()} == {1, 3, 4, 5}


def test_links_against_all_pairs(spark, monkeypatch):
    pick = random.Random(7)
    body = [f"w{pick.randrange(5000)}" for _ in range(200)]
    texts = [(i, " ".join(f"x{i}" if j == 3 * i else w for j, w in enumerate(body))) for i in range(40)] + [(99, "quite another text of some words here")]
    sets = {i: near_copies.shingles(t) for i, t in texts}
    want = {frozenset((a, b)) for a in sets for b in sets if a < b and near_copies.similar(sets[a], sets[b])}
    df = docs(spark, texts)
    sketches = simhash.fingerprints(df, copies=True).drop("fp").withColumnRenamed("doc_id", "node")
    for posting in (64, 3):
        monkeypatch.setattr(near_copies, "POSTING", posting)
        got = {frozenset((r.u, r.v)) for r in near_copies.links(sketches, df).collect()}
        assert got == want if posting == 64 else got <= want and {x for p in got for x in p} == set(range(40))


def test_dense_postings_lose_no_component(spark, monkeypatch):
    """Texts that share half their words with many others, in groups of near copies that chain."""
    monkeypatch.setattr(near_copies, "POSTING", 4)
    monkeypatch.setattr(near_copies, "PIVOTS", 1)
    pick = random.Random(11)
    word = lambda: f"w{pick.randrange(9000)}"
    shared, texts = [word() for _ in range(120)], []
    for _ in range(12):
        body = shared + [word() for _ in range(60)]
        for _ in range(6):
            texts.append((len(texts), " ".join(body)))
            at = pick.randrange(len(shared), len(body) - 4)
            body = body[:at] + [word() for _ in range(4)] + body[at + 4 :]
    sets = {i: near_copies.shingles(t) for i, t in texts}
    edges = [(a, b) for a in sets for b in sets if a < b and near_copies.similar(sets[a], sets[b])]
    root = {i: i for i in sets}

    def end(i):
        return i if root[i] == i else end(root[i])

    for a, b in edges:
        x, y = sorted((end(a), end(b)))
        root[y] = x
    df = docs(spark, texts)
    sketches = simhash.fingerprints(df, copies=True).drop("fp").withColumnRenamed("doc_id", "node")
    found = {r.node: r.component for r in components(near_copies.links(sketches, df)).collect()}
    assert {i: found.get(i, i) for i in sets} == {i: end(i) for i in sets}
    assert 1 < len({end(i) for i in sets}) < len(sets)


def test_the_prefix_join_meets_similar_texts_and_few_others(spark):
    """Edits of one text of several lengths: those of 8 or more edits are like no other, though most of their shingles are shared."""
    pick = random.Random(13)
    body, texts = [f"w{pick.randrange(9000)}" for _ in range(300)], []
    for i in range(60):
        words = list(body)
        n_edits = i % 12
        for j, at in enumerate(pick.sample(range(6, 280, 6), n_edits)):
            words[at] = f"own{i}x{j}" if j else f"both{i // 24}"
        texts.append((i, " ".join(words[: 300 - i % 7 * (n_edits < 6)])))
    sets = {i: near_copies.shingles(t) for i, t in texts}
    want = {(a, b) for a in sets for b in sets if a < b and near_copies.similar(sets[a], sets[b])}
    df = docs(spark, texts)
    members = df.select(F.col("doc_id").alias("node"), near_copies.digest("text").alias("t"), F.col("doc_id").alias("c"))
    rows = [tuple(sorted((r.u, r.v))) for r in near_copies._prefix_pairs(members, df, "text").collect()]
    assert len(want) > 100 and want <= set(rows)
    assert sum(p[0] % 12 >= 8 or p[1] % 12 >= 8 for p in rows) <= 5
