import random
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from docmill.llm import queries, simhash
from docmill.llm.components import components
from tests.llm.helpers import SF, clashing, docs, needs_data


def plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(fps, also=lambda a, b: False):
    """id -> smallest reachable id, by comparing all pairs; also(a, b): a link of another kind."""
    least = {i: i for i in fps}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and ((fps[a] ^ fps[b]).bit_count() <= 2 or also(a, b)):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {i: root(i) for i in ids}


def test_odd_rows(spark):
    texts = [(5, None), (2, ""), (9, " \t\n"), (3, "One two"), (4, "one TWO"), (7, "ÄÖ Ü x"), (8, "äÖ Ü x"), (3, "One two"), (6, "w " * 20000), (None, "one two")]
    rows = simhash.near_duplicates(docs(spark, texts)).collect()
    got = {(r.doc_id, r.fp & (1 << 64) - 1): r.component_id for r in rows}
    for i, t in texts:
        assert (i, plain_fingerprint(t)) in got
    assert {got[i, 0] for i in (5, 2, 9)} == {2}
    assert got[4, plain_fingerprint("one two")] == 3 and got[None, plain_fingerprint("one two")] == 3
    assert simhash.near_duplicates(docs(spark, []).select("doc_id", "text")).count() == 0


def test_dense_postings_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "POSTING", 3)
    pick = random.Random(3)
    fps = set()
    for _ in range(3):
        base = pick.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(pick.randint(0, 3)):
                x ^= 1 << pick.choice([0, 1, 2, 5, 9, 10, 13, 40, 41, 63, 62])
            fps.add(x)
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    found = {r.node: r.component for r in components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))).collect()}
    want = plain_components(signed)
    groups = {}
    for s in signed:
        groups.setdefault(want[s], set()).add(found.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_the_tally_decides_which_pairs_are_verified(spark):
    """Of pairs that meet in a posting of four bytes, those below six shared bytes never reach verification."""
    pick = random.Random(6)
    base = [pick.getrandbits(64) for _ in range(40)]
    flip = lambda x, bits: x ^ sum(1 << b for b in pick.sample(range(64), bits))
    fps = sorted({f for x in base for f in (x, flip(x, 1), flip(x, 2), flip(x, 3), flip(x, 5), flip(x, 8))})
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    shared = lambda a, b: [(a >> 8 * i & 255) == (b >> 8 * i & 255) for i in range(8)]
    blocks = lambda s: sum(s[2 * i] and s[2 * i + 1] for i in range(4))
    met = {(a, b): sum(s) for i, a in enumerate(fps) for b in fps[i + 1 :] if blocks(s := shared(a, b)) >= 2}
    kept = {simhash._mask(x): x for x in (tuple(sorted((2 * i, 2 * i + 1, 2 * j, 2 * j + 1))) for i, j in combinations(range(4), 2))}
    each = spark.createDataFrame([(signed(f),) for f in fps], "fp long").select("fp", F.explode(F.array(*[simhash._key(x) for x in kept.values()])).alias("key"))
    got = {frozenset((r.u, r.v)) for r in simhash.tallied(simhash._counted(each), kept).collect()}
    assert got == {frozenset(map(signed, p)) for p, n in met.items() if n >= simhash.SHARED_BYTES}
    assert len(met) > 1.2 * len(got) > 0


def test_clashing_columns(spark):
    df = clashing(spark, [(2, "a b c d"), (1, "A B C D"), (1, "A B C D"), (3, "quite another text here"), (None, "a b c d")])
    for copies in (False, True):
        kept = simhash.keep_one(df, copies=copies)
        assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3]
    assert simhash.near_duplicates(df).count() == 5


def test_components_of_a_chain(spark):
    edges = spark.range(0, 60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.component for r in components(edges).collect()} == {0}
    assert components(edges.filter("u < 0")).count() == 0


def test_keep_one(spark):
    df = docs(spark, [(2, "a b c d"), (1, "A B C D"), (1, "A B C D"), (3, "quite another text here"), (None, "a b c d")])
    assert sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(df).collect()) == [(0, "a b c d"), (1, "A B C D"), (3, "quite another text here")]


@needs_data
def test_query(spark):
    fps = {r.doc_id: plain_fingerprint(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = plain_components(fps)
    rows = queries.op2_simhash_near_dedup(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{f:016x}", want[i]) for i, f in fps.items()}
