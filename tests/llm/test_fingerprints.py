import hashlib
import math
import random

import xxhash
from pyspark.sql import functions as F

from docmill.llm import fingerprints as fp, queries
from tests.llm.helpers import SF, docs, needs_data


def prints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return {r.k: r.fingerprint for r in fp.fingerprints(df, ["k"]).collect()}


def test_equality_and_order(spark):
    got = prints(spark, ["a b\nc d", "c d\na b", "a b\nc d", "a b\nc e", "", None, "a b\nc d\nc d"])
    assert got[0] == got[2] and got[4] == got[5]
    assert got[0] == got[1]
    assert len({tuple(got[i]) for i in (0, 3, 4, 6)}) == 4


def test_paragraphs_are_added_and_taken_away_on_all_lanes(spark):
    pick = random.Random(3)
    parts = [" ".join(pick.choice(["one", "two", "", "three\tfour", "é"]) for _ in range(pick.randint(0, 40))) for _ in range(12)]
    mixed = pick.sample(parts, len(parts))
    got = prints(spark, ["\n".join(parts), "\n".join(mixed), "\n".join(parts[:7]), "\n".join(parts[7:]), "\n".join(parts[:3] + parts[4:]), parts[3]])
    assert got[0] == got[1] and len(got[0]) == 69
    df = spark.createDataFrame([tuple(got[i] for i in range(6))], ", ".join(f"f{i} array<bigint>" for i in range(6)))
    sums = df.select(fp.add(F.col("f2"), F.col("f3")), fp.add(F.col("f0"), F.col("f5"), -1), fp.add(F.col("f4"), F.col("f5"))).first()
    assert sums[0] == got[0] and sums[1] == got[4] and sums[2] == got[0]


def chained(*parts, seed=42):
    """The hash of several values as Spark's xxhash64 chains them."""
    for x in parts:
        raw = x.encode() if isinstance(x, str) else x.to_bytes(4, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def plain_print(text):
    lines = (text or "").split("\n")
    equal = [sum(chained(p, salt) & fp.MASK62 for p in lines) & fp.MASK62 for salt in range(4)]
    units = []
    for line in lines:
        words = line.replace("\r", " ").replace("\t", " ").split(" ")
        units += [chained(*words[i : i + 2]) for i in range(len(words))] + [chained(w[:4], 4) for w in words]
    return [*equal, len(units), *[sum(u >> j & 1 for u in units) for j in range(64)]]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    u, v = ([2 * x - f[4] for x in f[5:]] for f in (a, b))
    scale = math.sqrt(sum(x * x for x in u) * sum(x * x for x in v))
    return min(1.0, max(0.0, sum(x * y for x, y in zip(u, v)) / scale)) if scale else 0.0


def plain(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (k, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(t) // 3
        out[k] = (len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest())
    return out


def test_odd_rows(spark):
    rows = [(9, "x" * 50000), (-4, None), (7, ""), (2**62, "é" * 10), (1, "one two three"), (0, "z")]
    got = fp.compare_with_next(docs(spark, rows)).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == plain(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fp.compare_with_next(docs(spark, [(1, "alone here")])).first().near_next == 1.0
    twice = fp.compare_with_next(docs(spark, [(1, "a"), (1, "a"), (1, "b"), (None, "c")])).collect()
    assert len(twice) == 4 and len({tuple(r.fingerprint) for r in twice}) == 3
    assert fp.compare_with_next(docs(spark, []).select("doc_id", "text")).count() == 0


def test_likeness_is_continuous_in_the_length(spark):
    words = [f"{chr(97 + i % 26)}{i}ord" for i in range(40)]
    got = prints(spark, [" ".join(words[:n]) for n in range(20, 41)])
    steps = spark.createDataFrame([(n, got[n], got[n + 1]) for n in range(20)], "n int, a array<bigint>, b array<bigint>")
    assert all(r.near > 0.8 for r in steps.select(fp.likeness(F.col("a"), F.col("b")).alias("near")).collect())


@needs_data
def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op7_document_fingerprints(spark, SF).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == plain(rows)
    text = dict(rows)
    assert len({r.fingerprint for r in got}) == len({text[r.doc_id] for r in got})
    assert sum(r.near_edited > r.near_next for r in got) > 0.97 * len(got)
    order = sorted(text, reverse=True)
    hexed = lambda f: "".join(f"{x:016x}" if i < 4 else f"{x:08x}" for i, x in enumerate(f))
    after = {k: text[order[(i + 1) % len(order)]] for i, k in enumerate(order)}
    for r in got:
        own, cut = text[r.doc_id], len(text[r.doc_id]) // 3
        a, b, c = map(plain_print, (own, own[: len(own) - cut] + after[r.doc_id][:cut], after[r.doc_id]))
        assert (r.fingerprint, r.edited_fingerprint) == (hexed(a), hexed(b))
        assert abs(r.near_edited - plain_likeness(a, b)) < 1e-9 and abs(r.near_next - plain_likeness(a, c)) < 1e-9


def test_ranges_are_cut_twice_where_they_are_many(spark, monkeypatch):
    rows = [(i * i, f"text number {i} " * 9) for i in range(300)]
    once = fp.compare_with_next(docs(spark, rows)).collect()
    monkeypatch.setattr(fp, "COARSE", 4)
    monkeypatch.setattr(fp, "RANGE_BYTES", 2000)
    assert sorted(fp.compare_with_next(docs(spark, rows)).collect()) == sorted(once)
