import random
from itertools import combinations

import regex

from docmill.llm import decontamination as d, queries
from tests.llm.helpers import SF, clashing, docs, needs_data

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


def words(text):
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def plain(documents, items):
    """(doc, item) -> (most equal in a window, equal, -first, tokens), by every lay with a token in common."""
    out = {}
    wanted = {i: words(text) for i, text in items}
    for k, body in documents:
        places = {}
        for p, w in enumerate(words(body)):
            places.setdefault(w, []).append(p)
        for i, item in wanted.items():
            size = min(d.WINDOW, len(item))
            least = size - size * d.ALLOWED // d.WINDOW
            lays = {}
            for j, t in enumerate(item):
                for p in places.get(t, ()):
                    lays.setdefault(p - j, []).append(j)
            for at, equal in lays.items():
                if len(equal) < least:
                    continue
                most = max(sum(s <= j < s + size for j in equal) for s in range(len(item) - size + 1))
                if most >= least:
                    out[k, i] = max(out.get((k, i), (0,)), (most, len(equal), -at, len(item)))
    return out


def found(rows):
    return {(r.doc_id, r.item_id): (r.window_equal, r.equal_tokens, -r.first_token, r.item_tokens) for r in rows}


def test_masks_meet_every_two_substitutions():
    for hit in combinations(range(d.WINDOW), 2):
        assert any(not {m + at for m in mask} & set(hit) for mask in d.MASKS for at in range(d.WINDOW - d.SPAN + 1))
    assert all(max(m) == d.SPAN - 1 and m[0] == 0 for m in d.MASKS)


def test_substitutions_and_odd_rows(spark):
    w = ITEM.split()
    swapped = lambda *places: " ".join("other" if i in places else t for i, t in enumerate(w))
    texts = [
        (1, ITEM), (2, "some words " + swapped(4, 9) + " and more"), (3, swapped(2, 7, 12)), (4, swapped(*range(0, 16, 2))), (5, None), (6, ""),
        (7, " ".join(w[:12])), (8, " ".join(w[3:])), (9, "x " * 30000 + ITEM.upper() + "."), (1, ITEM), (None, ITEM), (10, " ".join(["alpha"] * 40)),
    ]
    items = [(1, ITEM), (2, "too short to count"), (3, None), (4, ITEM), (5, " ".join(["alpha"] * 20))]
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    got = found(d.overlaps(docs(spark, texts), tests).collect())
    assert got == plain(texts, items)
    assert {(1, 1), (2, 1), (None, 1), (9, 4), (10, 5)} <= set(got) and not {k for k, _ in got} & {4, 5, 6}
    kept = d.decontaminate(docs(spark, texts), tests).collect()
    assert sorted(r.doc_id for r in kept) == sorted(k for k, _ in texts if k not in {k for k, _ in got})
    assert d.overlaps(docs(spark, []).select("doc_id", "text"), tests).count() == 0
    assert d.overlaps(docs(spark, texts), tests.filter("item_id < 0")).count() == 0


def test_short_items(spark):
    w = ITEM.split()
    cases = [(m, j) for m in range(1, d.SHORT) for j in range(-1, m)]
    items = [(m, " ".join(f"{t}{m}" for t in w[:m])) for m in range(1, d.SHORT)]
    said = lambda m, j: " ".join("other" if i == j else f"{t}{m}" for i, t in enumerate(w[:m]))
    texts = [(k, f"so {said(m, j)} end") for k, (m, j) in enumerate(cases)]
    cut = [(1000 + m, " ".join(text.split()[1:])) for m, text in items] + [(2000 + m, " ".join(text.split()[:-1])) for m, text in items]
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.equal_tokens) for r in d.overlaps(docs(spark, texts + cut), tests).collect()}
    wanted = {(k, m, m - (j >= 0)) for k, (m, j) in enumerate(cases) if j < 0 or m >= 7}
    assert got == wanted | {(at + m, m, m - 1) for at in (1000, 2000) for m in range(7, d.SHORT)}


def test_items_of_every_length_against_brute_force(spark):
    pick = random.Random(8)
    some = lambda n: " ".join(pick.choice("abcdefghij") + "xy"[pick.random() < 0.3] for _ in range(n))
    items = [(m * 100 + i, some(m)) for m in range(1, 15) for i in range(3)]
    texts = []
    for k in range(150):
        w = pick.choice(items)[1].split()
        for _ in range(pick.randint(0, 3)):
            w[pick.randrange(len(w))] = "zz"
        texts.append((k, f"{some(pick.randint(0, 20))} {' '.join(w)} {some(pick.randint(0, 20))}"))
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    assert found(d.overlaps(docs(spark, texts), tests).collect()) == plain(texts, items)


def test_repeated_tokens_are_runs(spark):
    item, text = " ".join(["alpha"] * 300), "so " + "alpha " * 8_000 + "it was"
    tests = spark.createDataFrame([(1, item), (2, "beta " * 20)], "item_id bigint, text string")
    got = d.overlaps(docs(spark, [(1, text), (2, "alpha alpha beta")]), tests).collect()
    assert [(r.doc_id, r.item_id, r.equal_tokens, r.first_token) for r in got] == [(1, 1, 300, 1)]


def test_clashing_columns(spark):
    df = clashing(spark, [(1, ITEM), (2, "nothing of it"), (None, None)])
    tests = clashing(spark, [(7, ITEM)]).withColumnRenamed("doc_id", "item_id")
    assert [(r.doc_id, r.item_id) for r in d.overlaps(df, tests).collect()] == [(1, 7)]
    kept = d.decontaminate(df, tests)
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(map(str, df.filter("doc_id is null or doc_id = 2").collect()))


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(d, "BROADCAST_BYTES", -1)
    got = found(d.overlaps(docs(spark, [(1, ITEM), (2, "none")]), spark.createDataFrame([(7, ITEM)], "item_id bigint, text string")).collect())
    assert set(got) == {(1, 7)}


@needs_data
def test_query(spark):
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert found(queries.op1_benchmark_decontamination(spark, SF).collect()) == plain(documents, items)
