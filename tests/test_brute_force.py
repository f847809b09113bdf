"""Queries that SQL can't express, against plain Python over the whole smallest tables."""

import math
from difflib import SequenceMatcher
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators import matching
from docmill.plans import catalogue
from docmill.tables import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


def test_fuzzy_titles(spark):
    parts = table(spark, SF, "part").collect()
    want = {}
    for a in parts:
        said = a.p_name[:1] + "xy" + a.p_name[3:]
        case = [b for b in parts if (b.p_brand, b.p_size) == (a.p_brand, a.p_size)]
        best = max(((SequenceMatcher(None, said, b.p_name).ratio(), -b.p_partkey, b.p_name) for b in case), default=None)
        want[a.p_partkey] = (best[2], round(best[0], 9)) if best and best[0] >= 0.5 else (None, None)
    got = {r.id: (r.title, r.ratio and round(r.ratio, 9)) for r in catalogue.QUERIES["fuzzy_titles"](spark, SF).collect()}
    assert got == want


def test_letters_leave_few_pairs_to_compare(spark):
    """Titles of one case, all lengths alike: the letters rule out most pairs that lengths can't, and none that match."""
    words = ["expert", "report", "claim", "memo", "reply", "witness", "contract", "invoice", "zoning", "quartz"]
    titles = [f"{a} {b}" for a in words for b in words if a != b]
    asked = [t[:-2] + "x" for t in titles[::7]]
    df = spark.createDataFrame([("c", t, i) for i, t in enumerate(titles)], "case string, title string, pos int")
    ask = spark.createDataFrame([("c", i, t) for i, t in enumerate(asked)], "case string, id int, candidate string")
    left = matching.could_match(ask, df, "case", "id", "candidate", "title", "pos", 0.8).collect()
    pairs = {(r.id, r.title) for r in left}
    assert {(i, t) for i, a in enumerate(asked) for t in titles if SequenceMatcher(None, a, t).ratio() >= 0.8} <= pairs
    assert len(pairs) < 0.1 * len(titles) * len(asked)


def test_mmr(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in table(spark, SF, "embeddings").collect()}
    unit = {i: v / np.linalg.norm(v) for i, v in rows.items()}
    q = unit[0]
    near = sorted(rows, key=lambda i: (-round(float(unit[i] @ q), 6), i))[:40]
    taken = []
    while len(taken) < 8:
        left = sorted(set(near) - set(taken))
        worth = [round(0.5 * float(unit[i] @ q) - 0.5 * max((float(unit[i] @ unit[j]) for j in taken), default=0.0), 9) for i in left]
        taken.append(left[int(np.argmax(worth))])
    got = sorted(catalogue.QUERIES["mmr_topk"](spark, SF).collect(), key=lambda r: r.place)
    assert [r.vec_id for r in got] == taken


def test_approximate_counts(spark):
    row = catalogue.QUERIES["ext_approx_distinct"](spark, SF).first()
    lines = table(spark, SF, "lineitem")
    exact = lines.select("l_partkey").distinct().count()
    assert abs(row.parts - exact) <= 0.15 * exact
    values = sorted(r[0] for r in lines.select("l_quantity").collect())
    assert row.median == values[math.ceil(len(values) / 2) - 1]


def test_recursive_chunks(spark):
    """Chunks are in order, at most as long as allowed, overlap by no more than allowed, and leave out nothing but blanks."""
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    found = catalogue.QUERIES["recursive_chunks"](spark, SF)
    chunks = {}
    for r in found.orderBy("doc_id", "chunk_index").collect():
        chunks.setdefault(r.doc_id, []).append(r)
    assert set(chunks) == {i for i, t in texts.items() if t.strip()}
    if "text" in found.columns:
        for i, rows in chunks.items():
            at = end = 0
            for r in rows:
                place = texts[i].find(r.text, max(at, end - 200))
                assert place >= 0 and len(r.text) <= 1000 and not texts[i][end:place].strip()
                at, end = place + 1, max(end, place + len(r.text))
            assert not texts[i][end:].strip()
    assert found.filter(F.col("chunk_index") < 0).count() == 0
