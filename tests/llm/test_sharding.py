import binascii
import hashlib

import duckdb

from docmill.llm import oracles, queries, sharding
from tests.llm.helpers import SF, needs_data

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, node int, tie int, d0 int, slot int, _group int, place int"
EXTRA = ("x", "y", 5, 5, 5, 5, 5, 5)


def table(spark, rows):
    """Rows of (doc_id, text, lang, source), with columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *EXTRA) for r in rows], SCHEMA)


def halves(rows, k, extents):
    """Brute force: rows of (coordinates, tie, size, id) in order of their leaves."""
    if k == 1 or not rows:
        return [rows] + [[] for _ in range(k - 1)]
    spans = [(max(c[0][d] for c in rows) - min(c[0][d] for c in rows)) / extents[d] for d in range(3)]
    dim = spans.index(max(spans))
    wanted = sum(r[2] for r in rows) * (k // 2) // k
    places = {}
    for r in rows:
        places.setdefault((r[0][dim], r[1]), []).append(r)
    left, right, sofar, done = [], [], 0, False
    for key in sorted(places):
        here = sum(r[2] for r in places[key])
        if not done and sofar + here >= wanted:
            done = True
            (left if sofar + here - wanted < wanted - sofar else right).extend(places[key])
        else:
            (right if done else left).extend(places[key])
        sofar += here
    return halves(left, k // 2, extents) + halves(right, k - k // 2, extents)


def expected(rows, k):
    head = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    lengths = [len(t) for _, t, _, _ in rows if t is not None]
    low, high = min(lengths, default=0), max(lengths, default=0)
    flat = []
    for i, t, lang, source in rows:
        tie = (head(t or "") >> 12 << 18) + (head("" if i is None else str(i)) >> 14)
        n = low if t is None else len(t)
        at = (0 if lang is None else head(lang) >> 8, 0 if source is None else head(source) >> 8, (n - low) * 16777215 // ((high - low) or 1))
        flat.append((at, tie, len((t or "").encode()) + 16, i))
    extents = [max(r[0][d] for r in flat) - min(r[0][d] for r in flat) or 1 for d in range(3)]
    return [sorted(str(r[3]) for r in leaf) for leaf in halves(flat, k, extents)]


def placed(spark, rows, k):
    found = sharding.shards(table(spark, rows), k).collect()
    for s in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    return found


ROWS = [(i, f"{'word ' * (i % 17)}{i % 5}", ("en", "de", None)[i % 3], ("hot" if i % 3 == 0 else f"s{i % 7}")) for i in range(300)]


def test_shards_are_those_of_brute_force(spark):
    rows = [*ROWS, (300, None, None, None), (301, "", "en", "hot"), (302, "é" * 500, "en", "hot"), (303, "long " * 5000, "de", "s1"), *[(400 + i, "copy of one text", "en", "hot") for i in range(150)]]
    found = placed(spark, rows, 7)
    assert [sorted(str(r.doc_id) for r in found if r.shard == s) for s in range(7)] == expected(rows, 7)
    texts = {i: t or "" for i, t, _, _ in rows}
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == binascii.crc32(texts[r.doc_id].encode()) for r in found)


def test_bytes_are_near_equal_though_one_text_and_source_have_a_third(spark):
    rows = [(i, "the same text in a third of all rows" if i % 3 == 0 else f"text {i} " * (i % 9), "en", "hot" if i % 2 else None) for i in range(2000)]
    found = placed(spark, rows, 12)
    total = [sum(r["size"] for r in found if r.shard == s) for s in range(12)]
    assert max(total) - min(total) <= 400
    copies = [sum(r.doc_id % 3 == 0 for r in found if r.shard == s) for s in range(12)]
    assert sum(c > 0 for c in copies) >= 3


def test_equal_texts_lie_together_where_no_border_cuts_them(spark):
    rows = [(i, f"text number {i // 4}", "en", "one") for i in range(400)]
    found = placed(spark, rows, 8)
    where = {}
    for r in found:
        where.setdefault(r.doc_id // 4, set()).add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 7


def test_repeated_rows_null_ids_and_more_shards_than_rows(spark):
    rows = [(1, "a", "en", "s")] * 5 + [(None, "b", None, None)] * 2 + [(2, None, None, None)]
    found = placed(spark, rows, 6)
    assert len(found) == 8 and {r.shard for r in found} <= set(range(6))
    assert len({r.shard for r in found if r.doc_id == 1}) == 1
    assert placed(spark, rows, 1)[0].shard == 0


def test_empty_table(spark):
    assert sharding.shards(table(spark, []), 40).count() == 0
    assert sharding.target_shards(table(spark, []), 100) == 1


def test_target_bytes(spark):
    assert sharding.target_shards(table(spark, [(i, "x" * 84, "en", "s") for i in range(50)]), 1000) == 5


def test_no_python_in_the_plan(spark):
    plan = sharding.shards(table(spark, ROWS), 4)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


@needs_data
def test_query_against_the_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rows = con.execute(f"SELECT doc_id, shard, slot, size, text_crc32 FROM ({oracles.SHARDING})").fetchall()
    found = queries.op11_kd_sharding(spark, SF).select("doc_id", "shard", "slot", "size", "text_crc32").collect()
    assert sorted(rows) == sorted(map(tuple, found))
