import hashlib

import duckdb
import numpy as np
import pytest

from docmill.llm import oracles, queries, vector_codes
from tests.llm.helpers import SF, needs_data

SCHEMA = "vec_id long, embedding array<float>, label int, x int, code string, upper int, lower int, error string, cell int, v int, _label int, label_error int"
EXTRA = (1, "x", 1, 1, "x", 1, 1, 1, 1)


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def expected(rows, parts, entries, rounds):
    kept = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int), label) for i, v, label in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    x = np.array([r[1] for r in kept]).reshape(len(kept), parts, -1)
    books = np.array([r[1] for r in order[:entries]]).reshape(-1, parts, x.shape[2]).transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        d = np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(-1) for p in range(parts)], 1)
        code = d.argmin(2)
        if k < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    if (at := code[:, p] == e).any():
                        books[p, e] = [int(s) // int(at.sum()) for s in x[at, p].sum(0)]
    error = d.min(2).sum(1)
    by_label = {}
    for r, e in zip(kept, error):
        by_label[r[2]] = by_label.get(r[2], 0) + int(e)
    return sorted((str(r[0]), bytes(c.tolist()).hex(), int(e), by_label[r[2]]) for r, c, e in zip(kept, code, error)), books


def coded(spark, rows, parts, entries, rounds):
    found, books = vector_codes.compress(table(spark, rows), parts, entries, rounds)
    return sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in found.collect()), books


def test_against_brute_force_with_nulls_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 1 + i % 3, 8).astype(float).tolist(), None if i % 4 == 0 else i % 3) for i in range(400)]
    rows += [(900 + i, [0.5] * 8, 1) for i in range(200)] + [(3, rows[3][1], 2)] * 3
    rows += [(None, [1.0] * 8, None), (1000, None, 1), (1001, [None] * 8, 1), (1002, [float("nan")] + [0.0] * 7, 1), (1003, [float("inf")] * 8, 1), (1004, [-0.001, 0.0, 1e4, -1e4, 0.0, 0.0, 0.0, 0.0], 9)]
    for parts, entries, rounds in ((4, 16, 2), (2, 5, 4), (8, 256, 1), (1, 3, 0)):
        want, books = expected(rows, parts, entries, rounds)
        got, found = coded(spark, rows, parts, entries, rounds)
        assert got == want and found.tolist() == books.tolist()


def test_grid_vectors_full_of_ties(spark):
    rows = [(i, [float(i % 4), float(i // 4 % 4), float(i // 16 % 4), 0.0], i % 2) for i in range(256)]
    for entries in (7, 64):
        want, books = expected(rows, 2, entries, 3)
        got, found = coded(spark, rows, 2, entries, 3)
        assert got == want and found.tolist() == books.tolist()


def test_few_and_no_vectors(spark):
    rows = [(5, [1.0, 2.0], None), (4, [1.0, 2.0], None)]
    assert coded(spark, rows, 2, 64, 2)[0] == expected(rows, 2, 64, 2)[0]
    found, books = vector_codes.compress(table(spark, [(1, None, 2)]), 2)
    assert found.count() == 0 and found.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert vector_codes.digest(books) == hashlib.sha256(b"").hexdigest()


def test_lengths_that_do_not_fit_are_errors(spark):
    with pytest.raises(ValueError):
        vector_codes.compress(table(spark, [(1, [1.0, 2.0, 3.0], 2)]), 2)
    with pytest.raises(Exception, match="differing lengths"):
        vector_codes.compress(table(spark, [(1, [1.0, 2.0], 2), (2, [1.0, 2.0], 2), (3, [1.0] * 4, 2)]), 2, entries=1)[0].collect()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    centres = rng.integers(-3000, 3000, (16, 4))
    x = (centres[rng.integers(0, 16, 3000)] + rng.integers(-40, 40, (3000, 4)))[:, None, :].astype(np.int64)
    books = x[:16].transpose(1, 0, 2).copy()
    known = vector_codes.Bounds.unknown(len(x), 1, 16)
    computed = []
    for _ in range(5):
        computed.append(vector_codes.assign(x, books, known))
        d = ((x - books[0][None]) ** 2).sum(-1)
        assert (known.code[:, 0] == d.argmin(1)).all()
        assert (known.lower[:, 0] ** 2 <= d).all() and (known.upper[:, 0] ** 2 >= d.min(1)).all()
        sums = np.array([[x[known.code[:, 0] == e, 0].sum(0) for e in range(16)]])
        counts = np.array([np.bincount(known.code[:, 0], minlength=16)])
        better = vector_codes.moved_means(books, sums, counts)
        known.shift(np.sqrt(((better - books) ** 2).sum(-1)) + 1e-9)
        books = better
    assert computed[0] < 3000 * 16 and computed[-1] < computed[0] / 2


def test_stored_bounds_are_no_larger():
    rng = np.random.default_rng(6)
    lower = np.abs(rng.normal(size=(500, 3, 7)) * 10.0 ** rng.integers(-3, 9, (500, 3, 1)))
    lower[0], lower[1, 0] = 0, 5.0
    back = vector_codes.grown(*vector_codes.shrunk(lower))
    assert (back <= lower).all() and (lower - back <= lower.max(2, keepdims=True) / 250).all()


@needs_data
def test_query_against_the_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    rows = con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({oracles.VECTOR_CODES})").fetchall()
    assert sorted(rows) == sorted(map(tuple, queries.op13_vector_codes(spark, SF).collect()))
