import hashlib
import random

import numpy as np
import pytest

from docmill.llm import queries, suffix_dedup as s
from tests.llm.helpers import SF, clashing, docs, needs_data


def plain(rows):
    """id, n_bytes, n_removed, n_spans, kept of each row, by a table of all windows."""
    last = (1 << 63) - 1
    least = {}
    for k, t in rows:
        k = last if k is None else k
        for i in range(len(t) - 49):
            least[t[i : i + 50]] = min(least.get(t[i : i + 50], last), k)
    out = []
    for k, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if least[t[i : i + 50]] < (last if k is None else k):
                gone[i : i + 50] = b"\1" * 50
        runs = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((k, len(t), sum(gone), runs, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def odd_rows(n=70):
    pick = random.Random(5)
    base = ["".join(pick.choice("xyz é") for _ in range(300)) for _ in range(4)]
    part = lambda: pick.choice(["a" * pick.randint(1, 700), "ab" * pick.randint(1, 300), base[pick.randrange(4)][pick.randint(0, 250) :], "é" * pick.randint(1, 60), "\0" * pick.randint(1, 99)])
    rows = [(i, "".join(part() for _ in range(pick.randint(0, 5)))) for i in range(n)]
    return [*rows, (3, base[0]), (3, base[0]), (n, None), (None, base[1] * 2), (None, base[1]), (n + 1, base[2] * 40)]


def removed(rows):
    """Of each row its bytes, and for each byte whether it goes."""
    last = (1 << 63) - 1
    least = {}
    for k, t in rows:
        for i in range(len(t) - 49):
            least[t[i : i + 50]] = min(least.get(t[i : i + 50], last), last if k is None else k)
    for k, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if least[t[i : i + 50]] < (last if k is None else k):
                gone[i : i + 50] = b"\1" * 50
        yield t, gone


def by_windows(rows):
    return removed([(k, (t or "").encode()) for k, t in rows])


def whole(row):
    """The characters that lost no byte."""
    text, gone = row
    out, at = [], 0
    for c in text.decode():
        n = len(c.encode())
        if not any(gone[at : at + n]):
            out.append(c)
        at += n
    return "".join(out)


def by_row(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("letters", [b"ab", b"a", b"\0", b"\0\1", b"abcdefgh \n\0"])
def test_suffix_array_and_prefixes(letters):
    pick = random.Random(2)
    raw = bytes(pick.choice(letters) for _ in range(1500))
    data = np.frombuffer(raw, np.uint8)
    order = s.suffix_array(data)
    assert sorted(order.tolist()) == list(range(len(raw)))
    assert [raw[i : i + 50] for i in order] == sorted(raw[i : i + 50] for i in range(len(raw)))

    def common(a, b):
        n = 0
        while n < 50 and max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        return n

    assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(len(raw)))
    want = [common(a, b) for a, b in zip(order[1:], order)]
    for cuts in ([0], [0, 1, 60, 700, 1499]):
        starts = np.array(cuts)
        assert s.common_prefixes(data, order, starts, np.diff([*cuts, len(raw)])).tolist() == [0, *want]


def test_pieces_hold_each_window_once():
    texts = [t.encode() for _, t in odd_rows() if t]
    data, start, windows, _ = s.pieces(texts)
    held = [i for a, n in zip(start.tolist(), windows.tolist()) for i in range(a, a + n)]
    ends = np.cumsum([len(t) for t in texts])
    want = [i for e, t in zip(ends, texts) for i in range(e - len(t), e - 49)]
    assert held == want and windows.max() <= s.RUN


def test_several_arrays_are_merged(monkeypatch):
    pick = random.Random(4)
    base = [bytes(pick.choice(b"pqr\0") for _ in range(90)) for _ in range(6)]
    contexts = list({base[pick.randrange(6)][: pick.randint(55, 90)] + bytes(pick.choice(b"mn") for _ in range(pick.randint(0, 30))) for _ in range(60)})
    windows, ids = np.array([len(c) - 49 for c in contexts]), np.array([pick.randint(0, 99) for _ in contexts])
    one = s.smallest_ids(contexts, windows, ids)
    monkeypatch.setattr(s, "ARRAY", 300)
    assert one.tolist() == s.smallest_ids(contexts, windows, ids).tolist()
    least = {}
    for c, k in zip(contexts, ids.tolist()):
        for i in range(len(c) - 49):
            least[c[i : i + 50]] = min(least.get(c[i : i + 50], 99), k)
    assert one.tolist() == [least[c[i : i + 50]] for c in contexts for i in range(len(c) - 49)]


def test_halves_of_characters_make_no_character(spark):
    z = "z" * 50
    rows = [(1, "\u00e9"[:0] + "q\u00e9"), (2, "é" + z + "é"), (3, "q" + "é" * 24 + "\u0120" + "r")]
    rows += [(0, z), (4, "é" + z + "é"), (2**63 - 1, "x" + z), (None, z + "y")]
    got = {r.doc_id: (r.kept, r.n_removed) for r in s.dedup(docs(spark, rows), as_text=True).collect()}
    assert got[2] == ("éé", 50) and got[4] == ("", 54) and got[2**63 - 1] == ("x", 50) and got[None] == ("y", 50) and got[0] == (z, 0)
    assert s.whole_characters("aéb".encode(), [(2, 3)]) == [(1, 3)] and s.whole_characters("aéb".encode(), [(0, 2)]) == [(0, 3)]


def test_clashing_columns(spark):
    df = clashing(spark, [(1, "k" * 60), (2, "k" * 60), (2, "k" * 60), (3, None)])
    out = s.dedup(df, keep=["_id", "_0", "kept", "_text"])
    assert out.columns == ["doc_id", "_id", "_0", "kept", "_text", "n_bytes", "n_removed", "n_spans", "kept"]
    assert sorted((r[0], r[6]) for r in out.collect()) == [(1, 0), (2, 60), (2, 60), (3, 0)]


def test_arrays_decide_a_hot_passage(spark, monkeypatch):
    """One passage in a third of all rows; small packs, shards and arrays, so everything meets over several."""
    pick = random.Random(9)
    hot = "".join(pick.choice("abcdefgh ") for _ in range(200))
    rows = [(i, "".join(pick.choice("abcd") for _ in range(pick.randint(0, 90))) + (hot if i % 3 == 0 else "") + f" {i} " * 20) for i in range(240)]
    monkeypatch.setattr(s, "PACK", 4000)
    monkeypatch.setattr(s, "SHARD", 8000)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in s.dedup(docs(spark, rows)).collect()]
    assert by_row(got) == by_row(plain([(k, t.encode()) for k, t in rows]))


def test_odd_rows(spark):
    rows = odd_rows()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in s.dedup(docs(spark, rows)).collect()]
    assert by_row(got) == by_row(plain([(k, (t or "").encode()) for k, t in rows]))
    text = s.dedup(docs(spark, rows), keep=["score", "ids"], as_text=True)
    assert text.columns == ["doc_id", "score", "ids", "n_bytes", "n_removed", "n_spans", "kept"]
    assert sorted(r.kept for r in text.collect()) == sorted(whole(r) for r in by_windows(rows))
    assert s.dedup(docs(spark, []).select("doc_id", "text")).count() == 0


@needs_data
def test_query(spark):
    rows = [(r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {k: (n, gone, runs, hashlib.sha256(kept).hexdigest()) for k, n, gone, runs, kept in plain(rows)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op8_suffix_array_dedup(spark, SF).collect()} == want
