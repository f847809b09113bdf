import hashlib

import pytest

from docmill.llm import queries, warc
from tests.llm.helpers import SF, needs_data


def expected(pages):
    least = {}
    for k, html in pages:
        body = (html or "").encode()
        if len(body) >= 100:
            least[body] = min(least.get(body, 1 << 62), k)
    out = {}
    for k, html in pages:
        body = (html or "").encode()
        first = least.get(body, k)
        kind = ("revisit", first) if first < k else ("response", None)
        out[k] = (len(body), hashlib.sha256(body).hexdigest(), *kind)
    return out


def found(spark, path):
    return {r.id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolve(warc.read(spark, path)).collect()}


PAGES = [
    (1, None, "a" * 5000), (2, "u\r\nx", "a" * 5000), (3, "u", None), (4, "u", ""), (5, "u", "a" * 99), (6, "u", "a" * 99),
    (7, "u", "é\r\n\r\nWARC/1.1\r\n" * 3000), (8, "u", "é\r\n\r\nWARC/1.1\r\n" * 3000), (9, "u", "b" * 100), (10, "u", "b" * 100),
]


def test_round_trip_with_many_segments(spark, tmp_path):
    df = spark.createDataFrame([(*p, "x", 3) for p in PAGES], "page_id long, url string, html string, id string, digest int")
    warc.write(df, str(tmp_path / "w"), segment=1000, chunk=70)
    assert found(spark, str(tmp_path / "w")) == expected([(k, h) for k, _, h in PAGES])
    bodies = {r.id: r.payload for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert all(bytes(bodies[k]) == (h or "").encode() for k, _, h in PAGES if bodies[k] is not None)


def test_odd_ids_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(None, "u", "q" * 200), (5, "u", "q" * 200), (5, "u", "q" * 200)], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"))
    kinds = sorted((str(r.id), r.record_type, r.refers_to) for r in warc.resolve(warc.read(spark, str(tmp_path / "w"))).collect())
    assert kinds == [("5", "response", None), ("5", "response", None), ("None", "revisit", 5)]
    warc.write(df.filter("page_id < 0"), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def test_framing_faults_are_seen():
    assert warc.unchunked(warc.chunked(b"x" * 1000, 7)) == b"x" * 1000
    assert warc.unchunked(b"3;name=v\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"9\r\nabc\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.parse(warc.record({"WARC-Type": "response"}, b"abc")[:-1]))


def test_a_missing_segment_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "z" * 5000)], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"), segment=1000)
    whole = next(p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")).read_bytes()
    whole = warc.plain(whole)
    kept = [warc.record({k.upper(): v for k, v in f.items() if k != "content-length"}, b) for f, b in warc.parse(whole) if f.get("warc-segment-number") != "3"]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "part-0").write_bytes(b"".join(r + b"\r\n\r\n" for r in kept))
    with pytest.raises(Exception, match="segments are missing"):
        warc.read(spark, str(tmp_path / "x")).collect()


@needs_data
def test_query(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    rows = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op9_warc_roundtrip(spark, SF).collect()}
    assert rows == expected(pages)
