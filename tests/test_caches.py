import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators import dispatch
from docmill.streaming import caches

SETTINGS = {"spark.sql.streaming.noDataMicroBatches.enabled": "true"}
SCHEMA = "k string, ts timestamp, seq long, op string, value string"


def at(minute):
    return f"2024-01-01 {int(minute) // 60:02d}:{int(minute) % 60:02d}:{int(minute * 60) % 60:02d}"


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema.replace("ts timestamp", "t string")).selectExpr(*[f"timestamp(t) AS {c}" if c == "ts" else c for c in (x.split()[0] for x in schema.split(", "))])


@pytest.fixture
def streamed(spark, tmp_path):
    """Runs files of rows through a stream, one micro-batch for each, and gives its rows and the state's sizes."""

    def run(batches, schema, build):
        where = str(tmp_path / "in")
        for rows in batches:
            table(spark, rows, schema).coalesce(1).write.mode("append").parquet(where)
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where)
        q = build(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        sizes = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress]
        return spark.read.parquet(str(tmp_path / "out")), sizes

    return run


def requests(n_keys, seed):
    rng = np.random.default_rng(seed)
    rows = [(f"k{rng.integers(n_keys)}", at(i * 1.5), i, str(rng.choice(["get", "get", "set", "clear"], p=[0.4, 0.3, 0.25, 0.05])), f"v{i}") for i in range(240)]
    return [rows[i : i + 60] for i in range(0, 240, 60)]


def test_reads_as_a_plain_loop(spark):
    batches = requests(4, 1)
    rows = [r for b in batches for r in b]
    held, want = {}, {}
    for k, t, i, op, v in rows:
        minute = i * 1.5
        if op == "get":
            want[i] = held[k][0] if k in held and minute - held[k][1] < 20 else None
        else:
            held.pop(k, None)
            if op == "set":
                held[k] = (v, minute)
    found = {r.seq: r.found for r in caches.reads(table(spark, rows, SCHEMA), ["k"], "ts", "seq", "op", "value", 1200).collect()}
    assert found == want and any(want.values())


def test_the_stream_reads_as_the_batch_and_forgets(spark, streamed):
    batches = [*requests(30, 2), [("z", at(1400), 900, "get", "")], [("z", at(1401), 901, "get", "")]]
    whole = table(spark, [r for b in batches for r in b], SCHEMA)
    want = caches.reads(whole, ["k"], "ts", "seq", "op", "value", 1200)
    got, sizes = streamed(batches, SCHEMA, lambda s: caches.reads_stream(s, ["k"], "ts", "seq", "op", "value", 1200))
    rows = lambda df: sorted((r.k, r.ts, r.seq, r.found or "") for r in df.collect())
    assert rows(got) == rows(want) and any(r[3] for r in rows(got))
    assert max(sizes) > 10 and sizes[-1] <= 4  # an entry and its timer for keys alive, none at the end


VECTORS = "p string, seq long, op string, v array<double>"


def vector_requests(seed, n=200):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = rng.normal(size=6)
        out.append((f"p{rng.integers(3)}", i, "set" if rng.random() < 0.5 else "get", (v / np.linalg.norm(v)).tolist()))
    return [out[i : i + n // 4] for i in range(0, n, n // 4)]


def plain_nearest(rows, threshold, keep):
    held, out = {}, []
    for p, i, op, v in rows:
        if op == "set":
            held[p] = [*held.get(p, []), (i, v)][-keep:]
        elif held.get(p):
            near = [(round(float(np.dot(v, x)), 6), -j, s) for j, (s, x) in enumerate(held[p])]
            best = max(near)
            if best[0] >= threshold:
                out.append((i, best[2], best[0]))
    return out


@pytest.mark.parametrize("keep", [1, 7, 500])
def test_nearest_reads_as_a_plain_loop(spark, keep):
    rows = [r for b in vector_requests(3) for r in b]
    found = caches.nearest_reads(spark.createDataFrame(rows, VECTORS), "p", "seq", "op", "v", 0.5, keep)
    want = plain_nearest(rows, 0.5, keep)
    assert sorted(map(tuple, found.collect())) == want and want


def test_the_nearest_stream_evicts_the_oldest(spark, streamed):
    batches = vector_requests(4)
    got, sizes = streamed(batches, VECTORS, lambda s: caches.nearest_reads_stream(s, "p", "seq", "op", "v", 0.5, 7))
    assert sorted(map(tuple, got.collect())) == plain_nearest([r for b in batches for r in b], 0.5, 7)
    assert max(sizes) <= 3 * 7 + 3


def test_postponed_stream_is_the_batch(spark, streamed):
    rng = np.random.default_rng(5)
    schema = "k string, ts timestamp, seq long"
    rows = [(f"k{rng.integers(12)}", at(i * 2), i) for i in range(200)]
    batches = [rows[i : i + 50] for i in range(0, 200, 50)]
    late = [("k1", at(5), 950)]  # far behind the watermark: dropped
    last = [[("z", at(1300), 990)], [("z", at(1310), 991)]]
    got, sizes = streamed([*batches, last[0], late, last[1]], schema, lambda s: caches.postponed_stream(s, "k", "ts", "seq", 1500, "10 minutes"))
    want = dispatch.postponed(table(spark, [*rows, *last[0], *last[1]], schema), "k", "ts", "seq", 1500)
    told = lambda df: sorted((r.k, r.seq, r.due) for r in df.filter("k <> 'z'").collect())
    assert told(got) == told(want) and len(told(got)) > 12
    assert sizes[-1] <= 4


def test_sliding_windows_and_repeats_as_the_batch(spark, streamed):
    from docmill.streaming import stateful

    schema = "k string, ts timestamp, seq long"
    rows = [(f"k{i % 3}", at(i * 3), i) for i in range(100)]
    late = [("k0", at(1), 700)]  # behind the watermark: in no window
    last = [("z", at(1300), 990)]
    build = lambda s: stateful.sliding_counts(s, "ts", "k", "seq", "60 minutes", "20 minutes").select(F.col("window.start").alias("start"), "k", "n", "total")
    got, _ = streamed([rows[:50], rows[50:], late, last], schema, build)
    want = table(spark, rows, schema).groupBy(F.window("ts", "60 minutes", "20 minutes").alias("w"), "k").agg(F.count("*").alias("n"), F.sum("seq").alias("total")).select("w.start", "k", "n", "total")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_repeats_are_dropped_and_forgotten(spark, streamed):
    from docmill.streaming import stateful

    schema = "k string, ts timestamp, seq long"
    batches = [[("a", at(0), 1), ("a", at(1), 2), ("b", at(2), 3)], [("a", at(9), 4), ("c", at(200), 5)], [("c", at(200), 8)], [("a", at(201), 6), ("a", at(202), 7)]]
    got, sizes = streamed(batches, schema, lambda s: stateful.deduplicated(s, ["k"], "ts", "30 minutes"))
    assert sorted((r.k for r in got.collect())) == ["a", "a", "b", "c"] and max(sizes) <= 3
