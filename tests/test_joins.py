import math
import random

from pyspark.sql import functions as F

from docmill.operators import graphs, joins, metrics


def test_asof_with_a_hot_key_ties_and_nulls(spark):
    rng = random.Random(1)
    minute = lambda m: f"2024-01-{1 + m // 1440:02d} {m // 60 % 24:02d}:{m % 60:02d}:00"
    key = lambda: rng.choice(["hot", "hot", "a", "b", "c", None])
    left = [(i, key(), rng.randrange(4000)) for i in range(400)] + [(900, "hot", None), (901, "nobody", 50)]
    right = [(key(), rng.randrange(4000), i) for i in range(300)] + [("hot", 100, 5), ("hot", 100, 950)]
    frame = lambda rows, schema, at: spark.createDataFrame([tuple(None if x is None else minute(x) if i == at else x for i, x in enumerate(r)) for r in rows], schema).withColumn("ts", F.to_timestamp("ts"))
    found = {r.id: r.found for r in joins.asof(frame(left, "id long, k string, ts string", 2), frame(right, "k string, ts string, found long", 1), ["k"], "ts", "found", slices=8).collect()}
    want = {}
    for i, k, t in left:
        before = [(rt, v) for rk, rt, v in right if k is not None and t is not None and rk == k and rt <= t]
        want[i] = max(before)[1] if before else None
    assert found == want and len(set(found.values())) > 50


def test_asof_empty_sides(spark):
    none = spark.createDataFrame([], "k string, ts timestamp, v long")
    assert joins.asof(none.drop("v"), none, ["k"], "ts", "v").count() == 0
    one = spark.sql("SELECT 'a' AS k, timestamp('2024-01-01') AS ts")
    assert joins.asof(one, none, ["k"], "ts", "v").collect()[0].v is None


def test_ranges_of_very_different_lengths(spark):
    rng = random.Random(2)
    points = [(i, rng.uniform(-1000, 1000)) for i in range(500)] + [(600, None), (601, 5.0), (602, 5.0)]
    ranges = [(i, low := rng.uniform(-1000, 1000), low + rng.choice([0.0, 0.01, 1.0, 30.0, 1500.0])) for i in range(300)]
    ranges += [(400, 5.0, 5.0), (401, 7.0, 6.0), (402, None, 3.0), (403, -1e6, 1e6), (404, 5.0, 5.0)]
    p, r = spark.createDataFrame(points, "p long, at double"), spark.createDataFrame(ranges, "r long, low double, high double")
    for base in (None, 0.01, 1000.0):
        out = joins.in_ranges(p, r, "at", "low", "high", base)
        found = sorted((x.p, x.r) for x in out.collect())
        assert found == sorted((i, j) for i, x in points for j, a, b in ranges if x is not None and a is not None and a <= x <= b)
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    placed = r.filter("r < 400").count()
    assert joins.in_ranges(p, r.limit(0), "at", "low", "high").count() == 0 and placed == 300


def test_ranges_are_counted_without_pairs(spark):
    rng = random.Random(5)
    value = lambda: float(rng.randrange(60))
    points = [value() for _ in range(400)] + [None, 70.5, -70.5]
    ranges = [(i, low := value(), low + rng.choice([0.0, 0.5, 3.0, 40.0])) for i in range(200)]
    ranges += [(300, 8.0, 7.0), (301, None, 3.0), (302, 3.0, None), (303, -1e9, 1e9), (304, 61.0, 70.0), (305, 80.0, 90.0), (303, -1e9, 1e9)]
    p, r = spark.createDataFrame([(x,) for x in points], "at double"), spark.createDataFrame(ranges, "r long, low double, high double")
    want = []
    for i, a, b in ranges:
        if a is not None and b is not None and (own := [x for x in points if x is not None and a <= x <= b]):
            want.append((i, len(own), min(own), max(own)))
    held = lambda p, r: sorted((x.r, x.n, x.least, x.most) for x in joins.counted_ranges(p, r, "at", "low", "high").collect())
    assert held(p, r) == sorted(want) and len(want) > 150
    assert held(p.limit(0), r) == held(p, r.limit(0)) == []
    whole = held(p.filter("at = floor(at)").selectExpr("cast(at AS int) AS at"), r)
    assert [x[0] for x in whole] == [x[0] for x in sorted(want)] and isinstance(whole[0][2], int)


def test_a_range_join_reads_every_row_a_few_times(spark):
    """3,000 points in each of 3,000 ranges: nine million pairs, of which none is made."""
    p, r = spark.range(3000).selectExpr("id AS at"), spark.range(3000).selectExpr("id AS r", "-id AS low", "3000 + id AS high")
    out = joins.counted_ranges(p, r, "at", "low", "high")
    assert {(x.n, x.least, x.most) for x in out.collect()} == {(3000, 0, 2999)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Generate" not in plan


def test_peeling_of_many_plans(spark):
    rng = random.Random(3)
    steps = []
    for plan in range(40):
        n = rng.randrange(1, 9)
        for s in range(n):
            deps = [f"{plan}-{d}" for d in range(n) if d != s and rng.random() < 0.18]
            steps.append((f"{plan}-{s}", deps + ([f"{plan}-99"] if rng.random() < 0.03 else []) if rng.random() < 0.95 else None))
    steps.append(("self", ["self"]))
    needs = {s: set(d or []) for s, d in steps}
    wave, done, n = {}, set(), 0
    while now := {s for s in needs if s not in done and needs[s] <= done}:
        n += 1
        wave |= dict.fromkeys(now, n)
        done |= now
    df = spark.createDataFrame(steps, "step_id string, depends_on array<string>")
    assert {r.step_id: r.wave for r in graphs.peeled(df, "step_id", "depends_on").collect()} == {s: wave.get(s) for s in needs}

    def reach(s, edges):
        seen, todo = set(), list(edges.get(s, ()))
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += edges.get(x, ())
        return seen

    back = {}
    for s, d in needs.items():
        for x in d & set(needs):
            back.setdefault(x, set()).add(s)
    fore = {s: d & set(needs) for s, d in needs.items()}
    on = {s for s in needs if s in reach(s, fore)}
    want = {s for s in needs if s in on or (reach(s, fore) & on and reach(s, back) & on)}
    assert {r.step_id for r in graphs.looped(df, "step_id", "depends_on").collect()} == want and "self" in want and len(want) > 5
    empty = df.limit(0)
    assert graphs.peeled(empty, "step_id", "depends_on").count() == graphs.looped(empty, "step_id", "depends_on").count() == 0


def test_sketches_merge_and_keep_their_bound(spark):
    rng = random.Random(4)
    rows = [(f"d{i % 5}", f"l{i % 3}", rng.lognormvariate(0, 3), i % 777) for i in range(6000)] + [("d0", "l0", None, None), ("d1", "l0", 0.0, 1), ("d1", "l1", -4.0, 2)]
    df = spark.createDataFrame(rows, "day string, label string, v double, who long")
    counts, seen = metrics.sketch(df, ["day", "label"], "v", "who")
    for labels in (["label"], ["day"], []):
        groups = {}
        for d, l, v, w in rows:
            if v is not None:
                groups.setdefault(tuple({"day": d, "label": l}[x] for x in labels), []).append(max(v, 0.0))
        for r in metrics.quantiles(counts, labels, (0.01, 0.5, 0.95, 0.99, 1.0)).collect():
            own = sorted(groups[tuple(r[x] for x in labels)])
            exact = own[max(1, math.ceil(r.share * len(own) - 1e-9)) - 1]
            assert r.n == len(own) and abs(r.value - exact) <= 0.01 * exact + 1e-9
    assert abs(metrics.distinct(seen, []).first().n - 777) <= 777 * 0.05
    hist = metrics.histogram(df, ["label"], "v").filter("label = 'l0'").orderBy("le").collect()
    own = [v for _, l, v, _ in rows if l == "l0" and v is not None]
    assert [r.n for r in hist] == [sum(v <= b for v in own) for b in metrics.LATENCY_BOUNDS] + [len(own)]
