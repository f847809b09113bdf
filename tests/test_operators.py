"""Operators on literal rows: parsing, chunking, files, ports, state."""

import time

import pytest
from pyspark.sql import functions as F

from docmill import ports
from docmill.operators import chunking, hierarchy, ranking, reasoning, retrieval, summaries
from docmill.sources import files, settings
from docmill.streaming import caches, stateful, store

TAGGED = """[PREFACE]p[/PREFACE][BOOK]الكتاب
 الأول[/BOOK][PART]P1[/PART][CHAPTER]
C1
about
more[/CHAPTER]
[ARTICLE id=1]one  text[/ARTICLE][SECTION]S1[/SECTION][ARTICLE id="٢"]two[/ARTICLE][/SECTION]
[ARTICLE id=issuance_1]skip[/ARTICLE][CHAPTER]C2[/CHAPTER][ARTICLE id=3]three[/ARTICLE][PART]P2[/PART][ARTICLE id=4]four[/ARTICLE][ARTICLE]none[/ARTICLE]"""


def test_articles(spark):
    df = spark.createDataFrame([("law", TAGGED), ("empty", ""), ("null", None)], "source string, text string")
    rows = hierarchy.articles(df, "source", "text").orderBy("pos").collect()
    assert [(r.article_index, r.book, r.part, r.chapter, r.section, r.body) for r in rows] == [
        (1, "الكتاب الأول", "P1", "C1 - about", None, "one text"),
        (2, "الكتاب الأول", "P1", "C1 - about", "S1", "two"),
        (3, "الكتاب الأول", "P1", "C2", None, "three"),
        (4, "الكتاب الأول", "P2", None, None, "four"),
    ]
    toc = hierarchy.contents(df, "source", "text").orderBy("chapter_id").collect()
    assert [(r.chapter_id, r.title, [tuple(s) for s in r.sections]) for r in toc] == [(1, "C1 - about", [(1, "S1")]), (2, "C2", [])]


def test_nested_tags_close_the_nearest():
    found = list(hierarchy.elements("[ARTICLE id=1]a[ARTICLE id=2]b[/ARTICLE]c[/ARTICLE][/BOOK]"))
    assert [(tag, attrs, content) for _, tag, attrs, content in found] == [("ARTICLE", "id=2", "b"), ("ARTICLE", "id=1", "a[ARTICLE id=2]b[/ARTICLE]c")]


def test_paragraphs_and_pages(spark):
    text = "\n\n".join(["a" * 1500, " ", "b" * 600, "c" * 100, "d" * 1950])
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    rows = chunking.segments(df, "doc_id", "text").orderBy("paragraph_number").collect()
    assert [(r.paragraph_number, r.page_number) for r in rows] == [(1, 1), (3, 2), (4, 2), (5, 3)]
    assert [r.chunk_id for r in rows] == [r.chunk_id for r in chunking.segments(df, "doc_id", "text").orderBy("paragraph_number").collect()]
    assert chunking.paragraphs(df, "doc_id", "text").count() == 4


def test_chunks(spark):
    text = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(60)) for i in range(8)) + "\n\n" + "z" * 2500
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "short")], "doc_id int, text string")
    rows = chunking.chunks(df, "doc_id", "text").orderBy("doc_id", "chunk_index").collect()
    mine = [r.text for r in rows if r.doc_id == 1]
    assert all(0 < len(c) <= 1000 for c in mine) and [r.text for r in rows if r.doc_id == 4] == ["short"]
    assert {r.doc_id for r in rows} == {1, 4}
    words = {w for c in mine for w in c.split()}
    assert words >= {f"w{i}x{j}" for i in range(8) for j in range(60)}
    assert chunking._joined(["aa", "bb", "cc"], 4, 2) == ["aabb", "bbcc"]


def test_file_types_and_text(spark, tmp_path):
    made = {"a.txt": "نص".encode(), "b.txt": "نص".encode("cp1256"), "c.pdf": b"%PDF-1.4", "d.bin": b"\x89PNG....", "e.md": b"plain", "f.xyz": b"?", "g.jpg": b"\xff\xd8\xff"}
    for name, body in made.items():
        (tmp_path / name).write_bytes(body)
    seen = files.read_files(spark, str(tmp_path))
    kinds = {r.path.rsplit("/", 1)[1]: r.file_type for r in seen.collect()}
    assert kinds == {"a.txt": "text", "b.txt": "text", "c.pdf": "pdf", "d.bin": "image", "e.md": "text", "f.xyz": "unknown", "g.jpg": "image"}
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.extract(seen, pdf=lambda df: df.select("path", F.lit("page one").alias("text"))).collect()}
    assert (rows["a.txt"].text, rows["b.txt"].text, rows["c.pdf"].text, rows["d.bin"].text) == ("نص", "نص", "page one", "")
    assert rows["d.bin"].error and not rows["c.pdf"].error
    records = files.ingest(files.extract(seen), "case 1", F.lit("memo"), F.lit(80)).collect()
    assert {r.doc_type for r in records if not r.text} == {"unknown"} and all(r.object_key.startswith("case_1/") for r in records)
    out = str(tmp_path / "out")
    files.write_once(spark.range(3), out)
    files.write_once(spark.range(9), out)
    assert spark.read.parquet(out).count() == 3
    files.write_once(spark.range(9), out, force=True)
    assert spark.read.parquet(out).count() == 9


def test_settings():
    tree = settings.overlay({"a": {"b": 1, "c": True}, "d": "x"}, {"a": {"b": 2}, "e": []})
    assert tree == {"a": {"b": 2, "c": True}, "d": "x", "e": []}
    assert settings.flat(tree) == {"a.b": 2, "a.c": True, "d": "x", "e": []}
    got = settings.from_environment(tree, {"APP_A_B": "7", "APP_A_C": "no", "APP_D": "y"}, "app")
    assert got == {"a": {"b": 7, "c": False}, "d": "y", "e": []} and tree["a"]["b"] == 2


def test_plans(spark):
    steps = spark.createDataFrame([("a", "law", "q", []), ("b", "law", "q", ["a"]), ("c", "x", "", ["z"]), ("a", "law", "q", [])], "step_id string, tool string, query string, depends_on array<string>")
    faults = {(r.fault, r.step_id) for r in reasoning.plan_faults(steps, ["law"]).collect()}
    assert faults == {("duplicate_id", "a"), ("unknown_tool", "c"), ("empty_query", "c"), ("unknown_dependency", "c")}
    good = steps.filter("step_id = 'b'").unionByName(steps.filter("step_id = 'a'").limit(1))
    assert reasoning.plan_is_valid(good, ["law"]) and not reasoning.plan_is_valid(steps, ["law"]) and not reasoning.plan_is_valid(steps.limit(0), ["law"])
    results = spark.createDataFrame([("a", "said")], "step_id string, response string")
    assert [tuple(p) for p in reasoning.prior_results(good, results).first().prior] == [("a", "said")]


def test_confidence_formula(spark):
    row = [(1, 4, 1, 2, 0, 0, 0, "minor", None, True), (2, 0, 0, 0, 0, 2, 1, "none", 0.0, False)]
    names = "issue_id int, n_elements int, n_unsupported int, n_disputed int, n_insufficient int, n_citations int, n_missing int, severity string, coverage double, conflict boolean"
    got = {r.issue_id: (round(r.score, 6), r.level) for r in reasoning.confidence(spark.createDataFrame(row, names)).collect()}
    assert got == {1: (round(1 - 0.0625 - 0.075 - 0.05 - 0.05, 6), "high"), 2: (round(1 - 0.075 - 0.1, 6), "high")}


def test_word_confidence(spark):
    tokens = spark.createDataFrame([(1, 0, "he", 0.5), (1, 1, "llo", 1.0), (1, 2, " you", 0.8)], "page int, pos int, token string, p double")
    assert sorted((r.word, r.confidence) for r in reasoning.word_confidence(tokens, "page", "pos", "token", "p").collect()) == [("hello", 0.75), ("you", 0.8)]


def test_ghost_parties(spark):
    df = spark.createDataFrame([("x", ["a"]), ("x one", ["b"]), ("x two", ["a", "c"]), ("y", ["d"])], "party string, doc_types array<string>")
    assert {r.party: r.doc_types for r in summaries.merge_ghosts(df).collect()} == {"x one": ["a", "b"], "x two": ["a", "c"], "y": ["d"]}


def test_retry_until(spark):
    tries = lambda df, n: df.withColumn("found", F.col("need") <= n)
    rows = retrieval.retry_until(spark.createDataFrame([(1,), (2,), (9,)], "need int"), tries, F.col("found"), 2).collect()
    assert sorted((r.need, r.attempts, r.found) for r in rows) == [(1, 1, True), (2, 2, True), (9, 2, False)]


def test_ports(spark):
    df = spark.createDataFrame([(1, "x y z"), (2, "nothing"), (3, "x")], "i int, body string")
    table = {"one": ["x", "y", "z"], "two": ["q"]}
    rows = {r.i: (r.doc_type, r.confidence, r.method) for r in ports.classify(df, "body", table).collect()}
    assert rows == {1: ("one", 75, "keywords"), 2: ("unknown", 30, "port"), 3: ("one", 30, "port")}
    model = ports.Ports(label=lambda c: F.struct(F.lit("two").alias("label"), F.lit(0.9).alias("confidence")))
    assert {r.doc_type for r in ports.classify(df, "body", table, model).collect() if r.i != 1} == {"two"}
    v = df.select(ports.hashed_embedding(F.col("body")).alias("v")).first().v
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-9
    steps = spark.createDataFrame([("a", "up", "q"), ("b", "down", "q")], "step_id string, tool string, query string")
    ran = ports.run_tools(steps, {"up": lambda s: s.select("step_id", F.upper("query").alias("response"))}, ["up"]).collect()
    assert {(r.step_id, r.status, r.response) for r in ran} == {("a", "success", "Q"), ("b", "failed", "unknown tool: down")}


def test_counter_fold(spark):
    df = spark.createDataFrame([([2, 2, 3, 2, 2, 9],)], "s array<int>")
    assert df.select(stateful.counter_fold(F.col("s"), 6).alias("h")).first().h == [3, 6]


def test_last_reset_and_capped(spark):
    rows = spark.createDataFrame([("a", 1, "e1"), ("a", 2, "e2"), ("b", 3, "e3")], "step string, seq int, error string")
    got = ranking.first_capped(rows, "step", "seq", 2).first()
    assert (got.step, got.failures, got.last_error) == ("a", 2, "e2")
    assert [r.seq for r in ranking.append_or_reset(rows, "step", "seq", F.col("error") == "e1").orderBy("seq").collect()] == [2, 3]


def run_stream(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


@pytest.fixture
def event_files(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:{s:02d}", "click", float(s)) for s in (0, 1, 2, 3)] + [(1, "2024-01-01 00:01:30", "click", 5.0), (2, "2024-01-01 00:00:10", "view", 1.0)]
    df = spark.createDataFrame(rows, "user_id int, at string, event_type string, value double").select("user_id", F.to_timestamp("at").alias("ts"), "event_type", "value")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return df, str(tmp_path / "in"), tmp_path


def test_rate_limit_stream_equals_batch(spark, event_files):
    df, path, tmp = event_files
    stream = spark.readStream.schema(df.schema).parquet(path)
    out = caches.rate_limited_stream(stream, "user_id", "ts", limit=3, seconds=60)
    run_stream(out.writeStream.format("parquet").option("checkpointLocation", str(tmp / "c")).option("path", str(tmp / "o")).start())
    batch = stateful.rate_limited(df.withColumn("seq", F.lit(0)), "user_id", "ts", "seq", limit=3, seconds=60)
    rows = lambda d: sorted((r.user_id, r.ts, r.n, r.allowed) for r in d.collect())
    assert rows(spark.read.parquet(str(tmp / "o"))) == rows(batch)
    assert [x[3] for x in rows(batch)] == [True, True, True, False, True, True]


def test_upsert_stream(spark, event_files):
    df, path, tmp = event_files
    stream = spark.readStream.schema(df.schema).parquet(path)
    run_stream(store.upsert_stream(stream, ["user_id"], "ts", str(tmp / "t"), str(tmp / "c")))
    assert sorted((r.user_id, r.value) for r in store.read(spark, str(tmp / "t")).collect()) == [(1, 5.0), (2, 1.0)]


def test_windowed_counts(spark, event_files):
    df, path, tmp = event_files
    counted = stateful.windowed_counts(spark.readStream.schema(df.schema).parquet(path), "ts", "event_type", "value", size="1 minute")
    name = f"counts{int(time.time())}"
    run_stream(counted.writeStream.outputMode("complete").format("memory").queryName(name).start())
    assert sorted((r.event_type, r.n, r.total) for r in spark.table(name).collect()) == [("click", 1, 5.0), ("click", 4, 6.0), ("view", 1, 1.0)]


def test_item_ids_beyond_three_digits(spark):
    rows = spark.range(1, 1013).select("id", F.lit("s").alias("key"), F.lit("k").alias("kind"))
    got = {r.id: r.item_id for r in ranking.item_ids(rows, "key", "kind", [F.col("id")], {"k": "A"}).collect()}
    assert got == {i: f"A{i:03d}" for i in range(1, 1013)}
