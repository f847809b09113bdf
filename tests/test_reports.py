"""Ends of flows and small operators on odd rows."""

import pytest
from pyspark.sql import functions as F

from docmill.functions import guards
from docmill.operators import cases, chunking, citations, ranking, reports as R, retrieval, steps, summaries
from docmill.sources import files


def one(df):
    return df.collect()[0]


def test_brief_of_missing_parts(spark):
    schema = "case string, role string, pos int, summary string, disputes array<string>"
    rows = [("a", R.FACTS, 2, "fact two. more", None), ("a", R.FACTS, 1, "fact one", ["x", "y"]), ("a", R.REQUESTS, 3, None, []), ("a", R.UNKNOWN, 0, "ignored.", None), ("b", R.LEGAL, 1, "", ["law"]), (None, R.DEFENCES, 1, "said", None)]
    got = {r.case: r for r in R.fallback_brief(spark.createDataFrame(rows, schema), "case", "role", "pos", "summary", "disputes").collect()}
    assert got["a"].dispute_summary == f"{R.RAW}{R.FACTS}: fact one." and got["a"].uncontested_facts == f"{R.RAW}fact two. more"
    assert got["a"].party_requests == R.NO_INFO and got["a"].party_defenses == R.NO_DEFENCES and got["a"].key_disputes == f"{R.RAW}- x\n- y" == got["a"].legal_questions
    assert got["b"].dispute_summary == R.NO_INFO and got["b"].legal_questions == f"{R.RAW}- law"
    assert got[None].party_defenses == f"{R.RAW}said" and len(got) == 3
    assert R.fallback_brief(spark.createDataFrame([], schema), "case", "role", "pos", "summary", "disputes").count() == 0


def test_raw_summary_lists_sides(spark):
    rows = [(1, "disputed", 2, "subject", None, [("p", ["b1", "b2"]), ("q", [])]), (1, "agreed", 1, "point", None, None), (1, "party_specific", 3, None, "p", None), (1, "other", 4, "x", None, None)]
    df = spark.createDataFrame(rows, "k int, kind string, pos int, t string, p string, positions array<struct<party:string,bullets:array<string>>>")
    assert one(R.raw_summary(df, "k", "kind", "pos", "t", "p", "positions")).summary == f"{R.RAW}{R.AGREED}\n- point\n{R.DISPUTED}\n- subject\n  * p: b1; b2\n  * q: \n{R.SPECIFIC}\n- [p] "


def test_report_without_issues_or_articles(spark):
    cs = spark.createDataFrame([("a", "high", 0.5), ("b", None, None)], "case string, level string, score double")
    issues = spark.createDataFrame([("a", 1, "t"), ("a", 2, None)], "case string, issue_id int, title string")
    applied = spark.createDataFrame([("a", 1, 9), ("a", 1, 7), ("a", 1, 9), ("a", 2, None)], "case string, issue_id int, article int")
    got = {r.case: r.report for r in R.fallback_report(cs, issues, applied, "case").collect()}
    assert got["b"] == R.EMPTY_REPORT and "مواد [7, 9]" in got["a"] and "مواد []" in got["a"] and got["a"].endswith("مرتفع (0.50)")


def test_endings_and_routes(spark):
    got = spark.createDataFrame([("law_cannot_answer", None), ("law_cannot_answer", "why"), ("nothing", None)], "n string, w string").select(R.ending(F.col("n"), F.col("w")).alias("e")).collect()
    assert R.NO_REASON in got[0].e and "\nwhy\n" in got[1].e and got[2].e is None
    df = spark.createDataFrame([("pass", 0), ("validator_error", 2), ("", 0), (None, 0), ("fail_x", None)], "s string, r int")
    assert [r.x for r in df.select(R.validation_route(F.col("s"), F.col("r"), F.lit(2)).alias("x")).collect()] == ["pass", "fallback", "fallback", "fallback", "retry"]
    df = spark.createDataFrame([(None, 0), (False, 0), (False, 2), (True, 0)], "s boolean, r int")
    assert [r.x for r in df.select(R.synthesis_route(F.col("s"), F.col("r")).alias("x")).collect()] == ["trace_writer", "replanner", "trace_writer", "trace_writer"]
    df = spark.createDataFrame([(["ocr"], 1, ["failed"]), (["ocr", "law"], 0, ["failed"]), (["ocr", "law"], 1, ["failed"]), (["ocr"], 0, []), (None, None, None)], "a array<string>, n int, s array<string>")
    assert [r.x for r in df.select(R.after_classify_route(F.col("a"), F.col("n"), F.col("s")).alias("x")).collect()] == ["fallback", "fallback", "merge", "merge", "merge"]


def test_reranking_falls_back_to_the_first_order(spark):
    pairs = spark.createDataFrame([("q", 1, 0.5, 0.1), ("q", 1, 0.9, 0.1), ("q", 2, None, 0.8), ("q", 3, 0.2, None)], "k string, d int, s double, r double")
    kept, trust = R.reranked(pairs, F.col("r"), 2, "k", "d", "s")
    assert sorted((r.d, r.s, r.place) for r in kept.collect()) == [(1, 0.9, 2), (2, 0.0, 1)] and one(trust).confidence == 0.45
    kept, trust = R.reranked(pairs, None, 2, "k", "d", "s")
    assert sorted((r.d, r.place) for r in kept.collect()) == [(1, 1), (3, 2)] and one(trust).confidence == 0.55
    assert R.reranked(pairs.limit(0), None, 2, "k", "d", "s")[1].count() == 0


def test_citations_checked_against_what_was_found(spark):
    answers = spark.createDataFrame([("a", "كما في المادة 5 والمادة 9"), ("b", "بلا مواد")], "k string, t string")
    known = spark.createDataFrame([("a", 5), ("b", 9)], "k string, n int")
    got = {r.k: r for r in citations.check(answers, known, "k", "t", "n").collect()}
    assert got["a"].cited == [5, 9] and got["a"].invalid == [9] and "9" not in got["a"].scrubbed and got["b"].cited == []
    elements = spark.createDataFrame([("a", "E1", [5]), ("a", "E0", []), ("c", "E9", None)], "k string, element_id string, articles array<int>")
    told = R.citation_verdict(spark.createDataFrame([("a", 5), ("a", 9)], "k string, n int"), known, elements, "k", "n")
    assert sorted((r.k, r.total, r.verified, r.missing, r.unsupported, r.passed) for r in told.collect()) == [("a", 2, 1, [9], ["E0"], False), ("c", 0, 0, [], ["E9"], False)]


def test_appended_sources_tools_and_scope(spark):
    a, b = spark.createDataFrame([(1, ["x", "y"]), (2, None)], "k int, l array<string>"), spark.createDataFrame([(1, ["x"])], "k int, l array<string>")
    assert sorted((r.k, r.l) for r in R.appended([b, a], "k", "l").collect()) == [(1, ["x", "x", "y"]), (2, [])]
    said = spark.createDataFrame([("Civil-Law RAG",), ("fetch sum",), ("magic",), (None,)], "t string").select(R.coerced_tool(F.col("t"), ["civil_law_rag", "fetch_summary_report"]).alias("t"))
    assert [r.t for r in said.collect()] == ["civil_law_rag", "fetch_summary_report", "magic", None]
    toc = spark.createDataFrame([(1, "one", [(4, "four")]), (2, "two", None)], "chapter_id int, chapter string, sections array<struct<section_id:int,section:string>>")
    told = spark.createDataFrame([("a", 1, 4), ("b", 2, 4), ("c", 9, 4), ("d", None, None)], "q string, chapter_id int, section_id int")
    got = {r.q: (r.chapter_id, r.section_id, r.level) for r in R.scoped(told, toc, "q").collect()}
    assert got == {"a": (1, 4, "section"), "b": (2, None, "chapter"), "c": (None, None, "none"), "d": (None, None, "none")}


def test_places_of_a_hot_key_are_gapless(spark):
    rows = spark.range(500).select((500 - F.col("id")).alias("id"), F.when(F.col("id") % 5 > 0, "hot").when(F.col("id") % 2 == 0, "k").alias("key"))
    got = ranking.places(rows, ["key"], [F.col("id")], "n").collect()
    for key in ("hot", "k", None):
        assert [r.n for r in sorted((r for r in got if r.key == key), key=lambda r: r.id)] == list(range(1, 1 + sum(r.key == key for r in got)))
    assert len(got) == 500


def test_pages_begin_where_the_sum_is_full(spark):
    lengths = [[], [5], [2500], [1000, 1000, 1, 1500, 600, 3000, 3000, 1]]
    got = [r.p for r in spark.createDataFrame([(x,) for x in lengths], "n array<bigint>").select(chunking.pages_of(F.col("n")).alias("p")).collect()]

    def plain(xs):
        page, total, out = 1, 0, []
        for x in xs:
            total += x
            if total > 2000:
                page, total = page + 1, 0
            out.append(page)
        return out

    assert got == [plain(x) for x in lengths]


def test_small_operators(spark, tmp_path):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 1, "z")], "k string, o int, v string")
    assert sorted((r.k or "", r.v) for r in ranking.keep_first(df, ["k"], F.col("o")).collect()) == [("", "z"), ("a", "y")]
    row = one(spark.createDataFrame([(["t", " ", None, "u"], ["f", "g", None])], "t array<string>, f array<string>").select(cases.paired(F.col("t"), F.col("f")).alias("p")))
    assert [(p.pos, p.text, p.file) for p in row.p] == [(0, "t", "f"), (3, "u", "ocr_doc_3")]
    memory = spark.createDataFrame([("u/1/facts", "b"), ("u/1/facts", "a"), ("u/2", "c"), ("v", "d")], "namespace string, key string")
    assert [r.key for r in cases.memory_search(memory, "u/", limit=2, offset=1).collect()] == ["b", "c"]
    got = one(spark.createDataFrame([("q", None, ["q", " ", "r"])], "q string, h string, p array<string>").select(retrieval.expand(F.col("q"), F.col("h"), F.col("p")).alias("e")))
    assert got.e == ["q", "r"]
    labels = spark.createDataFrame([(" Yes ",), ("no",), (None,)], "l string").select(guards.mapped_label(F.col("l"), {"yes": "ja"}, "?").alias("l"))
    assert [r.l for r in labels.collect()] == ["ja", "?", "?"]
    routes = spark.createDataFrame([("whole_document", "d"), ("whole_document", None), ("x", "d")], "m string, d string").select(guards.document_route(F.col("m"), F.col("d")).alias("r"))
    assert [r.r for r in routes.collect()] == ["finalize", "retrieve", "retrieve"]
    parties = spark.createDataFrame([(1, "p", "d"), (1, "p", "d"), (2, "p", "d"), (2, "q", "d"), (3, None, "d")], "k int, party string, declared string")
    assert sorted((r.k, r.party) for r in summaries.inferred_party(parties, "k", "party", "declared").collect()) == [(1, "p"), (2, "d"), (3, "d")]
    asked, told = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "claim", "p")], "k int, doc_type string, party string")
    assert sorted((r.k, r.doc_type) for r in steps.intake(asked, told, "k").collect()) == [(1, "claim"), (2, steps.UNKNOWN)]
    audit = spark.sql("SELECT 1 AS id, timestamp('2024-01-02 03:04:05') AS at")
    files.append_audit(audit, str(tmp_path / "audit"), "at")
    files.append_audit(audit, str(tmp_path / "audit"), "at")
    assert spark.read.parquet(str(tmp_path / "audit")).filter("day = date'2024-01-02'").count() == 2
    assert files.point_count(spark, "no_such_table_here") == 0
    (tmp_path / "g.json").write_text('[{"question": "q", "n": 1},\n {"question": "r", "n": 2}]')
    assert files.golden(spark, str(tmp_path / "g.json")).count() == 2
    assert [(r.l_orderkey, r.n) for r in R.repeated_keys(spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "l_orderkey int"), ["l_orderkey"]).collect()] == [(1, 2)]


def test_files_in_the_order_asked_for(spark, tmp_path):
    for n in ("b.txt", "a.txt"):
        (tmp_path / n).write_text(n)
    asked = [str(tmp_path / n) for n in ("b.txt", "none.txt", "a.txt")]
    rows = files.in_order(files.extract(files.read_files(spark, str(tmp_path))), asked).orderBy("pos").collect()
    assert [(r.text, r.error) for r in rows] == [("b.txt", None), (None, "no such file"), ("a.txt", None)]
    with pytest.raises(Exception):
        files.golden(spark, str(tmp_path / "missing.json"))
