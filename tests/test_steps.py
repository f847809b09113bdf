"""Model steps and flows on literal rows."""

from pyspark.sql import functions as F

from docmill.operators import flows, ranking, reasoning, steps as S


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_defaults_take_the_place_of_missing_answers(spark):
    asked = spark.createDataFrame([(1, "a"), (2, " b  c "), (3, "c")], "k int, q string")
    none = spark.createDataFrame([], "k int, rewritten string, kind string")
    assert rows(S.rewritten_query(asked, none, "k", "q").select("k", "rewritten", "kind")) == [(1, "a", "analytical"), (2, "b c", "analytical"), (3, "c", "analytical")]
    half = spark.createDataFrame([(1, "x", None), (2, "y", "z")], "k int, rewritten string, kind string")
    assert [r.answered for r in S.rewritten_query(asked, half, "k", "q").orderBy("k").collect()] == [False, True, False]
    lists = spark.createDataFrame([(1, [])], "k int, queries array<string>")
    assert rows(S.expanded(asked, lists, "k", "q").select("k", "queries"))[0] == (1, ["a"])


def test_questions_and_gates(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "  "), (3, None)], "k int, q string")
    told = S.sub_questions(asked, spark.createDataFrame([(1, ["x", "y"])], "k int, questions array<string>"), "k", "q").drop("answered")
    assert [(r.k, r.questions, r.error) for r in told.orderBy("k").collect()] == [(1, ["x", "y"], None), (2, [], "empty query"), (3, [], "empty query")]
    gate = S.topic_gate(told, spark.createDataFrame([], "k int, on_topic boolean"), "k", "questions")
    assert [r.on_topic for r in gate.orderBy("k").collect()] == [True, False, False]
    doc = S.document_intent(asked, spark.createDataFrame([], "k int, intent string, document_id string"), "k").first()
    assert (doc.intent, doc.document_id) == ("no_doc_specified", None)
    found = S.branch_answer(asked, spark.createDataFrame([(1, "yes"), (2, "NOTHING here")], "k int, answer string"), "k", "NOTHING", "failed").orderBy("k").collect()
    assert [(r.answer, r.found) for r in found] == [("yes", True), ("NOTHING here", False), ("failed", False)]


def test_summary_steps(spark):
    chunks = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "k int, batch int")
    told = S.role_of_chunk(chunks, spark.createDataFrame([(1, "facts", 0.9)], "k int, role string, confidence double"), "k")
    assert {r.k: (r.role, r.confidence) for r in told.collect()} == {1: ("facts", 0.9), 2: (S.UNKNOWN, 1.0), 3: (S.UNKNOWN, 0.0)}
    items = spark.createDataFrame([(i, "r" if i < 6 else "s") for i in range(8)], "k int, role string")
    given = spark.createDataFrame([(i, "t") for i in range(8)], "k int, theme string")
    assert {(r.role, r.theme) for r in S.themes(items, given, "k", "role").collect()} == {("r", "t"), ("s", "s")}
    held = spark.createDataFrame([(1, "old", 20), (2, "old", 20)], "k int, summary string, since int")
    new = S.rolling_summary(held, spark.createDataFrame([(1, "new")], "k int, _new string"), "k", "summary", "since")
    assert rows(new.select("k", "summary", "since")) == [(1, "new", 0), (2, "old", 20)]
    placed = S.themed(spark.createDataFrame([("r", 1, "x"), ("r", 2, "y")], "role string, item int, body string"), spark.createDataFrame([("r", "t", "agreed", 2), ("r", "t", "agreed", 1), ("r", "t", "agreed", 9)], "role string, theme string, kind string, item int"), "role", "item")
    assert rows(placed.select("item", "place", "body")) == [(1, 1, "x"), (2, 2, "y")]


def test_issue_steps(spark):
    cases = spark.createDataFrame([(1, "theft"), (2, "fraud")], "k int, title string")
    none = spark.createDataFrame([], "k int, issues array<string>")
    second = spark.createDataFrame([(2, ["b"])], "k int, issues array<string>")
    assert rows(S.issues(cases, none, second, "k").select("k", "issues")) == [(1, []), (2, ["b"])]
    empty = spark.createDataFrame([], "k int, elements array<struct<element_id:string,description:string,kind:string>>")
    assert rows(S.elements_of(cases, empty, "k", "title"))[0] == (1, "E0", "theft", "legal")
    issues = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "issue int, case string")
    said = spark.createDataFrame([("a", [1, 9]), ("b", [3])], "case string, members array<int>")
    kept = S.conflicts(issues, said, "case")
    assert rows(kept) == [("a", [1, 9])]
    assert rows(S.in_conflict(issues, kept, "issue", "members").select("issue", "conflict")) == [(1, True), (2, False), (3, False)]
    prose = S.placeholder(cases, spark.createDataFrame([(1, " ")], "k int, said string"), "k", "said", "none given")
    assert {r.said for r in prose.collect()} == {"none given"}


def test_small_steps(spark):
    one = spark.range(1).select(F.array(F.lit("x" * 2000), F.lit("y")).alias("r"), F.lit("q").alias("q"))
    assert one.select(S.with_priors(F.col("q"), F.col("r")).alias("v")).first().v == "q\n\n" + "x" * 1500 + "\n\ny"
    levels = spark.createDataFrame([(None, None), (1, None), (1, 2)], "c int, s int").select(S.scope_level(F.col("c"), F.col("s")).alias("v"))
    assert [r.v for r in levels.collect()] == ["none", "chapter", "section"]
    log = S.event_log(spark.createDataFrame([(1, None), (2, "u")], "n int, user string"), "query", "INFO", "n", "user")
    assert [r.value for r in log.collect()] == ['{"event":"query","level":"INFO","n":1}', '{"event":"query","level":"INFO","n":2,"user":"u"}']


def test_a_cycle_is_blocked_and_failures_are_tried_again(spark):
    plan = spark.createDataFrame([(1, "a", []), (1, "b", ["a"]), (2, "a", ["b"]), (2, "b", ["a"]), (3, "a", None)], "plan_id int, step_id string, depends_on array<string>")
    run = lambda now: now.select("plan_id", "step_id", (F.col("plan_id") != 3).alias("ok"), F.lit("r").alias("response"))
    got = {(r.plan_id, r.step_id): (r.status, r.tries) for r in flows.execute(plan, run).collect()}
    assert got == {(1, "a"): ("success", 1), (1, "b"): ("success", 1), (2, "a"): ("blocked", 0), (2, "b"): ("blocked", 0), (3, "a"): ("failed", 2)}


def test_long_plans_and_many_items(spark):
    chain = spark.createDataFrame([(i, [i - 1] if i else []) for i in range(1100)], "step_id int, depends_on array<int>")
    levels, cyclic = reasoning.waves(chain)
    assert not cyclic and levels.agg(F.max("wave")).first()[0] == 1100
    items = spark.range(1002).select("id", F.lit("s").alias("key"), F.lit("agreed").alias("kind"))
    ids = {r.id: r.item_id for r in ranking.item_ids(items, "key", "kind", [F.col("id")], {"agreed": "A"}).collect()}
    assert len(set(ids.values())) == 1002 and ids[0] == "A001" and ids[999] == "A1000" and ids[1001] == "A1002"


def test_of_several_answers_the_smallest_counts(spark):
    asked = spark.createDataFrame([(1,), (2,)], "k int")
    answers = spark.createDataFrame([(1, "b", "x"), (1, "a", "z"), (1, None, "a"), (2, None, "q")], "k int, f string, g string")
    got = {r.k: (r.f, r.g, r.answered) for r in S.answered(asked, answers, "k", {"f": F.lit("-"), "g": F.lit("-")}).collect()}
    assert got == {1: ("a", "z", True), 2: ("-", "-", False)}


def test_a_way_without_a_document_is_kept_and_titles_are_repaired(spark):
    asked = spark.createDataFrame([("c", i) for i in range(1, 5)], "case string, k int")
    answers = spark.createDataFrame([(1, "all_docs", None), (2, "one_doc", "expert repor"), (3, "one_doc", "zzz")], "k int, intent string, document_id string")
    told = S.document_intent(asked, answers, "k")
    titles = spark.createDataFrame([("c", "expert report", 0), ("c", "claim", 1)], "case string, document_id string, pos int")
    got = {r.k: (r.intent, r.document_id) for r in S.repaired_titles(told, titles, "case", "k").collect()}
    assert got == {1: ("all_docs", None), 2: ("one_doc", "expert report"), 3: ("one_doc", "zzz"), 4: ("no_doc_specified", None)}


def test_null_cases_and_roles_are_not_lost(spark):
    items = spark.createDataFrame([(1, None), (2, "r")], "k int, role string")
    none = spark.createDataFrame([], "k int, theme string")
    assert {r.k: r.theme for r in S.themes(items, none, "k", "role").collect()} == {1: None, 2: "r"}
    chunks = spark.createDataFrame([(None, "d", 1, "p", "text"), ("c", "e", 1, "p", "more")], "case_id string, doc_id string, pos int, party string, text string")
    empty = lambda c: spark.createDataFrame([], f"doc_id string, pos int, {c} string")
    got = flows.summarise(chunks, empty("role"), empty("kind"), empty("theme")).collect()
    assert sorted((r.doc_id, r.bullet) for r in got) == [("d", "text"), ("e", "more")]


def test_steps_that_ended_are_not_run_again(spark):
    plan = spark.createDataFrame([("p", "a", []), ("p", "b", ["a"]), ("p", "c", ["a", "b", "b"]), ("p", "x", ["y"]), ("q", "a", None), ("q", "f", ["a"]), ("q", "g", ["f"])], "plan_id string, step_id string, depends_on array<string>")
    seen = []

    def run(now):
        seen.append(sorted((r.plan_id, r.step_id) for r in now.collect()))
        return now.select("plan_id", "step_id", (F.col("step_id") != "f").alias("ok"), F.upper("step_id").alias("response"))

    got = {(r.plan_id, r.step_id): (r.status, r.response, r.tries) for r in flows.execute(plan, run).collect()}
    assert seen == [[("p", "a"), ("q", "a")], [("p", "b"), ("q", "f")], [("p", "c"), ("q", "f")]]
    assert got == {
        ("p", "a"): ("success", "A", 1), ("p", "b"): ("success", "B", 1), ("p", "c"): ("success", "C", 1), ("p", "x"): ("blocked", None, 0),
        ("q", "a"): ("success", "A", 1), ("q", "f"): ("failed", "F", 2), ("q", "g"): ("blocked", None, 0),
    }


def test_late_steps_take_their_defaults(spark):
    asked = spark.createDataFrame([(1, 0, 0), (2, 1, 2), (3, 0, 1)], "k int, attempts int, runs int")
    answers = spark.createDataFrame([(2, "b", False), (3, "c", False)], "k int, answer string, sufficient boolean")
    results = spark.createDataFrame([(1, 2, [" b ", "A"]), (1, 1, ["a", "", None])], "k int, pos int, sources array<string>")
    got = {r.k: (r.answer[:1], r.attempts, r.runs, r.route, r.status, r.sources) for r in S.synthesized(asked, answers, results, "k", "pos").collect()}
    assert got == {1: ("ت", 1, 0, "trace_writer", "succeeded", ["a", "b"]), 2: ("b", 2, 2, "trace_writer", None, []), 3: ("c", 1, 2, "replanner", None, [])}
    plans = spark.createDataFrame([(1, [("s1", "Law-RAG", "q", None)])], "k int, plan array<struct<step_id:string,tool:string,query:string,depends_on:array<string>>>")
    told = {r.k: ([s.tool for s in r.plan], r.feedback) for r in S.planned(asked, plans, "k", ["law_rag"]).collect()}
    assert told[1] == (["law_rag"], None) and told[2][0] == [] and told[2][1].endswith("no plan")
    facts = spark.createDataFrame([("u", "n", "old", 1)], "u string, n string, v string, t int")
    new = spark.createDataFrame([("u", "n", "new", 2), ("u", "n", " ", 3), ("u", "m", None, 1), ("w", "n", "x", 1)], "u string, n string, v string, t int")
    assert rows(S.learned_facts(facts, new, "u", "n", "v", "t")) == [("u", "n", "new", 2), ("w", "n", "x", 1)]
    issues = spark.createDataFrame([("c", 1), ("c", 2)], "c string, i int")
    deps = spark.createDataFrame([("c", 1, 2, "b"), ("c", 1, 2, "a"), ("c", 1, 1, "a"), ("c", 2, 9, "a"), ("d", 1, 2, "a")], "c string, upstream int, downstream int, dependency_type string")
    assert rows(S.dependencies(issues, deps, "c", "i")) == [("c", 1, 2, "a")]


def test_a_brief_from_bullets_takes_what_a_model_told(spark):
    from docmill.operators import reports as RP

    schema = "case_id string, role string, theme string, kind string, doc_id string, pos int, bullet string"
    bullets = [("c", RP.FACTS, "t", "agreed", "d", 1, "one"), ("c", RP.FACTS, "u", "disputed", "d", 2, "two"), ("c", RP.REQUESTS, "t", "party_specific", "e", 1, "three"), (None, RP.FACTS, "t", "agreed", "f", 1, "four")]
    told = spark.createDataFrame([("c", RP.FACTS, "t", "Told. More."), ("c", RP.REQUESTS, "t", " ")], "case_id string, role string, theme string, summary string")
    got = {r.case_id: r for r in flows.brief(spark.createDataFrame(bullets, schema), told).collect()}
    assert got["c"].uncontested_facts == f"{RP.RAW}Told. More." and got["c"].key_disputes == f"{RP.RAW}- two"
    assert got["c"].party_requests == f"{RP.RAW}{RP.RAW}{RP.SPECIFIC}\n- [e] three" and got[None].uncontested_facts.endswith("- four")
    assert got["c"].dispute_summary.startswith(f"{RP.RAW}{RP.FACTS}: Told.\n{RP.REQUESTS}: ")
    assert flows.brief(spark.createDataFrame([], schema)).count() == 0
