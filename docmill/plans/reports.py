"""Ends of flows: documents stand for themes of their source's case, orders for issues of their customer's case."""

from pyspark.sql import functions as F

from docmill.operators import citations as CI
from docmill.operators import reports as R
from docmill.operators import steps as ST
from docmill.plans.registry import query
from docmill.tables import dealt, table, tasks

ROLES = (R.FACTS, R.REQUESTS, R.DEFENCES, R.DOCUMENTS, R.LEGAL, R.UNKNOWN)
ROLES_SQL = "[" + ", ".join(f"'{r}'" for r in ROLES) + "]"
RAW_SQL = f"'{R.RAW}'"


def themes(spark, sf_dir):
    role = F.get(F.array(*[F.lit(r) for r in ROLES]), (F.col("doc_id") % 6).cast("int"))
    disputes = F.when(F.col("doc_id") % 5 == 0, F.array("lang", F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select("source", role.alias("role"), "doc_id", F.substring("text", 1, 60).alias("summary"), disputes.alias("disputes"))


@query(
    "fallback_briefs",
    f"""WITH t AS (SELECT source, {ROLES_SQL}[doc_id % 6 + 1] AS role, doc_id, coalesce(left(text, 60), '') AS s, CASE WHEN doc_id % 5 = 0 THEN '- ' || lang || chr(10) || '- ' || doc_id END AS d FROM documents),
    f AS (SELECT source, role, min(doc_id) AS doc_id, split_part(arg_min(s, doc_id), '.', 1) AS s FROM t GROUP BY ALL),
    o AS (SELECT source, string_agg(role || ': ' || s || '.', chr(10) ORDER BY doc_id) FILTER (WHERE s <> '' AND role <> '{R.UNKNOWN}') AS o FROM f GROUP BY source),
    p AS (SELECT source, string_agg(s, chr(10) || chr(10) ORDER BY doc_id) FILTER (WHERE role = '{R.FACTS}' AND s <> '' AND d IS NULL) AS facts, string_agg(d, chr(10) ORDER BY doc_id) AS disputes,
    {', '.join(f"string_agg(s, chr(10) || chr(10) ORDER BY doc_id) FILTER (WHERE role = '{r}' AND s <> '') AS {n}, count(*) FILTER (WHERE role = '{r}') AS n_{n}" for r, n in ((R.REQUESTS, 'requests'), (R.DEFENCES, 'defences'), (R.DOCUMENTS, 'documents')))},
    string_agg(d, chr(10) ORDER BY doc_id) FILTER (WHERE role = '{R.LEGAL}') AS legal FROM t GROUP BY source)
    SELECT source, coalesce({RAW_SQL} || o, '{R.NO_INFO}') AS dispute_summary, coalesce({RAW_SQL} || facts, '{R.NO_INFO}') AS uncontested_facts, coalesce({RAW_SQL} || disputes, '{R.NO_INFO}') AS key_disputes,
    {', '.join(f"coalesce({RAW_SQL} || {n}, CASE WHEN n_{n} > 0 THEN '{R.NO_INFO}' ELSE '{d}' END) AS {c}" for n, d, c in (('requests', R.NO_REQUESTS, 'party_requests'), ('defences', R.NO_DEFENCES, 'party_defenses'), ('documents', R.NO_DOCUMENTS, 'submitted_documents')))},
    coalesce({RAW_SQL} || legal, {RAW_SQL} || disputes, '{R.NO_INFO}') AS legal_questions FROM p JOIN o USING (source)""",
)
def fallback_briefs(spark, sf_dir):
    return R.fallback_brief(themes(spark, sf_dir), "source", "role", "doc_id", "summary", "disputes")


@query(
    "raw_summaries",
    f"""WITH i AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n, l_linenumber % 3 AS kind, l_partkey::VARCHAR AS t, l_suppkey::VARCHAR AS p, l_returnflag AS r FROM lineitem),
    a AS (SELECT k, string_agg('- ' || t, chr(10) ORDER BY n) FILTER (WHERE kind = 0) AS a, string_agg('- ' || t || chr(10) || '  * ' || p || ': ' || r || '; ' || t, chr(10) ORDER BY n) FILTER (WHERE kind = 1) AS d, string_agg('- [' || p || '] ' || t, chr(10) ORDER BY n) FILTER (WHERE kind = 2) AS s FROM i GROUP BY k)
    SELECT k, {RAW_SQL} || concat_ws(chr(10), '{R.AGREED}' || chr(10) || a, '{R.DISPUTED}' || chr(10) || d, '{R.SPECIFIC}' || chr(10) || s) AS summary FROM a""",
)
def raw_summaries(spark, sf_dir):
    kind = F.get(F.array(F.lit("agreed"), F.lit("disputed"), F.lit("party_specific")), F.col("l_linenumber") % 3)
    party, text = F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")
    lines = table(spark, sf_dir, "lineitem")
    # lines move as they are, which is less than what is written of them
    own = dealt(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag"), tasks(lines), "l_orderkey")
    items = own.select(
        F.col("l_orderkey").alias("k"),
        kind.alias("kind"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("pos"),
        text.alias("t"),
        party.alias("p"),
        F.array(F.struct(party.alias("party"), F.array("l_returnflag", text).alias("bullets"))).alias("positions"),
    )
    return R.raw_summary(items, "k", "kind", "pos", "t", "p", "positions")


@query(
    "case_reports",
    f"""WITH c AS (SELECT c_custkey AS k, CASE c_nationkey % 3 WHEN 0 THEN '{R.LEVELS['high']}' WHEN 1 THEN '{R.LEVELS['medium']}' ELSE '{R.LEVELS['low']}' END AS level, c_nationkey / 25 AS score FROM customer),
    a AS (SELECT l_orderkey AS o, array_to_string(list_sort(list(DISTINCT l_partkey)), ', ') AS a FROM lineitem GROUP BY 1),
    i AS (SELECT o_custkey AS k, string_agg('- [' || o_orderkey || '] ' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS i, string_agg('- مسألة ' || o_orderkey || ': مواد [' || coalesce(a, '') || ']', chr(10) ORDER BY o_orderkey) AS f FROM orders LEFT JOIN a ON o_orderkey = o GROUP BY 1)
    SELECT k, CASE WHEN i IS NULL THEN '{R.EMPTY_REPORT}' ELSE concat_ws(chr(10), '{R.TITLE}', '{R.ISSUES}', i, '{R.FRAME}', f, '{R.TRUST}' || level || ' (' || printf('%.2f', score) || ')') END AS report FROM c LEFT JOIN i USING (k)""",
)
def case_reports(spark, sf_dir):
    level = F.get(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("c_nationkey") % 3).cast("int"))
    cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), level.alias("level"), (F.col("c_nationkey") / 25).alias("score"))
    orders = table(spark, sf_dir, "orders")
    issues = orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("issue_id"), F.col("o_orderpriority").alias("title"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("issue_id"), F.col("l_partkey").alias("article")).distinct()
    return R.fallback_report(cases, issues, lines.join(issues.select("k", "issue_id"), "issue_id"), "k")


@query("issue_dispatch", "SELECT c_custkey AS k, CASE WHEN count(o_orderkey) = 0 THEN 'generate_empty_report' ELSE 'issue_analysis_branch' END AS route, count(o_orderkey) AS n_issues, count(o_orderkey) > 8 AS warned FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def issue_dispatch(spark, sf_dir):
    cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return R.issue_dispatch(cases, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query(
    "turn_routes",
    """WITH e AS (SELECT event_id, event_type AS t, user_id % 3 AS n, user_id % 4 AS r, CASE user_id % 5 WHEN 0 THEN ['ocr'] WHEN 1 THEN ['ocr', 'law'] WHEN 2 THEN ['case_doc_rag'] ELSE ['law'] END AS agents, event_id % 7 AS b FROM events)
    SELECT event_id, CASE WHEN t = 'error' THEN 'off_topic' ELSE 'classify' END AS entry,
    CASE WHEN n > 0 AND (list_contains(agents, 'ocr') OR list_contains(agents, 'case_doc_rag')) THEN 'classify_document' ELSE 'merge' END AS dispatched,
    CASE WHEN list_contains(agents, 'ocr') AND (len(agents) = 1 OR n = 0) AND b < 3 THEN 'fallback' ELSE 'merge' END AS classified,
    CASE WHEN t = 'view' THEN 'pass' WHEN t = 'signup' THEN 'fallback' WHEN r < 2 THEN 'retry' ELSE 'fallback' END AS validated,
    CASE WHEN b > 4 OR r >= 2 THEN 'trace_writer' ELSE 'replanner' END AS synthesized FROM e""",
)
def turn_routes(spark, sf_dir):
    agents = F.when(F.col("user_id") % 5 == 0, F.array(F.lit("ocr"))).when(F.col("user_id") % 5 == 1, F.array(F.lit("ocr"), F.lit("law"))).when(F.col("user_id") % 5 == 2, F.array(F.lit("case_doc_rag"))).otherwise(F.array(F.lit("law")))
    n, r, b = F.col("user_id") % 3, F.col("user_id") % 4, F.col("event_id") % 7
    statuses = F.array(F.lit("failed"), F.when(b < 3, "failed").otherwise("done"))
    status = F.when(F.col("event_type") == "view", "partial_pass").when(F.col("event_type") == "signup", None).otherwise("fail_relevance")
    return table(spark, sf_dir, "events").select(
        "event_id",
        R.input_route(F.when(F.col("event_type") == "error", "off_topic")).alias("entry"),
        R.after_dispatch_route(agents, n).alias("dispatched"),
        R.after_classify_route(agents, n, statuses).alias("classified"),
        R.validation_route(status, r, F.lit(2)).alias("validated"),
        R.synthesis_route(b > 4, r).alias("synthesized"),
    )


@query(
    "endings",
    f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{R.ENDINGS['law_off_topic']}' WHEN 1 THEN replace('{R.ENDINGS['law_cannot_answer']}', '{{}}', CASE WHEN doc_id % 2 = 0 THEN source ELSE '{R.NO_REASON}' END) ELSE '{R.ENDINGS['documents_error']}' END AS said FROM documents""",
)
def endings(spark, sf_dir):
    name = F.get(F.array(F.lit("law_off_topic"), F.lit("law_cannot_answer"), F.lit("documents_error")), (F.col("doc_id") % 3).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", R.ending(name, F.when(F.col("doc_id") % 2 == 0, F.col("source"))).alias("said"))


@query(
    "answer_sources",
    "WITH s AS (SELECT conv_id, lower(trim(role)) AS l, arg_min(trim(role), turn) AS s, min(turn) AS t FROM conversations WHERE trim(role) <> '' GROUP BY ALL) SELECT conv_id, string_agg(s, ',' ORDER BY t) AS sources FROM s GROUP BY conv_id",
)
def answer_sources(spark, sf_dir):
    steps = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array(F.concat(F.lit(" "), "role"), F.upper("role"), F.lit("  ")).alias("said"))
    return R.deduplicated_sources(steps, "conv_id", "turn", "said").select("conv_id", F.array_join("sources", ",").alias("sources"))


@query(
    "contents_scope",
    """WITH toc AS (SELECT DISTINCT p_size AS chapter_id, 'chapter ' || p_size AS chapter FROM part WHERE p_size <= 30), sec AS (SELECT DISTINCT p_size AS chapter_id, p_partkey % 40 AS section_id, 'section ' || (p_partkey % 40) AS section FROM part WHERE p_size <= 30),
    t AS (SELECT event_id, user_id % 45 AS chapter_id, event_id % 50 AS section_id FROM events)
    SELECT event_id, CASE WHEN chapter IS NOT NULL THEN t.chapter_id END::INT AS chapter_id, chapter, CASE WHEN section IS NOT NULL THEN t.section_id END::BIGINT AS section_id, section, CASE WHEN chapter IS NULL THEN 'none' WHEN section IS NULL THEN 'chapter' ELSE 'section' END AS level
    FROM t LEFT JOIN toc USING (chapter_id) LEFT JOIN sec ON sec.chapter_id = toc.chapter_id AND sec.section_id = t.section_id""",
)
def contents_scope(spark, sf_dir):
    part = table(spark, sf_dir, "part").filter("p_size <= 30").select(F.col("p_size").alias("chapter_id"), (F.col("p_partkey") % 40).alias("section_id")).distinct()
    toc = part.groupBy("chapter_id").agg(F.collect_list(F.struct("section_id", F.concat(F.lit("section "), F.col("section_id").cast("string")).alias("section"))).alias("sections"))
    toc = toc.withColumn("chapter", F.concat(F.lit("chapter "), F.col("chapter_id").cast("string")))
    told = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 45).cast("int").alias("chapter_id"), (F.col("event_id") % 50).alias("section_id"))
    return R.scoped(told, toc, "event_id")


RERANK_SQL = """WITH p AS (SELECT l_orderkey AS k, l_partkey AS doc, max(l_extendedprice) AS score, arg_max(l_discount, (l_extendedprice, l_discount)) AS r FROM lineitem GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {order}) AS place FROM p)"""


@query("reranked_documents", RERANK_SQL.format(order="r DESC, score DESC, doc") + " SELECT k, doc, score, place::INT AS place FROM n WHERE place <= 2")
def reranked_documents(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("doc"), F.col("l_extendedprice").alias("score"), "l_discount")
    return R.reranked(pairs, F.col("l_discount"), 2, "k", "doc", "score")[0]


@query("retrieval_confidence_without_reranker", RERANK_SQL.format(order="score DESC, doc") + " SELECT k, round(avg(score), 3) AS confidence FROM n WHERE place <= 2 GROUP BY k")
def confidence_without_reranker(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("doc"), F.col("l_extendedprice").alias("score"))
    return R.reranked(pairs, None, 2, "k", "doc", "score")[1]


@query(
    "citation_verdicts",
    """WITH c AS (SELECT DISTINCT l_orderkey AS k, l_partkey % 100 AS n FROM lineitem), a AS (SELECT DISTINCT p_partkey % 100 AS n FROM part WHERE p_size < 3), v AS (SELECT k, count(*) AS total, count(a.n) AS verified, list_sort(list(c.n) FILTER (WHERE a.n IS NULL)) AS missing FROM c LEFT JOIN a USING (n) GROUP BY k),
    e AS (SELECT l_orderkey AS k, l_linenumber AS el, bool_or(l_quantity <= 5) AS bare FROM lineitem GROUP BY ALL), u AS (SELECT k, list_sort(list(el) FILTER (WHERE bare)) AS unsupported FROM e GROUP BY k)
    SELECT k, total, verified, array_to_string(coalesce(missing, []), ',') AS missing, array_to_string(coalesce(unsupported, []), ',') AS unsupported, coalesce(len(missing), 0) + coalesce(len(unsupported), 0) = 0 AS passed FROM v JOIN u USING (k)""",
)
def citation_verdicts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    cited = lines.select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 100).alias("n"))
    known = table(spark, sf_dir, "part").filter("p_size < 3").select((F.col("p_partkey") % 100).alias("n")).distinct()
    bare = lines.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("element_id")).agg(F.bool_or(F.col("l_quantity") <= 5).alias("bare"))
    elements = bare.select("k", "element_id", F.when(~F.col("bare"), F.array(F.lit(1))).alias("articles"))
    told = R.citation_verdict(cited, cited.join(known, "n", "left_semi"), elements, "k", "n")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return told.select("k", "total", "verified", text("missing"), text("unsupported"), "passed")


@query("appended_branches", "SELECT doc_id, coalesce(lang, '') || ',' || coalesce(source, '') || ',' || doc_id AS items FROM documents")
def appended_branches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    one = docs.select("doc_id", F.array(F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))).alias("items"))
    two = docs.select("doc_id", F.array(F.col("doc_id").cast("string")).alias("items"))
    return R.appended([one, two], "doc_id", "items").select("doc_id", F.array_join("items", ",").alias("items"))


@query("repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return R.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("coerced_tools", "SELECT event_id, CASE event_type WHEN 'error' THEN 'civil_law_rag' WHEN 'click' THEN 'case_doc_rag' WHEN 'view' THEN 'fetch_summary_report' ELSE event_type END AS tool FROM events")
def coerced_tools(spark, sf_dir):
    said = F.when(F.col("event_type") == "error", "Civil-Law RAG").when(F.col("event_type") == "click", "case docs").when(F.col("event_type") == "view", "fetch summary").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", R.coerced_tool(said, ["civil_law_rag", "case_doc_rag", "fetch_summary_report"]).alias("tool"))


@query(
    "late_step_defaults",
    f"""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '{R.NO_COUNTERARGUMENTS}' END AS analysis, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS n_arguments,
    CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus ELSE '{R.NO_ANSWER}' END AS answer, o_orderkey % 5 + 1 AS attempts, CASE WHEN o_orderkey % 4 = 0 AND o_orderstatus <> 'F' AND o_orderkey % 5 < 2 THEN o_orderkey % 5 + 1 ELSE o_orderkey % 5 END AS runs,
    CASE WHEN o_orderkey % 4 = 0 AND o_orderstatus <> 'F' AND o_orderkey % 5 < 2 THEN 'replanner' ELSE 'trace_writer' END AS route, CASE WHEN o_orderkey % 4 <> 0 THEN 'succeeded' END AS status, coalesce(n, 0) AS n_sources
    FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(DISTINCT l_partkey % 10) AS n FROM lineitem GROUP BY 1) USING (o_orderkey)""",
)
def late_step_defaults(spark, sf_dir):
    """Orders stand for questions: every third has counterarguments, every fourth an answer."""
    orders = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    asked = orders.select("k", (F.col("k") % 5).alias("attempts"), (F.col("k") % 5).alias("runs"))
    against = orders.filter("k % 3 = 0").select("k", F.array(F.lit("a")).alias("plaintiff_arguments"), F.array().cast("array<string>").alias("defendant_arguments"), F.col("o_orderpriority").alias("analysis"))
    said = orders.filter("k % 4 = 0").select("k", F.col("o_orderstatus").alias("answer"), (F.col("o_orderstatus") == "F").alias("sufficient"))
    results = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("pos"), F.array((F.col("l_partkey") % 10).cast("string")).alias("sources"))
    told = ST.synthesized(ST.counterarguments(asked, against, "k").drop("answered"), said, results, "k", "pos")
    return told.select("k", "analysis", (F.size("plaintiff_arguments") + F.size("defendant_arguments")).alias("n_arguments"), "answer", "attempts", "runs", "route", "status", F.size("sources").cast("long").alias("n_sources"))


@query(
    "issue_dependencies",
    "WITH t AS (SELECT DISTINCT l_partkey % 50 AS c, l_orderkey % 100 AS u, l_suppkey AS d, l_returnflag AS t FROM lineitem), i AS (SELECT DISTINCT l_partkey % 50 AS c, l_orderkey % 100 AS i FROM lineitem WHERE l_quantity < 10) SELECT t.c, u AS upstream, d AS downstream, min(t) AS dependency_type FROM t JOIN i a ON a.c = t.c AND a.i = t.u JOIN i b ON b.c = t.c AND b.i = t.d WHERE u <> d GROUP BY ALL",
)
def issue_dependencies(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("c", F.col("l_partkey") % 50)
    issues = lines.filter("l_quantity < 10").select("c", (F.col("l_orderkey") % 100).alias("i"))
    told = lines.select("c", (F.col("l_orderkey") % 100).alias("upstream"), F.col("l_suppkey").alias("downstream"), F.col("l_returnflag").alias("dependency_type"))
    return ST.dependencies(issues, told, "c", "i")


@query("learned_facts", "WITH f AS (SELECT user_id, event_type, value, ts FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_type, value, ts FROM events WHERE event_id % 2 = 1 AND event_id % 3 > 0) SELECT user_id, event_type, arg_max(value, ts)::VARCHAR AS said, max(ts)::VARCHAR AS at FROM f GROUP BY ALL")
def learned_facts(spark, sf_dir):
    """Even events are what is known of users, odd ones what was extracted; every third extraction failed."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("value").cast("string").alias("said"), "ts")
    facts, told = events.filter("event_id % 2 = 0").drop("event_id"), events.filter("event_id % 2 = 1")
    told = told.withColumn("said", F.when(F.col("event_id") % 3 > 0, F.col("said"))).drop("event_id")
    return ST.learned_facts(facts, told, "user_id", "event_type", "said", "ts").select("user_id", "event_type", "said", F.col("ts").cast("string").alias("at"))


@query("unverified_citations", "SELECT DISTINCT l_partkey AS article FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 20) AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_retailprice > 950)")
def unverified_citations(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    known = [part.filter("p_size < 20"), part.filter("p_retailprice > 950")]
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("article"))
    return CI.unverified(cited, [k.select(F.col("p_partkey").alias("article")) for k in known], ["article"])
