"""Flows and model steps: conversations stand for plans and questions, orders for issues, documents for a case's files."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from docmill.functions import vectors
from docmill.operators import flows, hierarchy, reports as RP, steps as ST
from docmill.plans.registry import ORACLE_SQL, query
from docmill.tables import table

LENGTH = "length(text) % 9"


def turns_as_steps(spark, sf_dir):
    """A plan per conversation; a turn depends on the one before it and fails if its text has a length of 0 mod 9."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("plan_id"), F.col("turn").alias("step_id"), "text")
    before = F.when(F.col("step_id") > 0, F.array(F.col("step_id") - 1)).otherwise(F.array().cast("array<bigint>"))
    return turns.withColumn("step_id", F.col("step_id").cast("long")).withColumn("depends_on", before.cast("array<bigint>"))


def run_turns(now):
    return now.select("plan_id", "step_id", (F.char_length("text") % 9 != 0).alias("ok"), F.concat(F.lit("n="), F.char_length("text").cast("string")).alias("response"))


@query(
    "plan_execution",
    f"""WITH t AS (SELECT conv_id, turn, length(text) AS n, min(CASE WHEN {LENGTH} = 0 THEN turn END) OVER (PARTITION BY conv_id) AS bad FROM conversations)
    SELECT conv_id AS plan_id, turn::BIGINT AS step_id, CASE WHEN bad IS NULL OR turn < bad THEN 'success' WHEN turn = bad THEN 'failed' ELSE 'blocked' END AS status,
    CASE WHEN bad IS NULL OR turn <= bad THEN 'n=' || n END AS response, CASE WHEN bad IS NULL OR turn < bad THEN 1 WHEN turn = bad THEN 2 ELSE 0 END::INT AS tries FROM t""",
)
def execution(spark, sf_dir):
    return flows.execute(turns_as_steps(spark, sf_dir), run_turns)


@query(
    "plan_replans",
    f"""WITH t AS (SELECT conv_id, turn, min(CASE WHEN {LENGTH} = 0 THEN turn END) OVER (PARTITION BY conv_id) AS bad FROM conversations),
    r AS (SELECT conv_id, turn, CASE WHEN bad IS NULL OR turn < bad THEN 0 WHEN turn = bad THEN 1 ELSE 2 END AS k FROM t)
    SELECT conv_id AS plan_id, count(*) AS n_steps, count(*) AS n_success, max(CASE WHEN k = 0 THEN 0 ELSE 1 END)::INT AS replans FROM r GROUP BY conv_id""",
)
def replans(spark, sf_dir):
    """Lost steps are planned again under new ids, one letter longer, without what they depended on being lost."""

    def replan(lost):
        fresh = lost.withColumns({"old": F.col("step_id"), "step_id": F.col("step_id") + 1000, "text": F.concat("text", F.when(F.char_length("text") % 9 == 0, "x").otherwise(""))})
        return fresh.withColumn("depends_on", F.array().cast("array<bigint>")).drop("old")

    done = flows.execute_with_replans(turns_as_steps(spark, sf_dir), run_turns, replan)
    return done.groupBy("plan_id").agg(F.count("*").alias("n_steps"), F.count(F.when(F.col("status") == "success", 1)).alias("n_success"), F.max("replans").alias("replans"))


@query(
    "plan_routes",
    """SELECT event_id, CASE WHEN value > 50 THEN 'executor' WHEN event_id % 5 < 3 THEN 'planner' ELSE 'replanner' END AS validated,
    CASE WHEN value > 80 THEN 'synthesizer' WHEN value > 50 THEN 'replanner' WHEN value > 20 THEN 'executor' ELSE 'synthesizer' END AS collected,
    CASE WHEN value > 90 THEN 'synthesizer' ELSE 'plan_validator' END AS replanned FROM events WHERE value IS NOT NULL""",
)
def routes(spark, sf_dir):
    e, v = table(spark, sf_dir, "events").filter("value is not null"), F.col("value")
    return e.select("event_id", flows.validator_route(v > 50, F.col("event_id") % 5).alias("validated"), flows.collector_route(v > 80, v > 50, v > 20).alias("collected"), flows.replanner_route(v > 90).alias("replanned"))


@query(
    "issue_branches",
    """WITH el AS (SELECT l_orderkey AS i, count(*) AS n_elements, count(*) FILTER (l_returnflag = 'R') AS n_unsupported, count(*) FILTER (l_returnflag = 'A') AS n_disputed, count(*) FILTER (l_returnflag = 'N' AND l_quantity > 40) AS n_insufficient, avg((l_linestatus = 'O')::INT::DOUBLE) AS coverage FROM lineitem GROUP BY 1),
    ci AS (SELECT i, count(*) AS n_citations, count(*) FILTER (p_size > 40 AND p_size % 2 = 0) AS n_admitted, count(*) FILTER (p_size > 40 AND p_size % 2 = 1) AS n_missing FROM (SELECT DISTINCT l_orderkey AS i, l_partkey AS p FROM lineitem) JOIN part ON p = p_partkey GROUP BY i),
    r AS (SELECT o_orderkey AS issue_id, coalesce(n_elements, 0) AS n_elements, coalesce(n_unsupported, 0) AS n_unsupported, coalesce(n_disputed, 0) AS n_disputed, coalesce(n_insufficient, 0) AS n_insufficient, coalesce(n_citations, 0) AS n_citations, coalesce(n_admitted, 0) AS n_admitted, coalesce(n_missing, 0) AS n_missing,
    o_orderkey IN (SELECT unnest([min(o_orderkey), max(o_orderkey)]) FROM orders GROUP BY o_custkey HAVING count(*) > 1) AS conflict, coalesce(coverage, 1.0) AS coverage FROM orders LEFT JOIN el ON i = o_orderkey LEFT JOIN ci ON ci.i = o_orderkey),
    s AS (SELECT * EXCLUDE (coverage), greatest(0.0, 1.0 - (0.25 * n_unsupported / greatest(n_elements, 1) + 0.15 * n_disputed / greatest(n_elements, 1) + 0.20 * n_insufficient / greatest(n_elements, 1) + 0.15 * n_missing / greatest(n_citations, 1) + 0.10 * (1.0 - coverage) + CASE WHEN conflict THEN 0.05 ELSE 0 END))::DOUBLE AS x FROM r)
    SELECT * EXCLUDE (x), round(x, 6) AS score FROM s""",
)
def branches(spark, sf_dir):
    return issue_rows(spark, sf_dir).drop("level").withColumn("score", F.round("score", 6))


BRANCHES_SQL = ORACLE_SQL["issue_branches"]


@query(
    "issue_branches_with_logic",
    f"""WITH b AS ({BRANCHES_SQL}), l AS (SELECT b.*, greatest(0.0, score - CASE WHEN issue_id % 4 <> 1 THEN 0.0 WHEN issue_id % 3 = 0 THEN 0.1 WHEN issue_id % 3 = 1 THEN 0.05 ELSE 0.0 END) AS s FROM b)
    SELECT issue_id, round(s, 6)::DOUBLE AS score, CASE WHEN round(s, 6) >= 0.75 THEN 'high' WHEN round(s, 6) >= 0.45 THEN 'medium' ELSE 'low' END AS level FROM l""",
)
def branches_with_logic(spark, sf_dir):
    """Half of the issues were checked for logic, and half of those failed with a severity of none, minor or major."""
    severity = F.get(F.array(F.lit("major"), F.lit("minor"), F.lit("none")), (F.col("o_orderkey") % 3).cast("int"))
    checked = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("issue_id"), (F.col("o_orderkey") % 4 != 1).alias("passed"), severity.alias("severity"))
    found = issue_rows(spark, sf_dir, checked).withColumn("score", F.round("score", 6))
    return found.select("issue_id", "score", vectors.level(F.col("score"), 0.75, 0.45).alias("level"))


def issue_rows(spark, sf_dir, logic=None):
    lines = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "unsupported").when((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 40), "insufficient_evidence").when(F.col("l_returnflag") == "N", "supported")
    elements = lines.select(F.col("l_orderkey").alias("issue_id"), F.col("l_linenumber").alias("element_id"), status.alias("status"), (F.col("l_linestatus") == "O").alias("covered"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("article"), "p_size")
    second = lambda missing: missing.join(parts.filter("p_size % 2 = 0"), "article", "left_semi")
    orders = table(spark, sf_dir, "orders")
    conflicts = orders.groupBy("o_custkey").agg(F.array(F.min("o_orderkey"), F.max("o_orderkey")).alias("issue_ids"), F.count("*").alias("n")).filter("n > 1")
    return flows.issue_branches(orders.select(F.col("o_orderkey").alias("issue_id")), elements, lines.select(F.col("l_orderkey").alias("issue_id"), F.col("l_partkey").alias("article")), parts.filter("p_size <= 40"), second, conflicts, logic)


@query(
    "summary_flow",
    """WITH c AS (SELECT source AS case_id, doc_id, generate_subscripts(string_split(text, '. '), 1) - 1 AS pos, unnest(string_split(text, '. ')) AS bullet, lang AS party FROM documents),
    s AS (SELECT c.*, CASE WHEN l.quality IS NULL OR pos % 7 = 3 THEN 'غير محدد' ELSE 'q' || l.quality END AS role, count(DISTINCT party) OVER (PARTITION BY case_id) AS p FROM c LEFT JOIN labels l USING (doc_id) WHERE trim(bullet, ' ') <> ''),
    n AS (SELECT *, count(*) OVER (PARTITION BY case_id, role) AS n FROM s)
    SELECT case_id, role, CASE WHEN n < 6 OR pos % 2 = 0 THEN role ELSE 't' || (pos % 3) END AS theme,
    CASE WHEN p > 1 AND doc_id % 3 = 0 THEN 'agreed' WHEN p > 1 AND doc_id % 3 = 1 THEN 'disputed' ELSE 'party_specific' END AS kind, doc_id, pos::INT AS pos, bullet FROM n""",
)
def summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("source").alias("case_id"), "doc_id", F.col("lang").alias("party"), F.posexplode(F.split("text", r"\. ", -1)).alias("pos", "text"))
    known = chunks.select("doc_id", "pos")
    roles = known.filter("pos % 7 <> 3").join(table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("role")), "doc_id")
    kinds = known.select("doc_id", "pos", F.when(F.col("doc_id") % 3 == 0, "agreed").when(F.col("doc_id") % 3 == 1, "disputed").when(F.col("doc_id") % 2 == 0, "not a kind").alias("kind"))
    themes = known.filter("pos % 2 = 1").select("doc_id", "pos", F.concat(F.lit("t"), (F.col("pos") % 3).cast("string")).alias("theme"))
    return flows.summarise(chunks, roles, kinds, themes)


SUMMARY_SQL = ORACLE_SQL["summary_flow"]


@query(
    "case_briefs",
    f"""WITH b AS (SELECT case_id, CASE role WHEN 'q1' THEN '{RP.FACTS}' WHEN 'q0' THEN '{RP.REQUESTS}' ELSE role END AS role, theme, kind, doc_id, pos, bullet FROM ({SUMMARY_SQL})),
    t AS (SELECT case_id, role, theme, min(struct_pack(d := doc_id, p := pos)) AS place, '{RP.RAW}' || concat_ws(chr(10), '{RP.AGREED}' || chr(10) || string_agg('- ' || bullet, chr(10) ORDER BY doc_id, pos) FILTER (WHERE kind = 'agreed'),
    '{RP.DISPUTED}' || chr(10) || string_agg('- ' || bullet, chr(10) ORDER BY doc_id, pos) FILTER (WHERE kind = 'disputed'), '{RP.SPECIFIC}' || chr(10) || string_agg('- [' || doc_id || '] ' || bullet, chr(10) ORDER BY doc_id, pos) FILTER (WHERE kind = 'party_specific')) AS s,
    string_agg('- ' || bullet, chr(10) ORDER BY doc_id, pos) FILTER (WHERE kind = 'disputed') AS d FROM b GROUP BY ALL),
    f AS (SELECT case_id, role, min(place) AS place, split_part(arg_min(s, place), '.', 1) AS s FROM t GROUP BY ALL),
    o AS (SELECT case_id, string_agg(role || ': ' || s || '.', chr(10) ORDER BY place) FILTER (WHERE s <> '' AND role <> '{RP.UNKNOWN}') AS o FROM f GROUP BY case_id),
    p AS (SELECT case_id, string_agg(s, chr(10) || chr(10) ORDER BY place) FILTER (WHERE role = '{RP.FACTS}' AND d IS NULL) AS facts, string_agg(d, chr(10) ORDER BY place) AS d, string_agg(s, chr(10) || chr(10) ORDER BY place) FILTER (WHERE role = '{RP.REQUESTS}') AS r FROM t GROUP BY case_id)
    SELECT case_id, coalesce('{RP.RAW}' || o, '{RP.NO_INFO}') AS dispute_summary, coalesce('{RP.RAW}' || facts, '{RP.NO_INFO}') AS uncontested_facts, coalesce('{RP.RAW}' || d, '{RP.NO_INFO}') AS key_disputes, coalesce('{RP.RAW}' || r, '{RP.NO_REQUESTS}') AS party_requests,
    '{RP.NO_DEFENCES}' AS party_defenses, '{RP.NO_DOCUMENTS}' AS submitted_documents, coalesce('{RP.RAW}' || d, '{RP.NO_INFO}') AS legal_questions FROM p JOIN o USING (case_id)""",
)
def case_briefs(spark, sf_dir):
    """The bullets of summary_flow to the end: theme summaries and a brief for each case, no model answering."""
    role = F.when(F.col("role") == "q1", RP.FACTS).when(F.col("role") == "q0", RP.REQUESTS).otherwise(F.col("role"))
    return flows.brief(summary(spark, sf_dir).withColumn("role", role))


@query(
    "model_step_defaults",
    """WITH q AS (SELECT conv_id, turn, text, role, conv_id * 1000 + turn AS k FROM conversations)
    SELECT k, CASE WHEN k % 2 = 0 THEN 'answer ' || k ELSE text END AS refined, turn + 1 AS retry_count, CASE WHEN k % 3 = 0 THEN true ELSE false END AS passed, CASE WHEN k % 3 = 0 THEN 'good' ELSE 'no grade' END AS reason,
    CASE WHEN k % 5 = 0 THEN 'chat' ELSE 'off_topic' END AS intent, CASE WHEN k % 5 <> 0 THEN 'classification_error' END AS error,
    CASE WHEN turn > 0 AND turn % 7 < 5 AND k % 2 = 0 THEN 'answer ' || k ELSE 'nothing to say' END AS answer, CASE WHEN k % 4 = 0 THEN 'major' ELSE 'none' END AS severity,
    CASE WHEN k % 6 = 0 THEN 'agreed' ELSE 'party_specific' END AS kind FROM q""",
)
def model_steps(spark, sf_dir):
    """Several steps in a row; each model has answered some of the questions only."""
    k = (F.col("conv_id") * 1000 + F.col("turn")).alias("k")
    asked = table(spark, sf_dir, "conversations").select(k, "turn", "text", F.col("turn").alias("retry_count"), (F.col("turn") % 7).alias("calls"))
    some = lambda n: asked.filter(F.col("k") % n == 0)
    said = F.concat(F.lit("answer "), F.col("k").cast("string"))
    out = ST.refined(asked, some(2).select("k", said.alias("refined")), "k", "text").drop("answered")
    out = ST.graded(out, some(3).select("k", F.lit(True).alias("passed"), F.lit("good").alias("reason")), "k").drop("answered")
    out = ST.intent(out, asked.select("k", F.when(F.col("k") % 5 == 0, "chat").otherwise("no such intent").alias("intent")), "k", ["chat", "query"]).drop("answered")
    out = ST.cited_answer(out, some(2).select("k", said.alias("answer")), "k", "turn", "calls", "nothing to say").drop("answered")
    out = ST.logical_check(out.withColumnRenamed("passed", "graded"), some(4).select("k", F.lit(False).alias("passed"), F.lit("major").alias("severity")), "k").drop("answered", "passed").withColumnRenamed("graded", "passed")
    out = ST.split_kind(out, some(6).select("k", F.lit("agreed").alias("kind")), "k")
    return out.select("k", "refined", (F.col("retry_count")).alias("retry_count"), "passed", "reason", "intent", "error", "answer", "severity", "kind")


@query("routing_accuracy", "SELECT count(*) AS n, round(avg((CASE WHEN n_chars > 1500 THEN 'en' ELSE lang END = lang)::INT::DOUBLE), 6) AS accuracy FROM documents")
def accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("said", F.when(F.col("n_chars") > 1500, "en").otherwise(F.col("lang")))
    return ST.routing_accuracy(docs, "said", "lang").withColumn("accuracy", F.round("accuracy", 6))


@query("health_rollup", "SELECT coalesce(bool_and(n > 0), false) AS healthy FROM (SELECT count(*) AS n FROM documents UNION ALL SELECT count(*) FROM embeddings)")
def health(spark, sf_dir):
    parts = [table(spark, sf_dir, t).agg((F.count("*") > 0).alias("ok")) for t in ("documents", "embeddings")]
    return ST.healthy(parts[0].unionByName(parts[1]), "ok")


@query("related_counts", "SELECT c_custkey, count(o_orderkey) AS n_audits FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def related(spark, sf_dir):
    audits = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return ST.with_related(table(spark, sf_dir, "customer").select("c_custkey"), audits, "c_custkey", "n_audits")


@query("stored_reports", "SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'report ' || d.doc_id END AS body, CASE WHEN l.toxic = 1 THEN 'success' ELSE 'skipped' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def stored(spark, sf_dir):
    reports = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.concat(F.lit("report "), F.col("doc_id").cast("string")).alias("body"))
    return ST.stored_report(table(spark, sf_dir, "documents").select("doc_id"), reports, "doc_id", "body")


@query("rerank_gather", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id, (n - 1 - pos)::INT AS rank, round(1.0 / (n - pos), 6)::DOUBLE AS score FROM n")
def gather(spark, sf_dir):
    """A reranker that turns each source's documents around and names them by their places."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("pos"))
    sizes = docs.groupBy("source").agg(F.count("*").cast("int").alias("n"))
    ranked = sizes.select("source", F.reverse(F.sequence(F.lit(0), F.col("n") - 1)).alias("indices"), F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.round(1.0 / i, 6)).alias("scores"))
    return ST.gathered(ranked, docs, "source", "pos").select("source", "doc_id", "rank", "score")


@query(
    "small_columns",
    """SELECT doc_id, doc_id || '::' || strftime(TIMESTAMP '2024-01-01' + to_seconds(doc_id), '%Y-%m-%dT%H:%M:%S') AS session_id, CASE WHEN doc_id % 2 = 0 THEN source END AS kept, doc_id % 2 = 0 AS is_map,
    left('{"text":"' || source || repeat('x', (doc_id % 40)::INT) || '"}', 20) || CASE WHEN length(source) + doc_id % 40 + 11 > 20 THEN '...' ELSE '' END AS dump FROM documents""",
)
def small(spark, sf_dir):
    """Session ids, JSON that is or is no object, maps without a key, and cut dumps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    raw = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("doc_id").alias("_id"), "source"))).otherwise(F.lit("[not an object"))
    held = ST.without_keys(ST.as_map(raw), "_id")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))
    dump = ST.dumped(F.struct(F.concat("source", F.repeat(F.lit("x"), (F.col("doc_id") % 40).cast("int"))).alias("text")), 20)
    return docs.select("doc_id", ST.session_id(F.col("doc_id"), at).alias("session_id"), F.element_at(held, "source").alias("kept"), (F.size(held) > 0).alias("is_map"), dump.alias("dump"))


@query(
    "tagged_articles",
    """SELECT doc_id, article_index, book, chapter, body FROM (SELECT doc_id, source AS book, lang AS chapter, unnest([1, 2]) AS article_index, unnest(['n ' || n_chars, 'second of ' || source]) AS body FROM documents)""",
)
def tagged(spark, sf_dir):
    """Tagged texts made of documents: the headings above come down to each article."""
    docs = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("[PREFACE]none[/PREFACE][BOOK]"), "source", F.lit("[/BOOK][CHAPTER]"), "lang", F.lit("[/CHAPTER][ARTICLE id=1]n  "), F.col("n_chars").cast("string"), F.lit("[/ARTICLE][ARTICLE id=\"2\"]second of "), "source", F.lit("[/ARTICLE][ARTICLE]no number[/ARTICLE]"))
    found = hierarchy.articles(docs.select("doc_id", text.alias("tagged")), "doc_id", "tagged")
    return found.select("doc_id", F.col("article_index").cast("int").alias("article_index"), "book", "chapter", "body")


@query("tagged_contents", "SELECT doc_id, 1::BIGINT AS chapter_id, lang AS title, 'first of ' || source || ',second' AS sections FROM documents UNION ALL SELECT doc_id, 2, 'last', '' FROM documents")
def toc(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("[CHAPTER]"), "lang", F.lit("[/CHAPTER][SECTION]first of "), "source", F.lit("[/SECTION][SECTION]second[/SECTION][CHAPTER]last[/CHAPTER]"))
    found = hierarchy.contents(docs.select("doc_id", text.alias("tagged")), "doc_id", "tagged")
    return found.select("doc_id", "chapter_id", "title", F.array_join(F.transform("sections", lambda s: s["title"]), ",").alias("sections"))
