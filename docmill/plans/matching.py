"""Matching and fan-out over documents, embeddings, lines and events."""

from pyspark.sql import functions as F

from docmill.operators import dispatch as D, matching as M
from docmill.plans.registry import query
from docmill.tables import table


@query("fuzzy_titles")
def fuzzy(spark, sf_dir):
    """Names of parts with two letters swapped, against the titles (names) of their brand and size."""
    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name", "p_size")
    key = F.concat_ws("/", "p_brand", F.col("p_size").cast("string"))
    titles = part.select(key.alias("case"), F.col("p_name").alias("title"), F.col("p_partkey").alias("pos"))
    asked = part.select(key.alias("case"), F.col("p_partkey").alias("id"), F.overlay("p_name", F.lit("xy"), F.lit(2)).alias("candidate"))
    return M.fuzzy_titles(asked, titles, "case", "id", "candidate", "title", "pos")


@query(
    "scope_narrowing",
    """WITH s AS (SELECT l_orderkey AS q, l_suppkey % 5 AS c, l_partkey % 7 AS s, round(l_discount * 10, 2) AS score FROM lineitem), a AS (SELECT q, c, max(score) AS score FROM s GROUP BY ALL),
    t AS (SELECT q, max(score) AS m, min(c) FILTER (WHERE score = mm) AS c FROM (SELECT *, max(score) OVER (PARTITION BY q) AS mm FROM a) GROUP BY q), k AS (SELECT q, CASE WHEN m >= 0.5 THEN c END AS chapter_id FROM t),
    i AS (SELECT k.q, s.s, max(s.score) AS score FROM k JOIN s ON s.q = k.q AND s.c = k.chapter_id GROUP BY ALL), j AS (SELECT q, max(score) AS m, min(s) FILTER (WHERE score = mm) AS s FROM (SELECT *, max(score) OVER (PARTITION BY q) AS mm FROM i) GROUP BY q)
    SELECT k.q, k.chapter_id, CASE WHEN j.m >= 0.5 THEN j.s END AS section_id FROM k LEFT JOIN j USING (q)""",
)
def scope(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), (F.col("l_suppkey") % 5).alias("chapter_id"), (F.col("l_partkey") % 7).alias("section_id"), F.round(F.col("l_discount") * 10, 2).alias("score"))
    chapters = rows.groupBy("q", "chapter_id").agg(F.max("score").alias("score"))
    sections = rows.groupBy("q", "chapter_id", "section_id").agg(F.max("score").alias("score"))
    return M.narrowed_scope(chapters, sections, "q")


@query("question_branches", "SELECT conv_id, role AS question, min(turn) >= 0 AS asked FROM conversations GROUP BY ALL")
def question_branches(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("roles"))
    return D.branches(said, F.col("roles"), ["conv_id"]).select("conv_id", "question", (F.col("branch") >= 0).alias("asked"))


@query("graded_documents", "SELECT d.source, bool_or(coalesce(l.quality = 1, true)) AS proceed FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def graded(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return D.graded(docs, F.col("quality") == 1, "source")[1]


@query("postponed_reflection", "SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events) WHERE after IS NULL OR epoch(after) - epoch(ts) > 86400")
def postponed(spark, sf_dir):
    return D.postponed(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 86_400).select("event_id", "user_id")


@query("retry_targets", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (WHERE event_type NOT IN ('click', 'view')) AS targets FROM events GROUP BY user_id")
def retry_targets(spark, sf_dir):
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("all"))
    left = F.array_join(D.retry_set(F.col("all"), F.array(F.lit("click"), F.lit("view"))), ",")
    return seen.select("user_id", F.nullif(left, F.lit("")).alias("targets"))
