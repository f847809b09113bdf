"""Records and paging: orders stand for cases, customers for users, lines and turns for their children."""

from pyspark.sql import functions as F

from docmill.functions import guards as G, text as T, vectors as V
from docmill.operators import cases as C, ranking as K
from docmill.plans.registry import query
from docmill.tables import table


@query("pagination", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def pagination(spark, sf_dir):
    """A page of a listing: the limit is the feature."""
    alive = table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "deleted").otherwise("open"))
    return K.page(C.alive(alive), F.desc("o_orderdate"), F.col("o_orderkey"), skip=40, limit=20).select("o_orderkey", "o_orderstatus")


@query("case_conversation_counts", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def counts(spark, sf_dir):
    children = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return C.with_counts(table(spark, sf_dir, "customer").select("c_custkey"), children, "c_custkey", "n_orders")


@query("soft_delete_owner", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey")
def soft_delete(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "deleted").otherwise("open"))
    return C.alive(rows).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("latest_summary", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return K.latest(rows, "o_custkey", "at", "o_orderkey")


@query("insert_if_absent", "SELECT source, min(doc_id) AS doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 1) GROUP BY source")
def insert_if_absent(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    stored = docs.join(table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return C.insert_if_absent(stored, docs, ["source"], [F.col("doc_id")]).select("source", "doc_id")


@query("left_split_errors", "SELECT (l.doc_id IS NULL) AS missing, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def left_split(spark, sf_dir):
    found, missing = C.found_and_missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")
    both = found.select(F.lit(False).alias("missing")).unionByName(missing.select(F.lit(True).alias("missing")))
    return both.groupBy("missing").agg(F.count("*").alias("n"))


@query(
    "keyed_upsert_lww",
    "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
)
def upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    old, new = rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1")
    return C.upsert(old, new, "user_id", "ts").select("user_id", "event_id", "event_type")


@query("partial_update", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'NEW' END, c_mktsegment) AS c_mktsegment, c_name FROM customer")
def partial_update(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    changes = rows.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "NEW").alias("c_mktsegment"), F.lit(None).cast("string").alias("c_name"))
    return C.update(rows, changes, "c_custkey", ["c_mktsegment", "c_name"])


@query("keep_non_null", "SELECT user_id, arg_max(value, event_id) FILTER (WHERE event_type = 'purchase') AS value FROM events GROUP BY user_id")
def keep_non_null(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"))
    return K.keep_non_null(rows, "user_id", "event_id", "value")


@query(
    "append_or_reset",
    "WITH r AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id) AS m FROM events) SELECT user_id, count(*) AS n, min(event_id) AS first_id FROM r WHERE event_id > coalesce(m, -1) AND event_type <> 'signup' GROUP BY user_id",
)
def append_or_reset(spark, sf_dir):
    left = K.append_or_reset(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "signup")
    return left.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("max_merge", "SELECT user_id, max(event_id % 7) AS failures FROM events WHERE event_type = 'error' GROUP BY user_id")
def max_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'").withColumn("failures", F.col("event_id") % 7)
    return K.max_merge(rows, "user_id", "failures")


@query("first_capped_failure", "SELECT user_id, count(*) AS failures, arg_max(props, event_id) AS last_error FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= 3 ORDER BY user_id LIMIT 1")
def first_capped(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id", "event_id", F.col("props").alias("error"))
    return K.first_capped(rows, "user_id", "event_id", 3)


@query("upload_faults", "SELECT p_partkey, CASE WHEN p_size % 5 > 2 THEN 'INVALID_MIME_TYPE' WHEN p_retailprice > 1500 THEN 'FILE_TOO_LARGE' END AS fault FROM part")
def uploads(spark, sf_dir):
    mime = F.when(F.col("p_size") % 5 > 2, "text/x").otherwise("application/pdf")
    return table(spark, sf_dir, "part").select("p_partkey", G.upload_fault(mime, F.col("p_retailprice"), ["application/pdf"], 1500).alias("fault"))


@query("doc_titles", "SELECT source, string_agg(lang || ' (' || coalesce(CASE WHEN n_chars > 2000 THEN 'long' END, '?') || ')', '|' ORDER BY doc_id) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 20 GROUP BY source")
def doc_titles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("kind", F.when(F.col("n_chars") > 2000, "long"))
    return C.titles(docs, "source", "lang", "kind", "doc_id").withColumn("titles", F.array_join("titles", "|"))


@query("row_body", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text ELSE '-' END AS body FROM benchmark")
def row_body(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, F.col("text")).alias("content"), F.lit("-").alias("body"))
    return rows.select("item_id", C.body("content", "body").alias("body"))


@query("memory_namespaces", "SELECT DISTINCT 'user/' || (user_id % 10) AS namespace FROM events ORDER BY namespace LIMIT 5 OFFSET 2")
def namespaces(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("user/"), (F.col("user_id") % 10).cast("string")).alias("namespace"))
    return C.namespaces(rows, "user/", 5, 2)


@query("remembered_facts", "SELECT user_id, left(string_agg(event_type || event_id, '; ' ORDER BY event_id DESC), 800) AS memory FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 8 GROUP BY user_id")
def remembered(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("fact", F.concat("event_type", F.col("event_id").cast("string")))
    return C.remembered(rows, "user_id", "event_id", "fact")


@query("backoff_levels", "SELECT event_id, least(2.0 * pow(2.0, event_id % 5), 10.0) AS wait, CASE WHEN value >= 85 THEN 'high' WHEN value >= 60 THEN 'medium' ELSE 'low' END AS level, CASE event_type WHEN 'error' THEN 1.0 WHEN 'click' THEN 0.5 ELSE 0.0 END AS severity FROM events")
def backoff(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        V.backoff(F.col("event_id") % 5 + 1).alias("wait"),
        V.level(F.col("value"), 85, 60).alias("level"),
        V.lookup(F.col("event_type"), {"error": 1.0, "click": 0.5}, 0.0).alias("severity"),
    )


@query("transient_errors", "SELECT event_id, event_type IN ('error', 'click') AS transient FROM events")
def transient(spark, sf_dir):
    say = F.when(F.col("event_type") == "error", "HTTP 503 from x").when(F.col("event_type") == "click", "Too Many Requests").otherwise("bad input")
    return table(spark, sf_dir, "events").select("event_id", G.is_transient(say).alias("transient"))


@query("tool_names", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'purchases' WHEN 'view' THEN 'view_document' ELSE 'law' END AS tool FROM events")
def tool_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", G.tool_name(F.col("event_type"), ["purchases", "view_document"], "law").alias("tool"))


@query(
    "output_verdict",
    """SELECT event_id, CASE WHEN r AND c AND g AND h THEN 'pass' WHEN r AND g AND h THEN 'partial_pass' WHEN NOT g OR NOT h THEN 'fail_hallucination' WHEN NOT r THEN 'fail_relevance' ELSE 'fail_completeness' END AS verdict
    FROM (SELECT event_id, event_id % 2 = 0 AS r, event_id % 3 <> 0 AS c, event_id % 5 <> 0 AS g, event_id % 7 <> 0 AS h FROM events)""",
)
def verdict(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", G.verdict(i % 2 == 0, i % 3 != 0, i % 5 != 0, i % 7 != 0).alias("verdict"))


@query("record_ids", "SELECT o_orderkey, 'case_' || left(md5(o_orderkey::VARCHAR), 12) AS case_id FROM orders")
def record_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.new_id("case", F.col("o_orderkey").cast("string")).alias("case_id"))
