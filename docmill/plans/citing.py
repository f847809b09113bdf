"""Citations, fabricated numbers and contamination: anti joins and set differences."""

from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import citations as C
from docmill.plans.registry import query
from docmill.tables import table, tasks

# An answer cites as articles its order's parts (mod 97) and the order's own number (mod 7), which was not retrieved.
ANSWERS = """a AS (SELECT l_orderkey, min(l_partkey % 97)::INT AS lo, max(l_partkey % 97)::INT AS hi, (l_orderkey % 7 + 100)::INT AS bad FROM lineitem GROUP BY l_orderkey)"""


def answers(spark, sf_dir):
    part = (F.col("l_partkey") % 97).cast("int")
    got = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(part).alias("lo"), F.max(part).alias("hi"))
    bad = (F.col("l_orderkey") % 7 + 100).cast("int")
    say = lambda c: F.concat(F.lit("Article "), c.cast("string"))
    return got.select("l_orderkey", "lo", "hi", F.concat_ws(" and ", say(F.col("lo")), say(bad), say(F.col("hi"))).alias("answer"), bad.alias("bad"))


@query("citation_extract", f"WITH {ANSWERS} SELECT l_orderkey, CASE WHEN lo = hi THEN lo || ',' || bad ELSE lo || ',' || bad || ',' || hi END AS cited FROM a")
def extract(spark, sf_dir):
    found = T.cited_articles(F.col("answer"), r"Article\s+(\d+)")
    return answers(spark, sf_dir).select("l_orderkey", F.array_join(found.cast("array<string>"), ",").alias("cited"))


@query("citation_scrub", f"WITH {ANSWERS} SELECT l_orderkey, bad AS invalid, 'Article ' || lo || ' and and Article ' || hi AS scrubbed, 'partial' AS integrity FROM a")
def scrub(spark, sf_dir):
    rows = answers(spark, sf_dir)
    have = rows.select("l_orderkey", F.explode(F.array("lo", "hi")).alias("n"))
    found = T.cited_articles(F.col("answer"), r"Article\s+(\d+)")
    held = have.groupBy("l_orderkey").agg(F.collect_set("n").alias("have"))
    wrong = rows.withColumn("cited", found).join(held, "l_orderkey").withColumn("wrong", F.array_except("cited", "have"))
    return wrong.select(
        "l_orderkey",
        F.get("wrong", F.lit(0)).alias("invalid"),
        T.scrub_citations(F.col("answer"), F.col("wrong"), "Article").alias("scrubbed"),
        T.citation_integrity(F.col("cited"), F.col("wrong")).alias("integrity"),
    )


@query(
    "citation_verified_counts",
    """WITH c AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), k AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 10)
    SELECT c.l_orderkey, count(*) AS total, count(k.l_partkey) AS verified, coalesce(string_agg(CASE WHEN k.l_partkey IS NULL THEN c.l_partkey END, ',' ORDER BY c.l_partkey), '') AS missing
    FROM c LEFT JOIN k USING (l_orderkey, l_partkey) GROUP BY c.l_orderkey""",
)
def verified(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    out = C.verified_counts(lines, lines.filter("l_quantity > 10"), "l_orderkey", "l_partkey", n_tasks=2 * tasks(lines))
    return out.withColumn("missing", F.array_join(F.col("missing").cast("array<string>"), ","))


@query(
    "citation_unverified",
    """SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)""",
)
def unverified(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    small = table(spark, sf_dir, "part").filter("p_size < 25").select(F.col("p_partkey").alias("l_partkey"))
    return C.unverified(lines, [lines.filter("l_returnflag = 'R'"), small], ["l_partkey"])


@query(
    "fabrication_check",
    r"""WITH n AS (SELECT doc_id, source, x AS number FROM (SELECT doc_id, source, unnest(regexp_extract_all(text, '\b[0-9][0-9,./]*\b')) AS x FROM documents) WHERE length(x) > 1)
    SELECT DISTINCT source, number FROM n WHERE doc_id % 10 = 0 AND (source, number) NOT IN (SELECT source, number FROM n WHERE doc_id % 10 <> 0)""",
)
def fabrication(spark, sf_dir):
    """Every tenth document of a source stands for its summary, the others for its inputs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return C.fabricated(docs.filter("doc_id % 10 = 0"), docs.filter("doc_id % 10 <> 0"), "source", "text", "text")


@query("query_article_range", "SELECT o_orderkey, o_orderkey % 50 AS start, o_orderkey % 50 + 3 AS stop, 4 AS n FROM orders")
def article_range(spark, sf_dir):
    """A question's range of articles, looked up by its numbers: an equi join on the sequence."""
    n = (F.col("o_orderkey") % 50).cast("string")
    asked = table(spark, sf_dir, "orders").select("o_orderkey", T.query_range(F.concat(F.lit("من "), n, F.lit(" إلى "), (F.col("o_orderkey") % 50 + 3).cast("string"))).alias("r"))
    each = asked.select("o_orderkey", "r", F.explode(F.sequence("r.start", "r.end")).alias("k"))
    known = spark.range(0, 60).select(F.col("id").cast("int").alias("k"))
    return each.join(known, "k").groupBy("o_orderkey").agg(F.min("r.start").cast("long").alias("start"), F.max("r.end").cast("long").alias("stop"), F.count("*").cast("int").alias("n"))


@query("article_scan", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey IN (3, 5, 8, 13, 21) AND p_size > 1 ORDER BY p_partkey")
def in_list(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.col("p_partkey").isin(3, 5, 8, 13, 21) & (F.col("p_size") > 1)).select("p_partkey", "p_brand", "p_size").orderBy("p_partkey")


@query(
    "retrieval_eval_metrics",
    """WITH e AS (SELECT label, count(*) AS n_expected, count(*) FILTER (WHERE vec_id % 3 <> 0) AS n_found FROM embeddings GROUP BY label)
    SELECT count(*) AS n_queries, round(avg(n_found::DOUBLE / n_expected), 6) AS recall, round(avg(CASE WHEN n_found::DOUBLE / n_expected >= 0.6 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM e""",
)
def eval_metrics(spark, sf_dir):
    per = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % 3 != 0).alias("f"))
    r = per.withColumn("r", F.col("f") / F.col("n"))
    return r.agg(F.count("*").alias("n_queries"), F.round(F.avg("r"), 6).alias("recall"), F.round(F.avg((F.col("r") >= 0.6).cast("double")), 6).alias("accuracy"))
