"""Vector retrieval over embeddings; label is the scope filter."""

from pyspark.sql import functions as F

from docmill.functions import vectors
from docmill.operators import ranking, retrieval as R
from docmill.plans.registry import query
from docmill.tables import table

# The query vector is the row with vec_id 0, a single row.
QV = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
SCORE = "round(list_inner_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(q::DOUBLE[], q::DOUBLE[]))), 6)"


def vectors_and_query(spark, sf_dir):
    corpus = table(spark, sf_dir, "embeddings")
    first = corpus.filter("vec_id = 0").select("embedding").head()
    return corpus, list(first[0]) if first else [0.0] * 64


@query("knn_filtered_topk", f"SELECT vec_id, label, {SCORE} AS score FROM embeddings, {QV} WHERE label = 5 ORDER BY score DESC, vec_id LIMIT 40")
def filtered(spark, sf_dir):
    corpus, q = vectors_and_query(spark, sf_dir)
    return R.top_k(R.scope(corpus, label=5), q, 40)


@query("knn_threshold", f"SELECT * FROM (SELECT vec_id, label, {SCORE} AS score FROM embeddings, {QV} ORDER BY score DESC, vec_id LIMIT 8) WHERE score >= 0.45")
def threshold(spark, sf_dir):
    corpus, q = vectors_and_query(spark, sf_dir)
    return R.top_k(corpus, q, 8, threshold=0.45)


@query(
    "knn_multi_query",
    """SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM (
    SELECT b.vec_id AS query_id, a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score
    FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0)) WHERE rank <= 10""",
)
def multi(spark, sf_dir):
    corpus = table(spark, sf_dir, "embeddings")
    asked = corpus.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.top_k_many(corpus, asked, 10)


@query(
    "knn_fallback_levels",
    f"""WITH s AS (SELECT vec_id, label, {SCORE} AS score FROM embeddings, {QV}), l AS (
    (SELECT *, 1 AS level FROM s WHERE label = 77 AND vec_id < 100 ORDER BY score DESC, vec_id LIMIT 8) UNION ALL
    (SELECT *, 2 AS level FROM s WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 8) UNION ALL (SELECT *, 3 AS level FROM s ORDER BY score DESC, vec_id LIMIT 8))
    SELECT * FROM l WHERE level = (SELECT min(level) FROM l)""",
)
def fallback(spark, sf_dir):
    corpus, q = vectors_and_query(spark, sf_dir)
    levels = [(F.col("label") == 77) & (F.col("vec_id") < 100), F.col("label") == 3, F.lit(True)]
    return R.fallback_levels(corpus, levels, q, 8)


@query(
    "retrieve_dedupe_confidence_grade",
    f"""WITH k AS (SELECT vec_id, label, {SCORE} AS score FROM embeddings, {QV} WHERE label < 8 ORDER BY score DESC, vec_id LIMIT 40),
    d AS (SELECT *, row_number() OVER (PARTITION BY vec_id % 15 ORDER BY score DESC, vec_id) AS rn FROM k), t AS (SELECT * FROM d WHERE rn = 1 ORDER BY score DESC, vec_id LIMIT 20),
    c AS (SELECT count(*) AS n_docs, coalesce(round(avg(coalesce(score, 0)), 3), 0) AS confidence FROM t),
    g AS (SELECT *, CASE WHEN n_docs = 0 THEN 'fail' WHEN confidence < 0.35 THEN 'refine' WHEN confidence < 0.55 THEN 'llm' ELSE 'pass' END AS grade FROM c)
    SELECT *, CASE grade WHEN 'pass' THEN 'generate' WHEN 'refine' THEN 'refine' WHEN 'llm' THEN 'llm_grader' ELSE 'cannot_answer' END AS route FROM g""",
)
def dedupe_confidence_grade(spark, sf_dir):
    """Top 40 in scope, one per article (vec_id mod 15 stands for its number), best 20, mean score, grade, route."""
    corpus, q = vectors_and_query(spark, sf_dir)
    best = R.top_k(corpus.filter("label < 8"), q, 40).withColumn("article", F.col("vec_id") % 15)
    once = ranking.keep_best(best, "article", "score", "vec_id").orderBy(F.desc("score"), "vec_id").limit(20)
    return R.grade(once)


@query("mmr_topk")
def mmr(spark, sf_dir):
    corpus, q = vectors_and_query(spark, sf_dir)
    near = R.top_k(corpus, q, 40).select("vec_id")
    return R.mmr(corpus.join(F.broadcast(near), "vec_id"), q, 8)


@query(
    "pairwise_label_similarity",
    """SELECT a.label, count(*) AS n_pairs, round(avg(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS mean_similarity
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label""",
)
def pairwise(spark, sf_dir):
    """Agreement of repeated answers: the vectors of a label stand for the answers to one question."""
    return R.mean_pair_similarity(table(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("mean_similarity", F.round("mean_similarity", 5))


@query("unit_vectors", "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS size, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first FROM embeddings")
def unit(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("size"), F.round(F.get(vectors.unit(F.col("embedding")), F.lit(0)), 5).alias("first"))


@query(
    "rerank_overlap",
    """WITH q AS (SELECT text FROM benchmark WHERE item_id = 0), w AS (SELECT list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-zA-ZÀ-ÿ0-9]+'), lambda x: x <> '')) AS qs FROM q)
    SELECT doc_id, round(len(list_intersect(qs, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-zA-ZÀ-ÿ0-9]+'), lambda x: x <> ''))))::DOUBLE / len(qs), 6) AS rerank_score
    FROM documents, w ORDER BY rerank_score DESC, doc_id LIMIT 20""",
)
def rerank(spark, sf_dir):
    question = table(spark, sf_dir, "benchmark").filter("item_id = 0").select("text").head()[0]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(0.0).alias("score"))
    relevance = F.round(R.lexical_overlap(F.lit(question), F.col("text")), 6)
    return R.rerank(docs, relevance, 20, "doc_id").select("doc_id", "rerank_score")


COSINE = "round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 9)"


@query(
    "mmr_many_queries",
    f"""WITH r AS (SELECT b.vec_id AS query_id, a.vec_id, {COSINE} AS rel FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 7 AND a.vec_id <> b.vec_id),
    c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rel, 6) DESC, vec_id) AS rn FROM r) WHERE rn <= 20),
    x AS (SELECT query_id, a.vec_id AS u, b.vec_id AS v, {COSINE} AS near FROM (SELECT query_id, vec_id FROM c) p JOIN embeddings a ON a.vec_id = p.vec_id JOIN (SELECT query_id AS q2, vec_id AS w FROM c) o ON o.q2 = p.query_id JOIN embeddings b ON b.vec_id = o.w),
    one AS (SELECT query_id, arg_min(vec_id, (-round(0.5 * rel, 9), vec_id)) AS vec_id FROM c GROUP BY query_id),
    two AS (SELECT c.query_id, arg_min(c.vec_id, (-round(0.5 * rel - 0.5 * near, 9), c.vec_id)) AS vec_id FROM c JOIN one USING (query_id) JOIN x ON x.query_id = c.query_id AND x.u = c.vec_id AND x.v = one.vec_id WHERE c.vec_id <> one.vec_id GROUP BY c.query_id),
    three AS (SELECT c.query_id, arg_min(c.vec_id, (-round(0.5 * rel - 0.5 * greatest(x.near, y.near), 9), c.vec_id)) AS vec_id FROM c JOIN one ON one.query_id = c.query_id JOIN two ON two.query_id = c.query_id
    JOIN x ON x.query_id = c.query_id AND x.u = c.vec_id AND x.v = one.vec_id JOIN x y ON y.query_id = c.query_id AND y.u = c.vec_id AND y.v = two.vec_id WHERE c.vec_id NOT IN (one.vec_id, two.vec_id) GROUP BY c.query_id),
    p AS (SELECT *, 1 AS place FROM one UNION ALL SELECT *, 2 FROM two UNION ALL SELECT *, 3 FROM three)
    SELECT query_id, vec_id, place, round(rel, 6) AS score FROM p JOIN r USING (query_id, vec_id)""",
)
def mmr_many_queries(spark, sf_dir):
    """Every hundredth vector asks: its 20 nearest others, and three of them that differ."""
    corpus = table(spark, sf_dir, "embeddings")
    asked = corpus.filter("vec_id % 100 = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    near = R.top_k_many(corpus, asked, 21).filter("vec_id <> query_id").select("query_id", "vec_id")
    return R.mmr_many(near.join(corpus.select("vec_id", "embedding"), "vec_id").join(asked, "query_id"), "query_id", 3)


FLOW_SQL = """WITH q AS (SELECT vec_id AS question_id, embedding FROM embeddings WHERE vec_id % 100 = 0 UNION ALL SELECT vec_id - 1, embedding FROM embeddings WHERE vec_id % 100 = 1),
v AS (SELECT question_id, row_number() OVER () AS variant, embedding FROM q),
s AS (SELECT question_id, variant, a.vec_id, a.label, round(list_inner_product(a.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6) AS score FROM embeddings a, v),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn <= 10),
o AS (SELECT question_id, vec_id, any_value(label) AS label, max(score) AS score FROM t GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY label DESC, score DESC, vec_id)::INT AS place FROM o)"""


def asked_twice(spark, sf_dir):
    """Questions in two wordings: every hundredth vector and the one after it."""
    v = table(spark, sf_dir, "embeddings").filter("vec_id % 100 < 2")
    return v.select((F.col("vec_id") - F.col("vec_id") % 100).alias("question_id"), F.col("vec_id").alias("variant_id"), F.col("embedding").alias("q"), F.lit(0).alias("retries"))


@query("retrieval_flow_documents", FLOW_SQL + " SELECT question_id, vec_id, score, place FROM k WHERE place <= 6")
def flow_documents(spark, sf_dir):
    return R.flow(table(spark, sf_dir, "embeddings"), asked_twice(spark, sf_dir), 10, 6, F.col("label"))[0]


@query(
    "retrieval_flow_grades",
    FLOW_SQL
    + """, g AS (SELECT question_id, count(*) AS n_docs, round(avg(score), 3) AS confidence FROM k WHERE place <= 6 GROUP BY 1), h AS (SELECT *, CASE WHEN confidence < 0.35 THEN 'refine' WHEN confidence < 0.55 THEN 'llm' ELSE 'pass' END AS grade FROM g)
    SELECT *, CASE grade WHEN 'pass' THEN 'generate' WHEN 'refine' THEN 'refine' ELSE 'llm_grader' END AS route FROM h""",
)
def flow_grades(spark, sf_dir):
    return R.flow(table(spark, sf_dir, "embeddings"), asked_twice(spark, sf_dir), 10, 6, F.col("label"))[1]
