"""Multi-document aggregation over documents: source stands for the party, language for the document type."""

from pyspark.sql import functions as F

from docmill.operators import ranking as K, summaries as S
from docmill.plans.registry import query
from docmill.tables import table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")


@query("party_manifest", "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS doc_types FROM documents GROUP BY source")
def party_manifest(spark, sf_dir):
    return S.manifest(docs(spark, sf_dir), "source", "lang").withColumn("doc_types", F.array_join("doc_types", ","))


@query(
    "ghost_party_merge",
    """WITH m AS (SELECT source, lang FROM documents GROUP BY ALL), v AS (SELECT a.source AS base, b.source FROM (SELECT DISTINCT source FROM m) a, (SELECT DISTINCT source FROM m) b WHERE b.source LIKE a.source || '%' AND a.source <> b.source),
    u AS (SELECT source, lang FROM m WHERE source NOT IN (SELECT base FROM v) UNION SELECT v.source, m.lang FROM v JOIN m ON m.source = v.base WHERE v.source NOT IN (SELECT base FROM v))
    SELECT source, string_agg(lang, ',' ORDER BY lang) AS doc_types FROM u GROUP BY source""",
)
def ghosts(spark, sf_dir):
    merged = S.merge_ghosts(S.manifest(docs(spark, sf_dir), "source", "lang"), "source")
    return merged.withColumn("doc_types", F.array_join("doc_types", ","))


@query("parties_without_defence", "SELECT source FROM documents WHERE source <> 'src0' GROUP BY source HAVING NOT bool_or(lang = 'es' AND n_chars < 500)")
def without_defence(spark, sf_dir):
    kinds = docs(spark, sf_dir).withColumn("kind", F.when((F.col("lang") == "es") & (F.col("n_chars") < 500), "defence").otherwise("other"))
    return S.without_types(kinds, "source", "kind", ["defence"], ["src0"])


@query("several_parties", "SELECT lang, count(DISTINCT source) > 1 AS several FROM documents GROUP BY lang")
def several(spark, sf_dir):
    return S.several_parties(docs(spark, sf_dir), "lang", "source")


@query("source_ordered_distinct", "SELECT lang, string_agg(source, ',' ORDER BY p) AS sources FROM (SELECT lang, source, min(doc_id) AS p FROM documents GROUP BY ALL) GROUP BY lang")
def ordered_distinct(spark, sf_dir):
    out = K.ordered_distinct(docs(spark, sf_dir), ["lang"], "source", "doc_id")
    return out.select("lang", F.array_join("sources", ",").alias("sources"))


@query("ci_distinct", "SELECT conv_id, count(*) AS n FROM (SELECT DISTINCT conv_id, lower(trim(role, ' ')) FROM conversations) GROUP BY conv_id")
def ci_distinct(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("said", F.when(F.col("turn") % 2 == 0, F.upper("role")).otherwise(F.col("role")))
    out = K.ordered_distinct(turns, ["conv_id"], "said", "turn", F.lower(F.trim("said")))
    return out.select("conv_id", F.size("saids").cast("long").alias("n"))


@query(
    "coverage_repair",
    """WITH p AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'agreed' WHEN 1 THEN 'disputed' ELSE 'party_specific' END AS bucket, doc_id AS pos FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id + 100000000, 'agreed', 0 FROM documents WHERE doc_id % 50 = 0 UNION ALL SELECT doc_id, 'disputed', 1 FROM documents WHERE doc_id % 4 = 1),
    f AS (SELECT doc_id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE bucket WHEN 'agreed' THEN 0 WHEN 'disputed' THEN 1 ELSE 2 END, pos) AS rn FROM p) WHERE rn = 1)
    SELECT d.doc_id, coalesce(f.bucket, 'party_specific') AS bucket, f.bucket IS NULL AS repaired FROM documents d LEFT JOIN f USING (doc_id)""",
)
def coverage(spark, sf_dir):
    known = docs(spark, sf_dir).select("doc_id")
    kind = F.when(F.col("doc_id") % 3 == 0, "agreed").when(F.col("doc_id") % 3 == 1, "disputed").otherwise("party_specific")
    placed = known.filter("doc_id % 5 <> 0").select("doc_id", kind.alias("bucket"), F.col("doc_id").alias("pos"))
    placed = placed.unionByName(known.filter("doc_id % 50 = 0").select((F.col("doc_id") + 100000000).alias("doc_id"), F.lit("agreed").alias("bucket"), F.lit(0).cast("long").alias("pos")))
    placed = placed.unionByName(known.filter("doc_id % 4 = 1").select("doc_id", F.lit("disputed").alias("bucket"), F.lit(1).cast("long").alias("pos")))
    return K.coverage(placed, known, "doc_id", "bucket", "pos", {"agreed": 0, "disputed": 1, "party_specific": 2}, "party_specific")


@query("theme_merge", "SELECT lang AS theme, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY lang")
def theme_merge(spark, sf_dir):
    lists = docs(spark, sf_dir).groupBy(F.col("lang").alias("theme"), "source").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    out = S.merge_themes(lists.withColumn("batch", F.get("ids", F.lit(0))), "theme", "ids", "batch")
    return out.select("theme", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("first_id"))


@query(
    "role_aggregation",
    """WITH b AS (SELECT lang, source, doc_id, CASE WHEN lang = 'fr' THEN 'party_specific' WHEN doc_id % 3 = 0 THEN 'agreed' WHEN doc_id % 3 = 1 THEN 'disputed' ELSE 'party_specific' END AS kind FROM documents)
    SELECT lang, count(*) FILTER (WHERE kind = 'agreed') AS n_agreed, count(*) FILTER (WHERE kind = 'disputed') AS n_disputed, count(*) FILTER (WHERE kind = 'party_specific') AS n_specific, count(*) AS bullet_count FROM b GROUP BY lang""",
)
def role_aggregation(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "agreed").when(F.col("doc_id") % 3 == 1, "disputed").otherwise("party_specific")
    one = F.when(F.col("lang") == "fr", "only").otherwise(F.col("source"))
    bullets = docs(spark, sf_dir).select("lang", one.alias("party"), kind.alias("kind"), "doc_id", F.col("doc_id").cast("string").alias("text"))
    out = S.roles(bullets, "lang", "kind", "party", "doc_id", "text")
    sizes = {"n_agreed": "agreed", "n_disputed": "disputed", "n_specific": "party_specific"}
    return out.select("lang", *[F.size(c).cast("long").alias(n) for n, c in sizes.items()], S.bullet_count(*[F.col(c) for c in sizes.values()]).cast("long").alias("bullet_count"))


@query("item_ids", "SELECT doc_id, CASE WHEN n_chars > 1000 THEN 'A' ELSE 'P' END || format('{:03d}', row_number() OVER (PARTITION BY source, n_chars > 1000 ORDER BY doc_id)) AS item_id FROM documents")
def item_ids(spark, sf_dir):
    kinds = docs(spark, sf_dir).withColumn("kind", F.when(F.col("n_chars") > 1000, "agreed").otherwise("party_specific"))
    return K.item_ids(kinds, "source", "kind", [F.col("doc_id")], {"agreed": "A", "party_specific": "P"}).select("doc_id", "item_id")


@query("batch_ids", "SELECT doc_id, ((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 10)::BIGINT AS batch FROM documents")
def batch_ids(spark, sf_dir):
    return K.batches(docs(spark, sf_dir), "lang", [F.col("doc_id")], 10).select("doc_id", F.col("batch").cast("long").alias("batch"))


@query("bullet_resolution", "SELECT o_orderkey, string_agg(p_name, '|' ORDER BY l_linenumber, l_partkey) AS names FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, l_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 20) GROUP BY o_orderkey")
def resolution(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))
    known = table(spark, sf_dir, "part").filter("p_size > 20").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return S.resolve(lines, known, "o_orderkey", "ids", "id", "name").select("o_orderkey", F.array_join("names", "|").alias("names"))


@query("extraction_fallback", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN lang ELSE 'quality ' || l.quality END AS bullet, l.doc_id IS NULL AS fallback FROM documents d LEFT JOIN labels l USING (doc_id)")
def extraction_fallback(spark, sf_dir):
    found = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("bullet"))
    return S.with_fallback(docs(spark, sf_dir), found, "doc_id", "bullet", "lang")


@query("role_labels", "SELECT d.doc_id, coalesce('q' || l.quality, 'undefined') AS role FROM documents d LEFT JOIN labels l USING (doc_id)")
def role_labels(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("role"))
    return S.with_label(docs(spark, sf_dir).select("doc_id"), known, "doc_id", "role", "undefined")


MERGE = """WITH r AS (SELECT conv_id, turn, role, text AS a, role = 'assistant' AS found FROM conversations), s AS (SELECT conv_id, bool_or(found) AS any_found FROM r GROUP BY conv_id),
u AS (SELECT r.*, any_found FROM r JOIN s USING (conv_id) WHERE found OR NOT any_found)
SELECT conv_id, any_found AS found, CASE WHEN count(*) = 1 THEN min(a) ELSE string_agg('**' || role || '**' || chr(10) || a, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) END AS answer FROM u GROUP BY conv_id, any_found"""


@query("merged_answers", MERGE)
def merged(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("a"), (F.col("role") == "assistant").alias("ok"))
    return S.merged_answer(rows, "conv_id", "role", "a", "ok", "turn")


@query("agent_merge", """SELECT conv_id, CASE WHEN count(*) FILTER (WHERE role <> 'system') = 1 THEN min(a) FILTER (WHERE role <> 'system') ELSE coalesce(string_agg('[' || role || turn || ']' || chr(10) || a, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role <> 'system'), '') END AS merged,
coalesce(string_agg(role || turn, ',' ORDER BY role || turn) FILTER (WHERE role = 'system'), '') AS failed FROM (SELECT *, text AS a FROM conversations) GROUP BY conv_id""")
def agent_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.col("turn").cast("string")).alias("agent"), F.col("text").alias("a"), F.when(F.col("role") == "system", "down").alias("error"))
    return S.merged_agents(rows, "conv_id", "agent", "a", "error", "turn").withColumn("failed", F.array_join("failed", ","))


@query("report_sections", "SELECT conv_id, string_agg('## ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS report FROM conversations WHERE trim(text, ' ') <> '' GROUP BY conv_id")
def report(spark, sf_dir):
    return S.report(table(spark, sf_dir, "conversations"), "conv_id", "role", "text", "turn")
