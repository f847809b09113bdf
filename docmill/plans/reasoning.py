"""Issues, elements and plans: orders stand for issues, lines for their elements, parts for articles."""

from pyspark.sql import functions as F

from docmill.operators import graphs
from docmill.operators import reasoning as R
from docmill.plans.registry import query
from docmill.tables import dealt, table, tasks

#: Each order is a plan, each of its lines a step; what a step needs follows from its part and supplier.
STEPS_SQL = """g AS (SELECT l_orderkey AS plan_id, l_linenumber AS n, min(l_partkey) AS a, min(l_suppkey) AS b, max(l_returnflag) AS flag, max(l_linestatus) AS status FROM lineitem GROUP BY ALL),
steps AS (SELECT plan_id, plan_id || '-' || n AS step_id, flag, status, list_filter([CASE WHEN a % 3 <> 0 AND n > 1 THEN plan_id || '-' || (n - 1) END, CASE WHEN b % 4 = 0 THEN plan_id || '-' || ((n + b) % 7 + 1) END], lambda x: x IS NOT NULL) AS deps FROM g),
e AS (SELECT DISTINCT step_id AS s, unnest(deps) AS d FROM steps)"""


def steps(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    own = dealt(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"), tasks(lines), "l_orderkey")
    g = own.groupBy(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("a"), F.min("l_suppkey").alias("b"), F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"))
    named = lambda n: F.concat_ws("-", F.col("plan_id").cast("string"), n.cast("string"))
    needs = F.array(F.when((F.col("a") % 3 != 0) & (F.col("n") > 1), named(F.col("n") - 1)), F.when(F.col("b") % 4 == 0, named((F.col("n") + F.col("b")) % 7 + 1)))
    return g.select("plan_id", named(F.col("n")).alias("step_id"), F.array_compact(needs).alias("depends_on"), "flag", "status")


@query(
    "dag_waves",
    f"""WITH RECURSIVE {STEPS_SQL}, w AS (SELECT step_id AS s, 1 AS depth FROM steps UNION SELECT s, 9 FROM e WHERE d NOT IN (SELECT step_id FROM steps) UNION SELECT e.s, least(w.depth + 1, 9) FROM w JOIN e ON e.d = w.s)
    SELECT s AS step_id, CASE WHEN max(depth) < 8 THEN max(depth) END::INT AS wave FROM w GROUP BY s""",
)
def dag_waves(spark, sf_dir):
    return graphs.peeled(steps(spark, sf_dir), "step_id", "depends_on")


LOOPS_SQL = f"""{STEPS_SQL}, r AS (SELECT s, d FROM e WHERE d IN (SELECT step_id FROM steps) UNION SELECT r.s, e.d FROM r JOIN e ON e.s = r.d WHERE e.d IN (SELECT step_id FROM steps)),
looped AS (SELECT s FROM r WHERE s = d), reached AS (SELECT d AS s FROM r SEMI JOIN looped USING (s) UNION SELECT s FROM looped), reaching AS (SELECT r.s FROM r JOIN looped ON r.d = looped.s),
on_loop AS (SELECT s FROM reached INTERSECT SELECT s FROM reaching)"""


@query("cycle_steps", f"WITH RECURSIVE {LOOPS_SQL} SELECT s AS step_id FROM on_loop")
def cycle_steps(spark, sf_dir):
    return graphs.looped(steps(spark, sf_dir), "step_id", "depends_on")


@query("cycle_check", f"WITH RECURSIVE {LOOPS_SQL} SELECT plan_id, bool_or(on_loop.s IS NOT NULL) AS cyclic FROM steps LEFT JOIN on_loop ON step_id = s GROUP BY plan_id")
def cycle_check(spark, sf_dir):
    whole = steps(spark, sf_dir)
    on = graphs.looped(whole, "step_id", "depends_on").withColumn("on", F.lit(True))
    return whole.join(on, "step_id", "left").groupBy("plan_id").agg(F.bool_or(F.col("on").isNotNull()).alias("cyclic"))


@query(
    "plan_faults",
    f"""WITH {STEPS_SQL}, raw AS (SELECT l_orderkey || '-' || l_linenumber AS step_id, l_returnflag AS tool, CASE WHEN l_quantity > 45 THEN ' ' ELSE l_linestatus END AS q FROM lineitem)
    SELECT 'duplicate_id' AS fault, step_id FROM raw GROUP BY step_id HAVING count(*) > 1 UNION SELECT 'unknown_tool', step_id FROM raw WHERE tool NOT IN ('A', 'N') UNION SELECT 'empty_query', step_id FROM raw WHERE trim(q) = ''
    UNION SELECT 'unknown_dependency', s FROM e WHERE d NOT IN (SELECT step_id FROM steps)""",
)
def plan_faults(spark, sf_dir):
    whole = steps(spark, sf_dir)
    named = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("step_id")
    raw = table(spark, sf_dir, "lineitem").select(named, F.col("l_returnflag").alias("tool"), F.when(F.col("l_quantity") > 45, " ").otherwise(F.col("l_linestatus")).alias("query"))
    return R.plan_faults(raw.join(whole.select("step_id", "depends_on"), "step_id"), ["A", "N"])


@query(
    "ready_steps",
    f"WITH {STEPS_SQL} SELECT step_id FROM steps WHERE status <> 'F' AND flag <> 'R' AND step_id NOT IN (SELECT s FROM e WHERE d NOT IN (SELECT step_id FROM steps WHERE status = 'F'))",
)
def ready(spark, sf_dir):
    whole = steps(spark, sf_dir)
    return R.ready(whole, whole.filter("status = 'F'"), whole.filter("flag = 'R'"), n_tasks=2 * tasks(table(spark, sf_dir, "lineitem")))


@query("shared_article_groups", "SELECT l_partkey, count(DISTINCT l_orderkey) AS n_issues, min(l_orderkey) AS first_issue, max(l_orderkey) AS last_issue FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) > 1")
def shared_groups(spark, sf_dir):
    return R.shared_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query(
    "shared_entity_pairs",
    """WITH e AS (SELECT DISTINCT l_orderkey AS i, l_partkey AS e FROM lineitem) SELECT a.i AS issue_a, b.i AS issue_b, count(*) AS n_shared, list_aggregate(list_sort(list(a.e))[1:5]::VARCHAR[], 'string_agg', ',') AS shared FROM e a JOIN e b ON a.e = b.e AND a.i < b.i GROUP BY ALL HAVING count(*) >= 2""",
)
def shared_pairs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    pairs = R.shared_entity_pairs(lines, "l_orderkey", "l_partkey", n_tasks=tasks(lines))
    return pairs.withColumn("shared", F.array_join(F.col("shared").cast("array<string>"), ","))


@query(
    "completeness_ratio",
    """SELECT l_orderkey, count(*) AS n_required, count(*) FILTER (WHERE ok) AS n_covered, round(count(*) FILTER (WHERE ok)::DOUBLE / count(*), 6) AS ratio FROM (SELECT l_orderkey, l_partkey, bool_or(l_returnflag = 'N') AS ok FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""",
)
def completeness(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    out = R.completeness(lines, lines.filter("l_returnflag = 'N'"), "l_orderkey", "l_partkey", n_tasks=2 * tasks(lines))
    return out.withColumn("ratio", F.round("ratio", 6))


ISSUES = """i AS (SELECT l_orderkey AS issue_id, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS unsupported, count(*) FILTER (WHERE l_returnflag = 'A') AS disputed, count(*) FILTER (WHERE l_linestatus = 'F' AND l_quantity > 40) AS insufficient,
count(DISTINCT l_partkey) AS citations, count(*) FILTER (WHERE l_discount > 0.09) AS missing, l_orderkey % 3 AS sev, count(*) FILTER (WHERE l_linestatus = 'O')::DOUBLE / count(*) AS coverage, l_orderkey % 10 = 0 AS conflict FROM lineitem GROUP BY l_orderkey),
s AS (SELECT issue_id, greatest(0.0, 1.0 - (unsupported / n * 0.25 + disputed / n * 0.15 + insufficient / n * 0.20 + missing / greatest(citations, 1) * 0.15 + sev / 2 * 0.10 + (1.0 - coverage) * 0.10 + (CASE WHEN conflict THEN 0.05 ELSE 0.0 END)))::DOUBLE AS score FROM i)"""


def issues(spark, sf_dir):
    sev = F.get(F.array(*[F.lit(x) for x in ("none", "minor", "major")]), (F.col("l_orderkey") % 3).cast("int"))
    lines = table(spark, sf_dir, "lineitem")
    own = dealt(lines.select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount"), tasks(lines), "l_orderkey")
    got = own.groupBy("l_orderkey").agg(
        F.count("*").alias("n_elements"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_unsupported"),
        F.count_if(F.col("l_returnflag") == "A").alias("n_disputed"),
        F.count_if((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 40)).alias("n_insufficient"),
        F.count_distinct("l_partkey").alias("n_citations"),
        F.count_if(F.col("l_discount") > 0.09).alias("n_missing"),
        (F.count_if(F.col("l_linestatus") == "O") / F.count("*")).alias("coverage"),
    )
    return got.select(F.col("l_orderkey").alias("issue_id"), *got.columns[1:], sev.alias("severity"), (F.col("l_orderkey") % 10 == 0).alias("conflict"))


@query("weighted_confidence", f"WITH {ISSUES} SELECT issue_id, round(score, 5) AS score, CASE WHEN round(score, 5) >= 0.75 THEN 'high' WHEN round(score, 5) >= 0.45 THEN 'medium' ELSE 'low' END AS level FROM s")
def weighted_confidence(spark, sf_dir):
    scored = R.confidence(issues(spark, sf_dir)).withColumn("score", F.round("score", 5))
    return scored.withColumn("level", R.vectors.level(F.col("score"), R.HIGH, R.MEDIUM))


@query("case_score", f"WITH {ISSUES} SELECT o_custkey, round(0.7 * min(score) + 0.3 * avg(score) + 1e-9, 5) AS case_score FROM s JOIN orders ON issue_id = o_orderkey GROUP BY o_custkey")
def case_score(spark, sf_dir):
    of = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("issue_id"), "o_custkey")
    of = dealt(of, tasks(table(spark, sf_dir, "lineitem")), "issue_id")
    out = R.case_score(R.confidence(issues(spark, sf_dir)).join(of, "issue_id"), "o_custkey")
    return out.withColumn("case_score", F.round(F.col("case_score") + 1e-9, 5))


@query("applicable_elements", "SELECT d.doc_id, coalesce(CASE l.quality WHEN 1 THEN 'proved' WHEN 0 THEN 'insufficient_evidence' END, 'disputed') AS status FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM 0")
def applicable(spark, sf_dir):
    told = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "proved").otherwise("insufficient_evidence").alias("status"))
    return R.applicable(table(spark, sf_dir, "documents").select("doc_id"), told, "doc_id")


@query("plan_terminal", "SELECT count(*) = 0 AS done FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def terminal(spark, sf_dir):
    steps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step_id"))
    return R.terminal(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("step_id")), steps)
