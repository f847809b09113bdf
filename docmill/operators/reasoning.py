"""Plans as graphs, shared facts between issues, evidence and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import vectors
from docmill.tables import dealt

# How much each signal of an issue takes from its confidence, and where levels begin.
WEIGHTS = {
    "unsupported_ratio": 0.25,
    "disputed_ratio": 0.15,
    "insufficient_ratio": 0.20,
    "citation_failure_ratio": 0.15,
    "logical_issues": 0.10,
    "completeness_gap": 0.10,
    "reconciliation_triggered": 0.05,
}
HIGH, MEDIUM = 0.75, 0.45
SEVERITY = {"none": 0.0, "minor": 0.5, "major": 1.0}


def waves(steps: DataFrame, step: str = "step_id", deps: str = "depends_on") -> tuple[DataFrame, bool]:
    """(step, wave) of a plan, and whether it can't be finished (a cycle, or a step that is not there).

    A wave holds the steps whose dependencies are all in earlier ones; waves end when no step is
    ready. Plans are driven from the driver and are small.
    """
    left = [(r[step], set(r[deps] or [])) for r in steps.select(step, deps).toLocalIterator()]
    done: list[tuple[str, int]] = []
    have: set[str] = set()
    wave = 0
    while now := sorted(s for s, d in left if d <= have):
        wave += 1
        done += [(s, wave) for s in now]
        have |= set(now)
        left = [x for x in left if x[0] not in have]
    kind = steps.schema[step].dataType.simpleString()
    return steps.sparkSession.createDataFrame(done, f"{step} {kind}, wave int"), bool(left)


def ready(steps: DataFrame, completed: DataFrame, capped: DataFrame, step: str = "step_id", deps: str = "depends_on", n_tasks: int | None = None) -> DataFrame:
    """Steps not yet completed nor capped all of whose dependencies are completed; none needed counts too.

    Needs meet what is completed in one join; what is known of a step then comes together in one grouping. n_tasks: how many tasks take those.
    """
    each = steps.select(F.col(step).alias("_s"), F.explode_outer(deps).alias("_d"))
    done = completed.select(F.col(step).alias("_d"))
    known = dealt(done, n_tasks, "_d").distinct().withColumn("_ok", F.lit(True))
    free = each.filter("_d is null").select("_s", F.lit(True).alias("_met"), F.lit(False).alias("_out"))
    met = dealt(each.filter("_d is not null"), n_tasks, "_d").join(known, "_d", "left").select("_s", F.col("_ok").isNotNull().alias("_met"), F.lit(False).alias("_out"))
    out = done.unionByName(capped.select(F.col(step).alias("_d"))).filter("_d is not null").select(F.col("_d").alias("_s"), F.lit(None).cast("boolean").alias("_met"), F.lit(True).alias("_out"))
    told = dealt(free.unionByName(met).unionByName(out), n_tasks, "_s").groupBy("_s").agg(F.bool_and("_met").alias("_ready"), F.bool_or("_out").alias("_out"))
    return told.filter("_ready and not _out").select(F.col("_s").alias(step))


def plan_faults(steps: DataFrame, tools: list[str], step: str = "step_id", deps: str = "depends_on") -> DataFrame:
    """fault, step: duplicate ids, unknown tools, empty queries and dependencies that are not there."""
    twice = steps.groupBy(step).count().filter("count > 1").select(F.lit("duplicate_id").alias("fault"), step)
    tool = steps.filter(~F.coalesce(F.col("tool").isin(tools), F.lit(False))).select(F.lit("unknown_tool").alias("fault"), step)
    query = steps.filter(F.trim(F.coalesce("query", F.lit(""))) == "").select(F.lit("empty_query").alias("fault"), step)
    wanted = steps.select(F.col(step).alias("_s"), F.explode(deps).alias(step))
    lost = wanted.join(steps.select(step), step, "left_anti").select(F.lit("unknown_dependency").alias("fault"), F.col("_s").alias(step))
    return twice.unionByName(tool).unionByName(query).unionByName(lost).distinct()


def plan_is_valid(steps: DataFrame, tools: list[str], **names) -> bool:
    return not steps.isEmpty() and plan_faults(steps, tools, **names).isEmpty() and not waves(steps, **names)[1]


def prior_results(steps: DataFrame, results: DataFrame, step: str = "step_id", deps: str = "depends_on") -> DataFrame:
    """Each step's (step, response) pairs of what it depends on, in the order of its list."""
    each = steps.select(F.col(step).alias("_s"), F.posexplode(deps).alias("_p", step))
    rows = each.join(results.select(step, "response"), step).groupBy("_s").agg(F.array_sort(F.collect_list(F.struct("_p", step, "response"))).alias("_r"))
    return rows.select(F.col("_s").alias(step), F.transform("_r", lambda x: F.struct(x[step].alias("step"), x["response"].alias("response"))).alias("prior"))


def shared_keys(df: DataFrame, issue: str, key: str) -> DataFrame:
    """Keys (articles) that more than one issue has, with the number of issues and the first and last of them."""
    return df.groupBy(key).agg(F.count_distinct(issue).alias("n_issues"), F.min(issue).alias("first_issue"), F.max(issue).alias("last_issue")).filter("n_issues > 1")


def shared_entity_pairs(df: DataFrame, issue: str, entity: str, least: int = 2, n_tasks: int | None = None) -> DataFrame:
    """issue_a, issue_b, n_shared, shared (the first five, in order) of pairs with at least `least` entities in common.

    What two issues share is gathered from their meetings; no list of entities moves along with them. n_tasks: how many tasks take the rows of df.
    """
    met = meetings(df, issue, entity, least, n_tasks)
    keys = [c for c in ("e", "f") if c in met.columns]
    pairs = dealt(met, n_tasks, "issue_a", "issue_b").groupBy("issue_a", "issue_b").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(*keys))))).alias("both"))
    return pairs.select("issue_a", "issue_b", F.size("both").cast("long").alias("n_shared"), F.slice("both", 1, 5).alias("shared")).filter(F.col("n_shared") >= least)


def meetings(df: DataFrame, issue: str, entity: str, least: int = 2, n_tasks: int | None = None) -> DataFrame:
    """Pairs of issues (issue_a < issue_b) under each two entities (e < f) that both have; under each single one (e) for a `least` of 1.

    An issue of k entities is indexed k (k - 1) / 2 times, and meets only issues that share two for certain.
    """
    one = dealt(df.select(F.col(issue).alias("i"), F.col(entity).alias("e")).filter("i is not null and e is not null"), n_tasks, "i")
    sets = one.groupBy("i").agg(F.sort_array(F.collect_set("e")).alias("s")).filter(F.size("s") >= least)
    if least < 2:
        keys, index = ["e"], sets.select(F.explode("s").alias("e"), "i")
    else:
        firsts = sets.select("i", "s", F.posexplode("s").alias("at", "e"))
        keys, index = ["e", "f"], firsts.select("e", F.explode(F.slice("s", F.col("at") + 2, F.size("s"))).alias("f"), "i")
    index = dealt(index, n_tasks and 2 * n_tasks, *keys)
    a, b = (index.withColumnRenamed("i", f"issue_{x}") for x in "ab")
    return a.join(b, keys).filter("issue_a < issue_b")


def completeness(required: DataFrame, covered: DataFrame, key: str, element: str, n_tasks: int | None = None) -> DataFrame:
    """key, n_required, n_covered, ratio (null if nothing is required). n_tasks: how many tasks take the rows of both."""
    every = required.select(key, element, F.lit(True).alias("_asked"), F.lit(False).alias("_ok"))
    have = covered.select(key, element).filter(F.col(key).isNotNull() & F.col(element).isNotNull())
    both = dealt(every.unionByName(have.select(key, element, F.lit(False).alias("_asked"), F.lit(True).alias("_ok"))), n_tasks, key)
    each = both.groupBy(key, element).agg(F.bool_or("_asked").alias("_asked"), F.bool_or("_ok").alias("_ok")).filter("_asked")
    counted = each.groupBy(key).agg(F.count("*").alias("n_required"), F.count_if("_ok").alias("n_covered"))
    return counted.withColumn("ratio", F.try_divide(F.col("n_covered"), F.col("n_required")))


def signals(df: DataFrame, issue: str = "issue_id") -> DataFrame:
    """The seven ratios of each issue; an empty denominator counts as one, a missing coverage as full.

    df: issue, n_elements, n_unsupported, n_disputed, n_insufficient, n_citations, n_missing, severity, coverage, conflict.
    """
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return df.select(
        issue,
        per("n_unsupported", "n_elements").alias("unsupported_ratio"),
        per("n_disputed", "n_elements").alias("disputed_ratio"),
        per("n_insufficient", "n_elements").alias("insufficient_ratio"),
        per("n_missing", "n_citations").alias("citation_failure_ratio"),
        vectors.lookup(F.col("severity"), SEVERITY, 0.0).alias("logical_issues"),
        (1.0 - F.coalesce("coverage", F.lit(1.0))).alias("completeness_gap"),
        F.when(F.col("conflict"), 1.0).otherwise(0.0).alias("reconciliation_triggered"),
    )


def issue_score(weights: dict[str, float] = WEIGHTS) -> Column:
    penalty = F.lit(0.0)
    for name, w in weights.items():
        penalty = penalty + F.col(name) * w
    return F.greatest(F.lit(0.0), 1.0 - penalty)


def confidence(df: DataFrame, issue: str = "issue_id") -> DataFrame:
    scored = signals(df, issue).select(issue, issue_score().alias("score"))
    return scored.withColumn("level", vectors.level(F.col("score"), HIGH, MEDIUM))


def case_score(scores: DataFrame, key: str, score: str = "score") -> DataFrame:
    return scores.groupBy(key).agg((0.7 * F.min(score) + 0.3 * F.avg(score)).alias("case_score"))


def applicable(elements: DataFrame, statuses: DataFrame, element: str) -> DataFrame:
    """Elements with their status, disputed where none is known, without those of insufficient evidence."""
    told = elements.join(statuses, element, "left").withColumn("status", F.coalesce("status", F.lit("disputed")))
    return told.filter("status <> 'insufficient_evidence'")


def terminal(results: DataFrame, plan: DataFrame, step: str = "step_id") -> DataFrame:
    """done: whether every step of the plan has a result."""
    return plan.join(results.select(step).distinct(), step, "left_anti").agg((F.count("*") == 0).alias("done"))


def word_confidence(tokens: DataFrame, key: str, pos: str, token: str, p: str) -> DataFrame:
    """Words of a page (a token with a leading blank begins one) and the mean probability of their tokens."""
    begins = (F.substring(token, 1, 1).rlike(r"^\s") | (F.col(pos) == 0)).cast("int")
    w = Window.partitionBy(key).orderBy(pos)
    worded = tokens.withColumn("word_no", F.sum(begins).over(w))
    out = worded.groupBy(key, "word_no").agg(F.array_sort(F.collect_list(F.struct(F.col(pos), F.col(token).alias("t")))).alias("_t"), F.round(F.avg(p), 4).alias("confidence"))
    return out.select(key, "word_no", F.trim(F.array_join(F.transform("_t", lambda x: x["t"]), "")).alias("word"), "confidence").filter("word <> ''")
