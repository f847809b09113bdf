"""Whole flows: execution of plans with replanning, the branch of an issue, and the summary of a case.

All rows of all plans, issues or cases go through a flow together; the driver loops over rounds only
and sees whether rows are left, never the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.operators import reasoning, reports, steps as ST
from docmill.tables import settled

# Attempts of a step, replans of a plan, retries of a plan's validation.
ATTEMPTS, REPLANS, RETRIES = 2, 2, 3


def validator_route(valid: Column, retries: Column) -> Column:
    """After validation: execute, plan again, or replan when the retries are used up."""
    return F.when(valid, "executor").when(retries < RETRIES, "planner").otherwise("replanner")


def collector_route(done: Column, capped: Column, ready: Column) -> Column:
    """After a round: synthesize when all is done, replan after a step failed for good, else go on."""
    return F.when(done, "synthesizer").when(capped, "replanner").when(ready, "executor").otherwise("synthesizer")


def replanner_route(failed: Column) -> Column:
    return F.when(failed, "synthesizer").otherwise("plan_validator")


def execute(plan: DataFrame, run: Callable[[DataFrame], DataFrame], attempts: int = ATTEMPTS) -> DataFrame:
    """plan_id, step_id, status, response, tries of every step: waves of ready steps, all plans at once.

    plan: plan_id, step_id, depends_on (array) and what run needs. run maps ready steps to plan_id,
    step_id, ok, response. A step whose run fails is tried again in later rounds, `attempts` times
    in all; steps that depend on a failed one, or on each other, stay `blocked`. Rounds end when no
    step is ready, so there are at most attempts times as many as the longest chain has steps. A round moves the
    steps that are ready and counts down what waits for them; steps that have ended are not looked at again. A run that
    gives no row for a step counts as no try, and must give one some time.
    """
    keys = ["plan_id", "step_id"]
    whole = settled(plan)
    needs = settled(whole.select(*keys, F.explode("depends_on").alias("need")).distinct())
    n = needs.groupBy(*keys).agg(F.count("*").alias("open"))
    waiting = settled(whole.select(*keys).join(n, keys, "left").select(*keys, F.coalesce("open", F.lit(0)).alias("open"), F.lit(0).alias("tries")))
    ended = []
    while True:
        ready = waiting.filter("open = 0")
        if ready.isEmpty():
            break
        now = settled(whole.join(ready.select(*keys), keys, "left_semi"))
        ran = run(now).select(*keys, F.coalesce("ok", F.lit(False)).alias("ok"), F.col("response").alias("response"), F.lit(True).alias("ran"))
        after = ready.join(ran, keys, "left").select(*keys, "response", (F.col("tries") + F.when(F.col("ran"), 1).otherwise(0)).alias("tries"), F.coalesce("ok", F.lit(False)).alias("ok"))
        after = settled(after.withColumn("status", F.when(F.col("ok"), "success").when(F.col("tries") >= attempts, "failed").otherwise("pending")))
        ended.append(after.filter("status <> 'pending'").select(*keys, "status", "response", "tries"))
        met = needs.join(after.filter("ok").select("plan_id", F.col("step_id").alias("need")), ["plan_id", "need"], "left_semi").groupBy(*keys).agg(F.count("*").alias("met"))
        later = waiting.filter("open > 0").join(met, keys, "left").select(*keys, (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"), "tries")
        waiting = settled(later.unionByName(after.filter("status = 'pending'").select(*keys, F.lit(0).cast("long").alias("open"), "tries")))
    out = waiting.select(*keys, F.lit("blocked").alias("status"), F.lit(None).cast("string").alias("response"), "tries")
    for e in ended:
        out = out.unionByName(e)
    return out


def execute_with_replans(plan: DataFrame, run: Callable[[DataFrame], DataFrame], replan: Callable[[DataFrame], DataFrame], most: int = REPLANS, attempts: int = ATTEMPTS) -> DataFrame:
    """execute, and plans with failed steps once more as replan gives them, `most` times.

    replan maps the failed and blocked steps (rows of plan) to steps with new ids; what was done
    stays, the others' rows give way to the new steps'. A plan for which replan gives nothing
    keeps its failures. Adds `replans`, how often the step's plan had been replanned.
    """
    kept = settled(execute(plan, run, attempts).withColumn("replans", F.lit(0)))
    current = plan
    for turn in range(1, most + 1):
        lost = kept.filter("status <> 'success'").select("plan_id", "step_id")
        if lost.isEmpty():
            break
        fresh = settled(replan(current.join(lost, ["plan_id", "step_id"], "left_semi")))
        if fresh.isEmpty():
            break
        again = fresh.select("plan_id").distinct()
        stays = kept.filter("status = 'success'").unionByName(kept.filter("status <> 'success'").join(again, "plan_id", "left_anti"))
        kept = settled(stays.unionByName(execute(fresh, run, attempts).withColumn("replans", F.lit(turn))))
        current = fresh
    return kept


def issue_branches(issues: DataFrame, elements: DataFrame, citations: DataFrame, corpus: DataFrame, search: Callable[[DataFrame], DataFrame], conflicts: DataFrame, logic: DataFrame | None = None) -> DataFrame:
    """One row per issue: its elements by status, citations missing and admitted by a second search, conflict, score, level.

    issues: issue_id. elements: issue_id, element_id, status (null: disputed), covered. citations:
    issue_id, article. corpus: article. search maps missing articles to those that a second query
    finds. conflicts: issue_ids (array). logic: issue_id, passed, severity of the models' checks; an issue without one
    has passed. No branch sees another's rows; without issues there is no row.
    """
    told = elements.withColumn("status", F.coalesce("status", F.lit("disputed")))
    share = lambda cond: F.count(F.when(cond, 1))
    per = told.groupBy("issue_id").agg(
        F.count("*").alias("n_elements"),
        share(F.col("status") == "unsupported").alias("n_unsupported"),
        share(F.col("status") == "disputed").alias("n_disputed"),
        share(F.col("status") == "insufficient_evidence").alias("n_insufficient"),
        F.avg(F.col("covered").cast("double")).alias("coverage"),
    )
    cited = citations.select("issue_id", "article").distinct()
    missing = settled(cited.join(corpus.select("article").distinct(), "article", "left_anti"))
    admitted = search(missing.select("article").distinct()).select("article").distinct().withColumn("_found", F.lit(1))
    again = missing.join(admitted, "article", "left").groupBy("issue_id").agg(F.count("_found").alias("n_admitted"), F.count(F.when(F.col("_found").isNull(), 1)).alias("n_missing"))
    numbers = cited.groupBy("issue_id").agg(F.count("*").alias("n_citations"))
    rows = issues.select("issue_id").join(per, "issue_id", "left").join(numbers, "issue_id", "left").join(again, "issue_id", "left")
    counted = [c for c in rows.columns if c.startswith("n_")]
    rows = ST.in_conflict(rows.na.fill(0, counted), conflicts, "issue_id", "issue_ids")
    if logic is None:
        rows = rows.withColumn("severity", F.lit("none"))
    else:
        rows = ST.logical_check(rows, logic, "issue_id").withColumn("severity", F.when(F.col("passed"), "none").otherwise(F.col("severity")))
    scored = reasoning.confidence(rows, "issue_id")
    return rows.select("issue_id", *counted, "conflict").join(scored, "issue_id")


def summarise(chunks: DataFrame, roles: DataFrame, kinds: DataFrame, themes: DataFrame) -> DataFrame:
    """A case's bullets under role, theme and kind: case_id, role, theme, kind, doc_id, pos, bullet.

    chunks: case_id, doc_id, pos, party, text. roles (doc_id, pos, role), kinds (doc_id, pos, kind)
    and themes (doc_id, pos, theme) are what models told; each stage takes its default for what is
    missing: an unknown role, the chunk's text as bullet, one party's own, one theme named after the
    role. With one party all bullets are its own. Every chunk that is not blank is in the result
    exactly once; a brief is a rendering of these rows, and no row holds more than one bullet.
    """
    key = F.struct("doc_id", "pos")
    said = chunks.filter(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("key", key)
    keyed = lambda d, c: d.select(key.alias("key"), c)
    labelled = ST.answered(said, keyed(roles, "role"), "key", {"role": F.lit(ST.UNKNOWN)}).drop("answered")
    split = ST.split_kind(labelled, keyed(kinds, "kind"), "key").drop("answered")
    told = ST.answered(split, keyed(themes, "theme"), "key", {"theme": F.col("role")}).drop("answered")
    # what holds for a case or a role of it is put together first, so that texts move once for it
    parties = said.groupBy(F.struct("case_id").alias("case")).agg((F.count_distinct("party") > 1).alias("several"))  # a null case is a case
    group = F.struct("case_id", "role").alias("group")
    sizes = split.groupBy(group).agg(F.count("*").alias("n")).withColumn("case", F.struct("group.case_id")).join(parties, "case").drop("case")
    told = told.withColumn("group", group).join(sizes, "group").withColumn("kind", F.when(F.col("several"), F.col("kind")).otherwise("party_specific"))
    theme = F.when(F.col("n") < ST.LEAST_ITEMS_FOR_THEMES, F.col("role")).otherwise(F.col("theme"))
    return told.select("case_id", "role", theme.alias("theme"), "kind", "doc_id", "pos", F.col("text").alias("bullet"))


def brief(bullets: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """The case's brief from summarise's bullets: a summary for each theme (a model's, else its bullets as they are), and the seven parts from those.

    told: case_id, role, theme, summary, from a model. A bullet's party is the document that said it.
    """
    theme = F.struct("case_id", "role", "theme").alias("key")
    place = F.struct("doc_id", "pos")
    nobody = F.lit(None).cast("array<struct<party:string,bullets:array<string>>>")
    items = bullets.select(theme, "kind", place.alias("place"), "bullet", F.col("doc_id").cast("string").alias("said_by"), nobody.alias("positions"))
    disputed = F.array_sort(F.collect_list(F.when(F.col("kind") == "disputed", F.struct("place", "bullet"))))
    themes = reports.raw_summary(items, "key", "kind", "place", "bullet", "said_by", "positions", F.min("place").alias("place"), F.transform(disputed, lambda x: x["bullet"]).alias("disputes"))
    if told is not None:
        themes = ST.answered(themes.withColumnRenamed("summary", "_raw"), told.select(theme, "summary"), "key", {"summary": F.col("_raw")}, F.trim("summary") != "")
    rows = settled(themes.select(F.struct("key.case_id").alias("case"), "key.role", "place", "summary", "disputes"))  # read twice
    return reports.fallback_brief(rows, "case", "role", "place", "summary", "disputes").select("case.case_id", *reports.PARTS)
