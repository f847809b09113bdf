"""Model-backed steps over tables: what a model answered, or the step's default where it did not.

A step takes the rows that were asked and the rows that came back (key and fields; a missing row, a
null field, or a row that is not sound counts as a failure), and gives one row per asked row. The
join is by key, so how answers come about (a port's columns, a service's table) is left open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import matching, ranking, reports

# The label of what is not known, kinds of questions, and limits of the steps.
UNKNOWN = "غير محدد"
LEAST_ITEMS_FOR_THEMES, PRIOR_CHARACTERS, MOST_CALLS, DUMP = 6, 1500, 5, 3000


def answered(asked: DataFrame, answers: DataFrame, key: str, defaults: dict[str, Column], sound: Column | None = None, needed: list[str] | None = None) -> DataFrame:
    """asked with the fields of defaults from its answer, and `answered`; the defaults where there is none.

    An answer counts if all its fields are there (those in `needed`, if that is given; the others may be null) and it is
    sound (a column over the answers). Of several answers the smallest counts, field by field.
    """
    good = answers.filter(sound) if sound is not None else answers
    kept = good.na.drop(subset=list(defaults) if needed is None else needed).groupBy(key).agg(F.min(F.struct(*defaults)).alias("_a"))
    both = asked.join(kept, key, "left")
    told = F.col("_a").isNotNull()
    fields = {c: F.when(told, F.col(f"_a.{c}")).otherwise(value) for c, value in defaults.items()}
    return both.withColumns(fields | {"answered": told}).drop("_a")


def rewritten_query(asked: DataFrame, answers: DataFrame, key: str, query: str) -> DataFrame:
    """The law question rewritten and classified; else normalised and `analytical`."""
    return answered(asked, answers, key, {"rewritten": T.normalize(F.col(query)), "kind": F.lit("analytical")})


def scope_level(chapter: Column, section: Column) -> Column:
    """How far a search is narrowed: without a chapter not at all, without a section to the chapter."""
    return F.when(chapter.isNull(), "none").when(section.isNull(), "chapter").otherwise("section")


def expanded(asked: DataFrame, answers: DataFrame, key: str, query: str) -> DataFrame:
    """Queries to search with: the expansions, else the query alone."""
    return answered(asked, answers, key, {"queries": F.array(query)}, F.size("queries") > 0)


def graded(asked: DataFrame, answers: DataFrame, key: str, why: str = "no grade") -> DataFrame:
    """Whether what was retrieved answers the question; without a grade it does not."""
    return answered(asked, answers, key, {"passed": F.lit(False), "reason": F.lit(why)})


def refined(asked: DataFrame, answers: DataFrame, key: str, query: str, count: str = "retry_count") -> DataFrame:
    """The query refined, else as it is; the count goes up either way."""
    told = answered(asked, answers, key, {"refined": F.col(query)}, F.trim("refined") != "")
    return told.withColumn(count, F.col(count) + 1)


def within_budget(calls: Column, most: int = MOST_CALLS) -> Column:
    """Whether another model call is allowed."""
    return F.coalesce(calls, F.lit(0)) < most


def cited_answer(asked: DataFrame, answers: DataFrame, key: str, n_docs: str, calls: str, message: str) -> DataFrame:
    """The answer; the message without documents or budget."""
    able = (F.col(n_docs) > 0) & within_budget(F.col(calls))
    told = answered(asked, answers, key, {"answer": F.lit(message)})
    return told.withColumns({"answer": F.when(able, F.col("answer")).otherwise(F.lit(message)), "answered": F.col("answered") & able})


def sub_questions(asked: DataFrame, answers: DataFrame, key: str, query: str) -> DataFrame:
    """Sub-questions, else the query alone; a blank query has none, and an error."""
    told = answered(asked, answers, key, {"questions": F.array(query)}, F.size("questions") > 0)
    blank = F.trim(F.coalesce(query, F.lit(""))) == ""
    none = F.array().cast("array<string>")
    return told.withColumns({"questions": F.when(blank, none).otherwise(F.col("questions")), "error": F.when(blank, F.lit("empty query"))})


def topic_gate(asked: DataFrame, answers: DataFrame, key: str, questions: str) -> DataFrame:
    """Without a verdict a question is on topic; without questions it is off topic."""
    told = answered(asked, answers, key, {"on_topic": F.lit(True)})
    return told.withColumn("on_topic", F.col("on_topic") & (F.size(questions) > 0))


def document_intent(asked: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """How a question names its document, and which one; a way without a document is an answer too."""
    return answered(asked, answers, key, {"intent": F.lit("no_doc_specified"), "document_id": F.lit(None).cast("string")}, needed=["intent"])


def repaired_titles(told: DataFrame, titles: DataFrame, case: str, key: str, pos: str = "pos") -> DataFrame:
    """document_intent's rows with document_id put right: the case's title that is most like it, or the name as it is if none is.

    titles: case, document_id, pos.
    """
    named = told.filter("document_id is not null").select(case, key, F.col("document_id").alias("_said"))
    known = titles.select(case, F.col("document_id").alias("_title"), pos)
    found = matching.fuzzy_titles(named, known, case, key, "_said", "_title", pos).select(key, "_title")
    return told.join(found, key, "left").withColumn("document_id", F.coalesce("_title", "document_id")).drop("_title")


def branch_answer(asked: DataFrame, answers: DataFrame, key: str, missing: str, error: str) -> DataFrame:
    """A branch's answer; `found` says that it lacks the marker of nothing found. A failed one is the error text."""
    told = answered(asked, answers, key, {"answer": F.lit(error)})
    return told.withColumn("found", F.col("answered") & ~F.contains("answer", F.lit(missing)))


def intake(asked: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Document type and party of a header; both unknown where nothing is told."""
    return answered(asked, answers, key, {"doc_type": F.lit(UNKNOWN), "party": F.lit(UNKNOWN)})


def role_of_chunk(asked: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Role and confidence: a failed batch gives 0.0, an id that an answered batch left out 1.0 (column `batch`)."""
    told = answered(asked, answers, key, {"role": F.lit(UNKNOWN), "confidence": F.lit(0.0)})
    some = told.groupBy("batch").agg(F.bool_or("answered").alias("_some"))
    lost = ~F.col("answered") & F.col("_some")
    return told.join(some, "batch").withColumn("confidence", F.when(lost, 1.0).otherwise(F.col("confidence"))).drop("_some")


def split_kind(asked: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Agreed, disputed or of one party: the last where nothing is told."""
    return answered(asked, answers, key, {"kind": F.lit("party_specific")}, F.col("kind").isin("agreed", "disputed", "party_specific"))


def themes(items: DataFrame, answers: DataFrame, key: str, role: str) -> DataFrame:
    """Each item's theme; roles of fewer than six items, and items without one, have the role's name as theme."""
    told = answered(items, answers, key, {"theme": F.col(role)})
    same = F.struct(role)  # a role that is null is a role
    sizes = items.groupBy(same.alias("_role")).agg(F.count("*").alias("_n"))
    few = F.col("_n") < LEAST_ITEMS_FOR_THEMES
    return told.withColumn("_role", same).join(sizes, "_role").withColumn("theme", F.when(few, F.col(role)).otherwise(F.col("theme"))).drop("_n", "_role")


def intent(asked: DataFrame, answers: DataFrame, key: str, intents: list[str]) -> DataFrame:
    told = answered(asked, answers, key, {"intent": F.lit("off_topic")}, F.col("intent").isin(intents))
    return told.withColumn("error", F.when(~F.col("answered"), F.lit("classification_error")))


def rolling_summary(asked: DataFrame, answers: DataFrame, key: str, summary: str, counter: str) -> DataFrame:
    """A new summary resets the counter; without one both stay."""
    told = answered(asked, answers, key, {"_new": F.col(summary)})
    return told.withColumns({summary: F.col("_new"), counter: F.when(F.col("answered"), F.lit(0)).otherwise(F.col(counter))}).drop("_new")


def with_priors(query: Column, responses: Column) -> Column:
    """A step's query with what came before it, so many characters of each."""
    said = F.transform(responses, lambda r: F.substring(r, 1, PRIOR_CHARACTERS))
    return F.when(F.size(responses) > 0, F.concat_ws("\n\n", query, F.array_join(said, "\n\n"))).otherwise(query)


def issues(asked: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Issues of the first attempt, else of the second, else none."""
    once = answered(asked, first, key, {"issues": F.array().cast("array<string>")}, F.size("issues") > 0)
    again = second.withColumnRenamed("issues", "_second")
    out = answered(once.drop("answered"), again, key, {"_second": F.array().cast("array<string>")})
    return out.withColumn("issues", F.when(F.size("issues") > 0, F.col("issues")).otherwise(F.col("_second"))).drop("_second", "answered")


def elements_of(asked: DataFrame, answers: DataFrame, key: str, title: str) -> DataFrame:
    """An issue's elements (element_id, description, kind); else one, E0, its title, a legal one."""
    one = F.array(F.struct(F.lit("E0").alias("element_id"), F.col(title).alias("description"), F.lit("legal").alias("kind")))
    told = answered(asked, answers, key, {"elements": one}, F.size("elements") > 0)
    return told.select(key, F.explode("elements").alias("_e")).select(key, "_e.*")


def logical_check(asked: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    return answered(asked, answers, key, {"passed": F.lit(True), "severity": F.lit("none")})


def conflicts(issues_: DataFrame, answers: DataFrame, case: str) -> DataFrame:
    """Conflicts between issues of cases that have two at least; none otherwise."""
    several = issues_.groupBy(case).agg(F.count("*").alias("_n")).filter("_n > 1").select(case)
    return answers.join(several, case, "left_semi")


def in_conflict(issues_: DataFrame, conflicts_: DataFrame, issue: str, members: str) -> DataFrame:
    """Issues with `conflict`: whether any conflict names them."""
    named = conflicts_.select(F.explode(members).alias(issue)).distinct().withColumn("_c", F.lit(True))
    return issues_.join(named, issue, "left").withColumn("conflict", F.coalesce("_c", F.lit(False))).drop("_c")


def placeholder(asked: DataFrame, answers: DataFrame, key: str, field: str, message: str) -> DataFrame:
    """Prose (a reconciliation, a justification, an application, a brief) or the message that stands for it."""
    return answered(asked, answers, key, {field: F.lit(message)}, F.trim(field) != "")


def counterarguments(asked: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """What either side may answer, and an analysis; empty lists and a fixed text where nothing is told."""
    none = F.array().cast("array<string>")
    return answered(asked, answers, key, {"plaintiff_arguments": none, "defendant_arguments": none, "analysis": F.lit(reports.NO_COUNTERARGUMENTS)})


def dependencies(issues_: DataFrame, answers: DataFrame, case: str, issue: str) -> DataFrame:
    """case, upstream, downstream, dependency_type of what was told, each once, between two different issues of the case; none where nothing is told."""
    known = issues_.select(case, issue).distinct()
    both = answers.filter("upstream <> downstream").join(known.withColumnRenamed(issue, "upstream"), [case, "upstream"], "left_semi")
    met = both.join(known.withColumnRenamed(issue, "downstream"), [case, "downstream"], "left_semi")
    return met.groupBy(case, "upstream", "downstream").agg(F.min("dependency_type").alias("dependency_type"))


def planned(asked: DataFrame, answers: DataFrame, key: str, tools: list[str], error: str = "no plan") -> DataFrame:
    """plan: the steps told (step_id, tool, query, depends_on), near-miss tools put right; else none, which fails validation, and feedback."""
    kind = answers.schema["plan"].dataType.simpleString()
    told = answered(asked, answers, key, {"plan": F.array().cast(kind)})
    put_right = F.transform("plan", lambda s: F.struct(s["step_id"].alias("step_id"), reports.coerced_tool(s["tool"], tools).alias("tool"), s["query"].alias("query"), s["depends_on"].alias("depends_on")))
    return told.withColumns({"plan": put_right, "feedback": F.when(~F.col("answered"), F.lit(f"فشل LLM المخطط: {error}"))})


def synthesized(asked: DataFrame, answers: DataFrame, results: DataFrame, key: str, pos: str) -> DataFrame:
    """The final answer and whether it is enough; an apology that counts as success where nothing is told. Sources are those of all
    steps, each once; attempts go up, and runs when the answer is not enough and runs are left. route says what follows.

    asked: key, attempts, runs; answers: key, answer, sufficient; results: key, pos, sources.
    """
    told = answered(asked, answers, key, {"answer": F.lit(reports.NO_ANSWER), "sufficient": F.lit(True)})
    told = told.join(reports.deduplicated_sources(results, key, pos, "sources"), key, "left")
    again = ~F.col("sufficient") & (F.col("runs") < reports.RUNS)
    out = told.withColumns({"sources": F.coalesce("sources", F.array().cast("array<string>")), "attempts": F.col("attempts") + 1, "route": reports.synthesis_route(F.col("sufficient"), F.col("runs"))})
    return out.withColumns({"runs": F.col("runs") + F.when(again, 1).otherwise(0), "status": F.when(~F.col("answered"), "succeeded")})


def learned_facts(facts: DataFrame, extracted: DataFrame, user: str, name: str, value: str, order: str) -> DataFrame:
    """Facts and preferences after an extraction: of each user and name the newest that says something; an extraction that failed
    (null or blank values) changes nothing."""
    said = extracted.filter(F.trim(F.coalesce(value, F.lit(""))) != "")
    return facts.unionByName(said.select(*facts.columns)).groupBy(user, name).agg(F.max_by(F.struct(value, order), F.struct(order, value)).alias("_f")).select(user, name, "_f.*")


def event_log(df: DataFrame, event: str, level: str, *fields: str) -> DataFrame:
    """One JSON line per row: event, level and the fields that are not null."""
    return df.select(F.to_json(F.struct(F.lit(event).alias("event"), F.lit(level).alias("level"), *fields)).alias("value"))


def dumped(value: Column, most: int = DUMP, marker: str = "...") -> Column:
    """JSON of a value, cut with a marker where it is longer."""
    raw = F.to_json(value)
    return F.when(F.char_length(raw) > most, F.concat(F.substring(raw, 1, most), F.lit(marker))).otherwise(raw)


def as_map(value: Column) -> Column:
    """A JSON object as map; an empty one for anything else."""
    return F.coalesce(F.from_json(value, "map<string,string>"), F.create_map().cast("map<string,string>"))


def without_keys(value: Column, *names: str) -> Column:
    return F.map_filter(value, lambda k, _: ~k.isin(*names))


def session_id(case: Column, at: Column) -> Column:
    return F.concat(case.cast("string"), F.lit("::"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))


def healthy(parts: DataFrame, ok: str) -> DataFrame:
    """One row: whether every part is."""
    return parts.agg(F.coalesce(F.bool_and(ok), F.lit(False)).alias("healthy"))


def routing_accuracy(df: DataFrame, said: str, meant: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg((F.col(said) == F.col(meant)).cast("double")).alias("accuracy"))


def gathered(ranked: DataFrame, docs: DataFrame, key: str, pos: str) -> DataFrame:
    """Rows that a reranker named by their place (key, indices, scores), in its order: key, rank, score and the row."""
    each = ranked.select(key, F.posexplode(F.arrays_zip("indices", "scores")).alias("rank", "_r")).select(key, "rank", F.col("_r.indices").alias(pos), F.col("_r.scores").alias("score"))
    return each.join(docs, [key, pos])


def with_related(users: DataFrame, related: DataFrame, key: str, name: str) -> DataFrame:
    """Users with the number of their permissions or audit rows (name), none counting as 0."""
    n = related.groupBy(key).agg(F.count("*").alias(name))
    return users.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def stored_report(asked: DataFrame, reports: DataFrame, key: str, body: str) -> DataFrame:
    """A case's stored report as a tool's result: status success, or skipped where there is none."""
    found = asked.join(reports.select(key, body), key, "left")
    return found.withColumn("status", F.when(F.col(body).isNull(), "skipped").otherwise("success"))


def themed(items: DataFrame, assigned: DataFrame, role: str, item: str) -> DataFrame:
    """Items under their themes: role, theme, kind, place in the theme, item. Unknown ids are dropped."""
    found = assigned.join(items, [role, item])
    return ranking.places(found, [role, "theme", "kind"], [F.col(item)], "place")
