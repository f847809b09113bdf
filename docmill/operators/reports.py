"""What is said at the end: briefs and reports from rows when no model writes them, and the texts that end a run.

A case's text is assembled from its own rows in one aggregation (parts are collected by place and joined), so cases
are independent of each other; a text is as long as what its case says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.operators import citations

# How raw texts are marked, what stands for missing parts, and headings.
RAW = "[ملخص خام - يحتاج مراجعة]\n"
NO_INFO = "لا تتوفر معلومات كافية"
NO_REQUESTS = "لا تتوفر معلومات كافية عن طلبات الخصوم"
NO_DEFENCES = "لا تتوفر معلومات كافية عن دفوع الخصوم"
NO_DOCUMENTS = "لا تتوفر معلومات كافية عن المستندات المقدمة"
UNKNOWN, FACTS, REQUESTS, DEFENCES, DOCUMENTS, LEGAL = "غير محدد", "الوقائع", "الطلبات", "الدفوع", "المستندات", "الأساس القانوني"
AGREED, DISPUTED, SPECIFIC = "النقاط المتفق عليها:", "النقاط المتنازع عليها:", "النقاط الخاصة بكل طرف:"
TITLE, ISSUES, FRAME, TRUST = "# تقرير التحليل القانوني\n", "## القسم الأول: المسائل القانونية المحددة", "\n## القسم الثاني: الإطار القانوني", "\n## القسم السابع: مستوى الثقة\n"
LEVELS = {"high": "مرتفع", "medium": "متوسط", "low": "منخفض"}
EMPTY_REPORT = "لم يتم استخراج مسائل قانونية من ملخص الدعوى."
NO_COUNTERARGUMENTS = "لم يتم إنشاء الحجج المقابلة."
NO_ANSWER = "تعذّر توليد الإجابة النهائية بسبب خطأ في النموذج."
MANY_ISSUES, RUNS = 8, 2
#: The parts of a brief, in order.
PARTS = ("dispute_summary", "uncontested_facts", "key_disputes", "party_requests", "party_defenses", "submitted_documents", "legal_questions")
#: How runs end without an answer, by name; {} stands for the reason.
ENDINGS = {
    "law_off_topic": "يبدو أن السؤال المطروح خارج نطاق اختصاص هذا النظام. يرجى طرح سؤال متعلق بالقانون أو الأحكام القانونية ذات الصلة.",
    "law_cannot_answer": "تعذر تقديم إجابة قانونية دقيقة على السؤال المطروح.\n\nالسبب:\n{}\n\nيرجى إعادة صياغة السؤال أو توضيح الوقائع بشكل أدق.",
    "documents_cannot_answer": "المستندات المتاحة لا تتضمن معلومة يمكن استخدامها للإجابة عن هذا السؤال. يرجى تحديد المستند أو النقطة القانونية المراد البحث فيها.",
    "documents_off_topic": "عذراً، لا يمكنني الإجابة على هذا السؤال لأنه خارج نطاق المستندات أو غير متعلق بالمسائل القانونية المرتبطة بالدعوى المدنية محل البحث.",
    "documents_error": "عذراً، واجه النظام مشكلة أثناء معالجة طلبك. يرجى المحاولة مرة أخرى أو التواصل مع الدعم الفني.",
    "empty_report": EMPTY_REPORT,
}
NO_REASON = "تعذر العثور على مواد قانونية مناسبة."


def ending(name: Column, reason: Column) -> Column:
    """The text that ends a run of that kind, null for kinds that don't exist; a missing reason has its own text."""
    said = F.coalesce(reason, F.lit(NO_REASON))
    out = F.lit(None).cast("string")
    for kind, text in ENDINGS.items():
        before, _, after = text.partition("{}")
        out = F.when(name == kind, F.concat(F.lit(before), said, F.lit(after)) if "{}" in text else F.lit(text)).otherwise(out)
    return out


def _said(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _joined(cond: Column, order: Column, text: Column, by: str) -> Column:
    """The texts of those rows in order, as an aggregate; empty without any."""
    rows = F.array_sort(F.collect_list(F.when(cond, F.struct(order.alias("o"), text.alias("t")))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), by)


def fallback_brief(themes: DataFrame, case: str, role: str, pos: str, summary: str, disputes: str) -> DataFrame:
    """case and the seven parts of its brief, from the summaries of its themes as they are.

    themes: one row for each theme, disputes an array. Roles come in the order of their first theme, themes in that of pos.
    """
    text, told = F.col(summary), F.coalesce(F.col(disputes), F.array().cast("array<string>"))
    listed = F.array_join(F.transform(told, lambda d: F.concat(F.lit("- "), d)), "\n")
    rows = themes.select(case, F.col(role).alias("_role"), F.col(pos).alias("_pos"), text.alias("_text"), listed.alias("_list"), (F.size(told) > 0).alias("_any"))
    first = rows.groupBy(case, "_role").agg(F.min(F.struct("_pos", "_text")).alias("_f")).withColumn("_s", F.split(F.coalesce("_f._text", F.lit("")), r"\.")[0])
    opening = first.filter(F.col("_role") != UNKNOWN).groupBy(case).agg(_joined(_said(F.col("_s")), F.col("_f._pos"), F.concat("_role", F.lit(": "), "_s", F.lit(".")), "\n").alias("_opening"))
    of = lambda r: (F.col("_role") == r) & _said(F.col("_text"))
    parts = rows.groupBy(case).agg(
        _joined(of(FACTS) & ~F.col("_any"), F.col("_pos"), F.col("_text"), "\n\n").alias("uncontested_facts"),
        _joined(F.col("_any"), F.col("_pos"), F.col("_list"), "\n").alias("key_disputes"),
        *[_joined(of(r), F.col("_pos"), F.col("_text"), "\n\n").alias(name) for r, name in ((REQUESTS, "party_requests"), (DEFENCES, "party_defenses"), (DOCUMENTS, "submitted_documents"))],
        *[F.count_if(F.col("_role") == r).alias(f"_n_{name}") for r, name in ((REQUESTS, "party_requests"), (DEFENCES, "party_defenses"), (DOCUMENTS, "submitted_documents"))],
        _joined((F.col("_role") == LEGAL) & F.col("_any"), F.col("_pos"), F.col("_list"), "\n").alias("_legal"),
    )
    raw = lambda c, default: F.when(_said(F.col(c)), F.concat(F.lit(RAW), F.col(c))).otherwise(default)
    absent = lambda name, default: F.when(F.col(f"_n_{name}") > 0, F.lit(NO_INFO)).otherwise(default)
    met = parts.join(opening, case, "left")
    return met.select(
        case,
        raw("_opening", F.lit(NO_INFO)).alias("dispute_summary"),
        raw("uncontested_facts", F.lit(NO_INFO)).alias("uncontested_facts"),
        raw("key_disputes", F.lit(NO_INFO)).alias("key_disputes"),
        *[raw(n, absent(n, d)).alias(n) for n, d in (("party_requests", NO_REQUESTS), ("party_defenses", NO_DEFENCES), ("submitted_documents", NO_DOCUMENTS))],
        F.coalesce(F.when(_said(F.col("_legal")), F.concat(F.lit(RAW), "_legal")), raw("key_disputes", F.lit(NO_INFO))).alias("legal_questions"),
    )


def raw_summary(items: DataFrame, key: str, kind: str, pos: str, text: str, party: str, positions: str, *also: Column) -> DataFrame:
    """key, summary: a theme's items as they are, agreed ones first, disputed ones with each party's bullets, then those of one party.

    positions: array of (party, bullets); text is the subject of a disputed item. also: more aggregates of the items, from the
    same grouping. Items that are dealt by the key already are grouped where they are.
    """
    sides = F.transform(F.coalesce(F.col(positions), F.array().cast(items.schema[positions].dataType)), lambda p: F.concat(F.lit("\n  * "), F.coalesce(p["party"], F.lit("")), F.lit(": "), F.array_join(p["bullets"], "; ")))
    said = F.coalesce(text, F.lit(""))
    kinds = (
        (AGREED, "agreed", F.concat(F.lit("- "), said)),
        (DISPUTED, "disputed", F.concat(F.lit("- "), said, F.array_join(sides, ""))),
        (SPECIFIC, "party_specific", F.concat(F.lit("- ["), F.coalesce(party, F.lit("")), F.lit("] "), said)),
    )
    made = items.groupBy(key).agg(*[_joined(F.col(kind) == k, F.col(pos), line, "\n").alias(f"_{k}") for _, k, line in kinds], *[F.count_if(F.col(kind) == k).alias(f"_n_{k}") for _, k, _ in kinds], *also)
    blocks = [F.when(F.col(f"_n_{k}") > 0, F.concat(F.lit(f"{head}\n"), f"_{k}")) for head, k, _ in kinds]
    return made.select(key, F.concat(F.lit(RAW), F.concat_ws("\n", *blocks)).alias("summary"), *[F.col(c) for c in made.columns[len(made.columns) - len(also) :]])


def fallback_report(cases: DataFrame, issues: DataFrame, applied: DataFrame, case: str) -> DataFrame:
    """case, report: issues, the articles that their elements cite, and the confidence; a case without issues has the empty report.

    cases: case, level, score; issues: case, issue_id, title; applied: case, issue_id, article (each once in the list, in order).
    """
    cited = applied.filter("article is not null").groupBy(case, "issue_id").agg(F.array_sort(F.collect_set("article")).alias("_a"))
    rows = issues.join(cited, [case, "issue_id"], "left")
    articles = F.concat(F.lit("["), F.array_join(F.coalesce(F.col("_a").cast("array<string>"), F.array().cast("array<string>")), ", "), F.lit("]"))
    every = F.lit(True)
    lines = rows.groupBy(case).agg(
        _joined(every, F.col("issue_id"), F.concat(F.lit("- ["), F.col("issue_id").cast("string"), F.lit("] "), F.coalesce("title", F.lit(""))), "\n").alias("_issues"),
        _joined(every, F.col("issue_id"), F.concat(F.lit("- مسألة "), F.col("issue_id").cast("string"), F.lit(": مواد "), articles), "\n").alias("_frame"),
    )
    level = F.coalesce(*[F.when(F.col("level") == k, v) for k, v in LEVELS.items()], F.lit(""))
    trust = F.concat(F.lit(TRUST), level, F.lit(" ("), F.format_string("%.2f", F.coalesce("score", F.lit(0.0))), F.lit(")"))
    whole = F.concat_ws("\n", F.lit(TITLE), F.lit(ISSUES), "_issues", F.lit(FRAME), "_frame", trust)
    return cases.join(lines, case, "left").select(case, F.when(F.col("_issues").isNull(), EMPTY_REPORT).otherwise(whole).alias("report"))


def issue_dispatch(cases: DataFrame, issues: DataFrame, case: str) -> DataFrame:
    """case, route, n_issues, warned: cases without issues go to the empty report, more issues than eight are warned of."""
    n = issues.groupBy(case).agg(F.count("*").alias("n_issues"))
    found = cases.select(case).join(n, case, "left").withColumn("n_issues", F.coalesce("n_issues", F.lit(0)))
    return found.select(case, F.when(F.col("n_issues") == 0, "generate_empty_report").otherwise("issue_analysis_branch").alias("route"), "n_issues", (F.col("n_issues") > MANY_ISSUES).alias("warned"))


def synthesis_route(sufficient: Column, runs: Column) -> Column:
    """After synthesis: an answer that is not enough is planned again while runs are left."""
    return F.when(F.coalesce(sufficient, F.lit(True)) | (F.coalesce(runs, F.lit(0)) >= RUNS), "trace_writer").otherwise("replanner")


def input_route(intent: Column) -> Column:
    return F.when(intent == "off_topic", "off_topic").otherwise("classify")


def after_dispatch_route(agents: Column, n_files: Column) -> Column:
    """Uploads are classified if an agent that needs them was asked."""
    needs = F.arrays_overlap(F.coalesce(agents, F.array().cast("array<string>")), F.array(F.lit("case_doc_rag"), F.lit("ocr")))
    return F.when((F.coalesce(n_files, F.lit(0)) > 0) & needs, "classify_document").otherwise("merge")


def after_classify_route(agents: Column, n_results: Column, statuses: Column) -> Column:
    """Nothing but scans was asked for, and no file could be classified: the fallback; else on to the merge."""
    scans = (F.array_contains(agents, "ocr") & ((F.size(agents) == 1) | (F.coalesce(n_results, F.lit(0)) == 0)))
    lost = (F.size(statuses) > 0) & F.forall(statuses, lambda s: s == "failed")
    return F.when(F.coalesce(scans & lost, F.lit(False)), "fallback").otherwise("merge")


def validation_route(status: Column, retries: Column, most: Column) -> Column:
    """pass, retry while retries are left, else fallback; no status is no pass."""
    none = F.coalesce(status, F.lit("")) == ""
    return F.when(status.isin("pass", "partial_pass"), "pass").when(none, "fallback").when(F.coalesce(retries, F.lit(0)) < most, "retry").otherwise("fallback")


def deduplicated_sources(results: DataFrame, key: str, pos: str, sources: str) -> DataFrame:
    """key, sources: those of all of a key's steps in order, blank ones left out, each once whatever its case, as said first."""
    each = results.select(key, F.col(pos).alias("_p"), F.posexplode(sources).alias("_i", "_s")).withColumn("_s", F.trim("_s")).filter("_s <> ''")
    once = each.groupBy(key, F.lower("_s").alias("_l")).agg(F.min(F.struct("_p", "_i", "_s")).alias("_f"))
    listed = once.groupBy(key).agg(F.array_sort(F.collect_list("_f")).alias("_f"))
    return listed.select(key, F.transform("_f", lambda f: f["_s"]).alias("sources"))


def coerced_tool(said: Column, tools: list[str]) -> Column:
    """The first tool that a near-miss name means: one is in the other, or they share their first six characters; else the name as it is."""
    plain = F.regexp_replace(F.lower(said), "[- ]", "_")
    near = [F.when(plain.contains(t) | F.contains(F.lit(t), plain) | plain.startswith(t[:6]) | F.startswith(F.lit(t), F.substring(plain, 1, 6)), t) for t in tools]
    return F.when(said.isin(tools), said).otherwise(F.coalesce(*near, said))


def scoped(told: DataFrame, toc: DataFrame, query: str) -> DataFrame:
    """query, chapter_id, chapter, section_id, section, level: what a table of contents has for the ids that a model told.

    toc: chapter_id, chapter, sections (array of (section_id, section)). An id that isn't there narrows nothing, and a section counts
    within its chapter only.
    """
    flat = toc.select("chapter_id", F.explode("sections").alias("_s")).select("chapter_id", "_s.section_id", "_s.section")
    found = told.select(query, "chapter_id", "section_id").join(toc.select("chapter_id", "chapter"), "chapter_id", "left")
    found = found.withColumn("chapter_id", F.when(F.col("chapter").isNotNull(), F.col("chapter_id"))).join(flat, ["chapter_id", "section_id"], "left")
    level = F.when(F.col("chapter").isNull(), "none").when(F.col("section").isNull(), "chapter").otherwise("section")
    return found.select(query, "chapter_id", "chapter", F.when(F.col("section").isNotNull(), F.col("section_id")).alias("section_id"), "section", level.alias("level"))


def reranked(pairs: DataFrame, relevance: Column | None, top: int, key: str, doc: str, score: str) -> tuple[DataFrame, DataFrame]:
    """What is kept of each key's documents, and its confidence (the mean of their first scores, three digits, 0 without any).

    Each document counts once, with its best score. The `top` by relevance stay, ties as they were before; without a
    relevance the first `top` by score.
    """
    named = pairs if relevance is None else pairs.withColumn("_r", relevance)
    columns = [c for c in named.columns if c not in (key, doc)]
    once = named.groupBy(key, doc).agg(F.max(F.struct(F.coalesce(score, F.lit(0.0)).alias("_best"), *columns)).alias("_d")).select(key, doc, "_d.*")
    order = [F.desc("_best"), F.col(doc)] if relevance is None else [F.desc_nulls_last("_r"), F.desc("_best"), F.col(doc)]
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("place") <= top)
    kept = placed.select(key, doc, F.col("_best").alias(score), "place")
    return kept, kept.groupBy(key).agg(F.round(F.avg(score), 3).alias("confidence"))


def citation_verdict(cited: DataFrame, available: DataFrame, elements: DataFrame, key: str, number: str) -> DataFrame:
    """key, total, verified, missing, unsupported (elements without an article, in order), passed.

    cited, available: key, number; elements: key, element_id, articles (array).
    """
    counts = citations.verified_counts(cited, available, key, number)
    bare = elements.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.coalesce(F.size("articles"), F.lit(0)) <= 0, F.col("element_id")))).alias("unsupported"))
    every = counts.select(key).unionByName(bare.select(key)).distinct().join(counts, key, "left").join(bare, key, "left")
    none = F.array()
    full = every.select(
        key,
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "verified")],
        F.coalesce("missing", none.cast(counts.schema["missing"].dataType)).alias("missing"),
        F.coalesce("unsupported", none.cast(bare.schema["unsupported"].dataType)).alias("unsupported"),
    )
    return full.withColumn("passed", (F.size("missing") == 0) & (F.size("unsupported") == 0))


def appended(branches: list[DataFrame], key: str, items: str) -> DataFrame:
    """key and the branches' lists one after another, in the order of the branches."""
    each = [b.select(key, F.lit(i).alias("_i"), F.coalesce(items, F.array().cast(b.schema[items].dataType)).alias(items)) for i, b in enumerate(branches)]
    every = each[0]
    for e in each[1:]:
        every = every.unionByName(e)
    listed = every.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", items))).alias("_l"))
    return listed.select(key, F.flatten(F.transform("_l", lambda x: x[items])).alias(items))


def repeated_keys(rows: DataFrame, unique: list[str]) -> DataFrame:
    """Keys that break a uniqueness rule, and how often they occur; rows with a null in the key break none."""
    return rows.na.drop(subset=unique).groupBy(*unique).agg(F.count("*").alias("n")).filter("n > 1")
