"""Row-level checks and routers: each gives a verdict column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.text import ARABIC, script_ratio

# What a question may not contain, and which errors are worth another try.
INJECTIONS = (
    r"ignore\s+(previous|all|the)\s+instructions?",
    r"تجاهل\s+(التعليمات|الأوامر)",
    r"you\s+are\s+now\s+(a|an)",
    r"pretend\s+(you\s+are|to\s+be)",
    r"act\s+as\s+(a|an|if)",
    r"<\s*script",
    r"system\s*:\s*you",
)
TRANSIENT = ("429", "503", "rate limit", "quota exceeded", "unavailable", "deadline exceeded", "overloaded", "too many requests", "resource exhausted", "connection")
SERVICE_ERRORS = ("حدث خطأ", "تعذّر", "تعذر", "لم يتمكن", "خطأ في")
BIASED = ("نوصي", "يجب على المحكمة", "نرى أن", "نقترح", "ينبغي الحكم")
NOT_FOUND = (("case", "CASE_NOT_FOUND"), ("conversation", "CONVERSATION_NOT_FOUND"), ("file", "FILE_NOT_FOUND"), ("summary", "SUMMARY_NOT_FOUND"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column, words) -> Column:
    return any_of([text.contains(w) for w in words])


def query_fault(query: Column, script: str = ARABIC, least: int = 3, most: int = 2000, ratio: float = 0.3) -> Column:
    """Why a question is turned down (empty, too_short, too_long, wrong_script), or null."""
    text = F.trim(query)
    return (
        F.when(text.isNull() | (text == ""), "empty")
        .when(F.char_length(text) < least, "too_short")
        .when(F.char_length(text) > most, "too_long")
        .when(script_ratio(text, script) < ratio, "wrong_script")
    )


def input_fault(query: Column, most: int = 4000, patterns=INJECTIONS) -> Column:
    """empty, too_long, injection_<number of the first pattern found>, or null."""
    out = F.when(query.isNull() | (F.trim(query) == ""), "empty").when(F.char_length(query) > most, "too_long")
    for i, pattern in enumerate(patterns, 1):
        out = out.when(query.rlike(f"(?i){pattern}"), f"injection_{i}")
    return out


def fast_off_topic(query: Column, script: str = ARABIC, least: int = 5) -> Column:
    text = F.trim(F.coalesce(query, F.lit("")))
    return (F.char_length(text) < least) | ~text.rlike(script)


def mapped_label(label: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(*[F.when(F.lower(F.trim(label)) == k, v) for k, v in table.items()], F.lit(default))


def retrieval_grade(retries: Column, n_docs: Column, confidence: Column, most: int = 2, low: float = 0.35, high: float = 0.55) -> Column:
    return (
        F.when(retries >= most, "fail").when(n_docs == 0, "fail").when(confidence < low, "refine").when(confidence < high, "llm").otherwise("pass")
    )


def route(*cases: tuple[Column, str], default: str) -> Column:
    """The first case that holds, as every router here: (condition, target) pairs and a default."""
    return F.coalesce(*[F.when(c, t) for c, t in cases], F.lit(default))


def top_level_route(kind: Column) -> Column:
    return route((kind == "off_topic", "off_topic"), (kind == "textual", "textual"), default="scope")


def grader_route(grade: Column) -> Column:
    return route((grade == "pass", "generate"), (grade == "refine", "refine"), (grade == "llm", "llm_grader"), default="cannot_answer")


def topic_route(error: Column, on_topic: Column) -> Column:
    return route((error.isNotNull(), "error"), (on_topic, "on_topic"), default="off_topic")


def document_route(mode: Column, doc_id: Column) -> Column:
    return route(((mode == "whole_document") & doc_id.isNotNull(), "finalize"), default="retrieve")


def proceed_route(found: Column, rephrasings: Column, most: int = 2) -> Column:
    return route((found, "answer"), (rephrasings >= most, "cannot_answer"), default="refine")


def intent_route(intent: Column, agents: Column) -> Column:
    return route(((intent == "off_topic") | (F.size(agents) == 0), "off_topic"), default="dispatch")


def classify_fallback(errors: Column, agents: Column) -> Column:
    """All agents failed and only the scanner was asked."""
    every = F.forall(agents, lambda a: F.array_contains(errors, a))
    return route((every & (F.size(F.array_except(agents, F.array(F.lit("ocr")))) == 0), "fallback"), default="merge")


def agents_of(intent: Column, agents: Column, order: list[str]) -> Column:
    """Allowed agents once each, in a fixed order; one of them unless the intent is several."""
    known = F.transform(F.coalesce(agents, F.array().cast("array<string>")), lambda a: F.lower(F.trim(a)))
    sorted_ = F.filter(F.array(*[F.lit(a) for a in order]), lambda a: F.array_contains(known, a))
    return F.when(intent == "off_topic", F.array().cast("array<string>")).when(intent == "multi", sorted_).otherwise(F.slice(sorted_, 1, 1))


def intent_of(intent: Column, agents: Column) -> Column:
    return F.when((intent == "multi") & (F.size(agents) == 0), "off_topic").otherwise(intent)


def verdict(relevant: Column, complete: Column, grounded: Column, coherent: Column) -> Column:
    """partial_pass if only completeness fails; else the first failing check, incoherence counting as hallucination."""
    return (
        F.when(relevant & complete & grounded & coherent, "pass")
        .when(relevant & grounded & coherent, "partial_pass")
        .when(~grounded | ~coherent, "fail_hallucination")
        .when(~relevant, "fail_relevance")
        .otherwise("fail_completeness")
    )


def is_transient(message: Column, markers=TRANSIENT) -> Column:
    return contains_any(F.lower(F.coalesce(message, F.lit(""))), markers)


def service_error(answer: Column, from_cache: Column, prefixes=SERVICE_ERRORS) -> Column:
    return ~from_cache & any_of([answer.startswith(p) for p in prefixes])


def error_code(status: Column, detail: Column) -> Column:
    text = F.lower(F.coalesce(detail, F.lit("")))
    missing = F.coalesce(*[F.when(text.contains(w), c) for w, c in NOT_FOUND], F.lit("NOT_FOUND"))
    return (
        F.when(text.contains("not found"), missing)
        .when(text.contains("not allowed") | text.contains("mime"), "INVALID_MIME_TYPE")
        .when(text.contains("exceeds") | text.contains("too large"), "FILE_TOO_LARGE")
        .when(text.contains("no fields"), "NO_FIELDS_TO_UPDATE")
        .when(status.isin(400, 422), "VALIDATION_ERROR")
        .when(status == 401, "UNAUTHORIZED")
        .otherwise("INTERNAL_ERROR")
    )


def memory_gate(status: Column, query: Column, answer: Column) -> Column:
    said = lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""
    return status.isin("pass", "partial_pass") & said(query) & said(answer)


def brief_is_valid(sections: list[Column], biased=BIASED) -> Column:
    """Every section says something and none leans."""
    texts = F.array(*[F.coalesce(s, F.lit("")) for s in sections])
    return F.forall(texts, lambda s: F.trim(s) != "") & ~F.exists(texts, lambda s: contains_any(s, biased))


def upload_fault(mime: Column, size: Column, allowed: list[str], most: int) -> Column:
    return F.when(~F.coalesce(mime.isin(allowed), F.lit(False)), "INVALID_MIME_TYPE").when(size > most, "FILE_TOO_LARGE")


def tool_name(name: Column, tools: list[str], default: str) -> Column:
    """A tool that the name is, contains, is contained in, or shares six first letters with; the first in order."""
    plain = F.lower(F.trim(name))
    exact = [F.when(plain == t, t) for t in tools]
    near = [F.when(F.lit(t).contains(plain) | plain.contains(t) | (F.substring(plain, 1, 6) == t[:6]), t) for t in tools]
    return F.coalesce(*exact, *near, F.lit(default))
