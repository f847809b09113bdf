"""Model-backed steps as ports: column functions that a deployment replaces, each with an offline default.

The defaults are what the steps do when no model answers: deterministic, on the JVM, no network.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text, vectors
from docmill.operators.retrieval import lexical_overlap


def hashed_embedding(body: Column, size: int = 64) -> Column:
    """Unit vector of hashed word counts."""
    words = F.filter(F.split(F.lower(F.coalesce(body, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
    return vectors.unit(counts)


def undefined_label(body: Column) -> Column:
    return F.struct(F.lit("غير محدد").alias("label"), F.lit(0.0).alias("confidence"))


def whole_text(body: Column) -> Column:
    return F.array(F.struct(body.alias("bullet")))


def echo(*parts: Column) -> Column:
    return F.concat_ws("\n\n", *parts)


def same_query(query: Column) -> Column:
    return F.array(query)


def element_queries(element: Column) -> Column:
    return F.array(F.concat(F.lit("القانون المنظم لـ "), element), F.concat(F.lit("الوقائع المتعلقة بـ "), element))


@dataclass(frozen=True)
class Ports:
    """What a deployment may replace. Every port maps columns to a column."""

    embed: Callable[..., Column] = hashed_embedding
    relevance: Callable[..., Column] = lexical_overlap
    label: Callable[..., Column] = undefined_label
    extract: Callable[..., Column] = whole_text
    generate: Callable[..., Column] = echo
    decompose: Callable[..., Column] = same_query
    queries: Callable[..., Column] = element_queries
    on_topic: Callable[..., Column] = field(default=lambda q: F.trim(F.coalesce(q, F.lit(""))) != "")
    relevant: Callable[..., Column] = field(default=lambda q, d: F.lit(True))
    status: Callable[..., Column] = field(default=lambda e: F.lit("disputed"))
    severity: Callable[..., Column] = field(default=lambda a: F.lit("none"))


Tool = Callable[[DataFrame], DataFrame]


def run_tools(steps: DataFrame, tools: dict[str, Tool], known: list[str]) -> DataFrame:
    """step_id, tool, status, response: each tool sees its own steps; a step of an unknown tool fails with a message."""
    unknown = steps.filter(~F.coalesce(F.col("tool").isin(known), F.lit(False)))
    out = unknown.select("step_id", "tool", F.lit("failed").alias("status"), F.concat(F.lit("unknown tool: "), F.coalesce("tool", F.lit("?"))).alias("response"))
    for name in known:
        made = tools[name](steps.filter(F.col("tool") == name))
        out = out.unionByName(made.select("step_id", F.lit(name).alias("tool"), F.lit("success").alias("status"), "response"))
    return out


def classify(df: DataFrame, body: str, table: dict[str, list[str]], ports: Ports = Ports(), sure: int = 70, least: int = 30) -> DataFrame:
    """df with doc_type, confidence and method: keywords where they are sure, else the label port, else what keywords say."""
    scored = df.withColumn("_k", text.keyword_score(F.concat_ws("\n", text.header(F.col(body)), text.excerpt(F.col(body))), table))
    by_words = scored.filter(F.col("_k.confidence") >= sure).select(*df.columns, F.col("_k.doc_type").alias("doc_type"), F.col("_k.confidence").cast("int").alias("confidence"), F.lit("keywords").alias("method"))
    rest = scored.filter(F.col("_k.confidence") < sure).withColumn("_l", ports.label(F.col(body)))
    told = F.col("_l.confidence") > 0
    by_port = rest.select(
        *df.columns,
        F.when(told, F.col("_l.label")).otherwise(F.coalesce("_k.doc_type", F.lit("unknown"))).alias("doc_type"),
        F.when(told, (F.col("_l.confidence") * 100).cast("int")).otherwise(F.greatest(F.col("_k.confidence"), F.lit(least)).cast("int")).alias("confidence"),
        F.lit("port").alias("method"),
    )
    return by_words.unionByName(by_port)
