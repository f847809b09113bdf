"""Grouping, merging and rendering for multi-document summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def manifest(df: DataFrame, party: str, doc_type: str) -> DataFrame:
    """Each party's document types, sorted."""
    return df.groupBy(party).agg(F.array_sort(F.collect_set(doc_type)).alias("doc_types"))


def merge_ghosts(parties: DataFrame, party: str = "party") -> DataFrame:
    """A label that begins other labels gives its types to each of them and goes.

    Labels meet by the beginnings of each one, so the join is by equality.
    """
    ends = F.sequence(F.lit(1), F.char_length(party) - 1)
    begins = F.explode(F.transform(ends, lambda n: F.substring(F.col(party), F.lit(1), n)))
    longer = parties.filter(F.char_length(party) > 1).select(F.col(party), begins.alias("_base"))
    pairs = longer.join(parties.select(F.col(party).alias("_base"), F.col("doc_types").alias("_more")), "_base")
    given = pairs.groupBy(party).agg(F.flatten(F.collect_list("_more")).alias("_more"))
    kept = parties.join(pairs.select(F.col("_base").alias(party)).distinct(), party, "left_anti").join(given, party, "left")
    merged = F.array_sort(F.array_union("doc_types", F.coalesce("_more", F.array().cast("array<string>"))))
    return kept.select(party, merged.alias("doc_types"))


def without_types(df: DataFrame, party: str, doc_type: str, types: list[str], excluded: list[str] = ()) -> DataFrame:
    """Parties that have no document of the types."""
    seen = df.groupBy(party).agg(F.bool_or(F.col(doc_type).isin(types)).alias("_has"))
    return seen.filter(~F.col("_has") & ~F.col(party).isin(list(excluded))).select(party)


def several_parties(df: DataFrame, key: str, party: str) -> DataFrame:
    return df.groupBy(key).agg((F.count_distinct(party) > 1).alias("several"))


def roles(bullets: DataFrame, role: str, kind: str, party: str, pos: str, text: str) -> DataFrame:
    """Per role the texts that are agreed, disputed and of one party only; with one party all are the last."""
    listed = lambda k: F.transform(F.array_sort(F.collect_list(F.when(k, F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))), lambda x: x["t"])
    parties = bullets.groupBy(role).agg(F.count_distinct(party).alias("_n"))
    told = bullets.join(parties, role).withColumn("_kind", F.when(F.col("_n") < 2, "party_specific").otherwise(F.col(kind)))
    return told.groupBy(role).agg(*[listed(F.col("_kind") == k).alias(k) for k in ("agreed", "disputed", "party_specific")])


def inferred_party(df: DataFrame, key: str, party: str, declared: str) -> DataFrame:
    """The only party of a key's sources, else the declared one."""
    seen = df.groupBy(key).agg(F.collect_set(party).alias("_p"), F.min(declared).alias("_d"))
    return seen.select(key, F.when(F.size("_p") == 1, F.element_at("_p", 1)).otherwise(F.col("_d")).alias("party"))


def merge_themes(df: DataFrame, theme: str, ids: str, pos: str) -> DataFrame:
    """Ids of a theme over all batches, batch after batch."""
    parts = df.groupBy(theme).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(ids).alias("i")))).alias("_parts"))
    return parts.select(theme, F.array_distinct(F.flatten(F.transform("_parts", lambda x: x["i"]))).alias(ids))


def bullet_count(agreed: Column, disputed: Column, specific: Column) -> Column:
    return sum((F.coalesce(F.size(c), F.lit(0)) for c in (agreed, disputed, specific)), F.lit(0))


def resolve(ids: DataFrame, bullets: DataFrame, key: str, list_col: str, id_col: str, text: str) -> DataFrame:
    """Texts of listed ids in list order; unknown ids are dropped."""
    each = ids.select(key, F.posexplode(list_col).alias("_pos", id_col))
    found = each.join(bullets.select(id_col, text), id_col)
    listed = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", text))).alias("_t"))
    return listed.select(key, F.transform("_t", lambda x: x[text]).alias(f"{text}s"))


def with_fallback(chunks: DataFrame, extracted: DataFrame, id_col: str, bullet: str, text: str) -> DataFrame:
    """Extracted bullets of known chunks; a chunk without any gives its own text."""
    known = extracted.join(chunks.select(id_col), id_col).select(id_col, bullet, F.lit(False).alias("fallback"))
    missed = chunks.join(extracted.select(id_col).distinct(), id_col, "left_anti")
    return known.unionByName(missed.select(id_col, F.col(text).alias(bullet), F.lit(True).alias("fallback")))


def with_label(chunks: DataFrame, labels: DataFrame, id_col: str, label: str, default: str) -> DataFrame:
    return chunks.join(labels.select(id_col, label), id_col, "left").withColumn(label, F.coalesce(label, F.lit(default)))


def merged_answer(df: DataFrame, key: str, question: str, answer: str, found: str, pos: str, rule: str = "\n\n---\n\n") -> DataFrame:
    """One answer of several: those that found something, else all; a single one as it is, more under their questions."""
    some = df.groupBy(key).agg(F.bool_or(found).alias("_any"))
    used = df.join(some, key).filter(F.col(found) | ~F.col("_any"))
    rows = used.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(question).alias("q"), F.col(answer).alias("a")))).alias("_r"), F.first("_any").alias("found"))
    many = F.array_join(F.transform("_r", lambda r: F.concat(F.lit("**"), r["q"], F.lit("**\n"), r["a"])), rule)
    return rows.select(key, F.when(F.size("_r") == 1, F.get("_r", F.lit(0))["a"]).otherwise(many).alias("answer"), "found")


def merged_agents(df: DataFrame, key: str, agent: str, response: str, error: str, pos: str) -> DataFrame:
    """Responses under their agents' names, one alone as it is; which agents failed is told."""
    ok = F.col(error).isNull() & (F.trim(F.coalesce(F.col(response), F.lit(""))) != "")
    rows = df.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(ok, F.struct(F.col(pos).alias("p"), F.col(agent).alias("n"), F.col(response).alias("r"))))).alias("_r"),
        F.array_sort(F.collect_set(F.when(~ok, F.col(agent)))).alias("failed"),
    )
    many = F.array_join(F.transform("_r", lambda r: F.concat(F.lit("["), r["n"], F.lit("]\n"), r["r"])), "\n\n")
    return rows.select(key, F.when(F.size("_r") == 1, F.get("_r", F.lit(0))["r"]).otherwise(many).alias("merged"), "failed")


def report(df: DataFrame, key: str, title: str, body: str, pos: str) -> DataFrame:
    """Sections '## title\\nbody' in order; empty bodies are left out."""
    said = df.filter(F.trim(F.coalesce(F.col(body), F.lit(""))) != "")
    rows = said.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(title).alias("t"), F.col(body).alias("b")))).alias("_s"))
    return rows.select(key, F.array_join(F.transform("_s", lambda s: F.concat(F.lit("## "), s["t"], F.lit("\n"), s["b"])), "\n\n").alias("report"))
