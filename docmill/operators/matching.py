"""Matching names to records: fuzzy titles, scopes, ranks of parties."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from docmill.functions import text as T
from docmill.workers import ship

# Labels of the defending party, its documents, and what a brief says of a party without any.
DEFENDANT = "المدعى عليه"
FEMININE, FEMININE_MARK = "المدعى عليها", "عليها"
DEFENCES = ("مذكرة دفاع", "مذكرة رد")
NO_PARTY = ("المحكمة", "غير محدد", "النيابة", "خبير")
CLASSES = 32
DISCLAIMER, CORRECTION = "لم ترد مذكرة دفاع لهذا الطرف في الملف المقدم", "[تصحيح]"


@cache
def _similarity():
    """Matching blocks' share of two strings, which Spark has no function for."""

    @pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)])

    return ratio


def letters(text: Column, classes: int = CLASSES) -> Column:
    """How many of the text's letters are of each class (code point modulo `classes`)."""
    chars = F.transform(F.split(F.coalesce(text, F.lit("")), ""), lambda c: F.ascii(c) % classes)
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.size(F.filter(chars, lambda c: c == i)))


def could_match(asked: DataFrame, titles: DataFrame, case: str, asked_id: str, candidate: str, title: str, pos: str, least: float = 0.5) -> DataFrame:
    """Pairs of a candidate and a title of its case whose ratio may reach `least`, and the candidate's equal title alone if there is one.

    A ratio is at most twice the number of shared letters over both lengths. Every text is indexed once by its letters' counts;
    shared letters are then bounded by the sum of each class's smaller count, in one compiled expression for each pair.
    Titles that repeat in a case count once, at their first pos.
    """
    once = titles.filter(F.coalesce(title, F.lit("")) != "").groupBy(case, title).agg(F.min(pos).alias(pos))
    held = once.withColumn("_b", letters(F.col(title)))
    equal = once.join(asked.withColumn(title, F.col(candidate)), [case, title]).select(*asked.columns, title, pos)
    open_ones = asked.join(equal.select(asked_id), asked_id, "left_anti").withColumn("_a", letters(F.col(candidate)))
    pairs = open_ones.join(held, case)
    both = F.char_length(candidate) + F.char_length(title)
    shared = sum((F.least(F.get("_a", F.lit(i)), F.get("_b", F.lit(i))) for i in range(CLASSES)), F.lit(0))
    near = pairs.filter((2 * F.least(F.char_length(candidate), F.char_length(title)) >= least * both) & (2 * shared >= least * both))
    return near.select(*asked.columns, title, pos).unionByName(equal)


def fuzzy_titles(asked: DataFrame, titles: DataFrame, case: str, asked_id: str, candidate: str, title: str, pos: str, least: float = 0.5) -> DataFrame:
    """asked_id, title, ratio: each candidate's most similar title of its case, the first of equal ones, or null.

    Only the titles of the same case are compared, and of those Python sees the ones that could_match. Candidates that
    repeat in a case are compared once for all of them, so copies of either side make no more pairs.
    """
    ship(asked.sparkSession)
    said = asked.select(case, candidate).distinct().withColumn("_copies", F.struct(case, candidate))
    pairs = could_match(said, titles, case, "_copies", candidate, title, pos, least)
    differ = F.when(F.col(candidate) != F.col(title), F.col(candidate))
    scored = pairs.withColumn("ratio", F.when(F.col(candidate) == F.col(title), 1.0).otherwise(_similarity()(differ, F.col(title))))
    best = scored.groupBy(case, candidate).agg(F.max(F.struct("ratio", (-F.col(pos)).alias("p"), title)).alias("_b"))
    by_id = asked.join(best, [case, candidate]).groupBy(asked_id).agg(F.max("_b").alias("_b"))
    found = asked.select(asked_id).join(by_id, asked_id, "left")
    enough = F.col("_b.ratio") >= least
    return found.select(asked_id, F.when(enough, F.col(f"_b.{title}")).alias(title), F.when(enough, F.col("_b.ratio")).alias("ratio"))


def narrowed_scope(chapters: DataFrame, sections: DataFrame, query: str, least_chapter: float = 0.5, least_section: float = 0.5) -> DataFrame:
    """query, chapter_id, section_id: the best chapter if it is sure enough, and in it the best section likewise.

    chapters: query, chapter_id, score; sections: query, chapter_id, section_id, score. Smaller ids win ties.
    """
    top = chapters.groupBy(query).agg(F.max(F.struct("score", (-F.col("chapter_id")).alias("c"))).alias("_t"))
    chapter = top.select(query, F.when(F.col("_t.score") >= least_chapter, -F.col("_t.c")).alias("chapter_id"))
    inner = sections.join(chapter.filter("chapter_id is not null"), [query, "chapter_id"])
    best = inner.groupBy(query).agg(F.max(F.struct("score", (-F.col("section_id")).alias("s"))).alias("_s"))
    return chapter.join(best, query, "left").select(query, "chapter_id", F.when(F.col("_s.score") >= least_section, -F.col("_s.s")).alias("section_id"))


def defendant_ranks(chunks: DataFrame, case: str, doc_id: str, party: str, doc_type: str, pos: str) -> DataFrame:
    """chunks with the defendants of a case told apart by ordinals, where it has several defence documents.

    The first document that names a rank has it. The others, in order, take the ranks that are left,
    from the first on: the n-th of them the n-th number that nobody has.
    """
    defence = (F.col(party) == DEFENDANT) & F.col(doc_type).isin(*DEFENCES)
    docs = chunks.filter(defence).groupBy(case, doc_id).agg(F.min(pos).alias("_p")).withColumn("_r", T.detect_rank(F.col(doc_id)))
    listed = docs.groupBy(case).agg(F.array_sort(F.collect_list(F.struct("_p", F.col(doc_id).alias("d"), F.col("_r").alias("r")))).alias("_d")).filter(F.size("_d") > 1)
    first = lambda x, i: x["r"].isNotNull() & (F.array_position(F.transform("_d", lambda y: y["r"]), x["r"]) == i + 1)
    split = listed.withColumns({"_named": F.filter("_d", first), "_rest": F.filter("_d", lambda x, i: ~first(x, i))})
    free = F.array_except(F.sequence(F.lit(1), F.size("_d") + F.coalesce(F.array_max(F.transform("_named", lambda x: x["r"])), F.lit(0))), F.transform("_named", lambda x: x["r"]))
    given = split.withColumn("_free", free).select(
        case,
        F.explode(
            F.concat(
                F.transform("_named", lambda x: F.struct(x["d"].alias("d"), x["r"].alias("r"))),
                F.transform("_rest", lambda x, i: F.struct(x["d"].alias("d"), F.get("_free", i).alias("r"))),
            )
        ).alias("_x"),
    )
    woman = F.col("_x.d").contains(FEMININE_MARK)
    label = F.concat_ws(" ", F.when(woman, FEMININE).otherwise(DEFENDANT), T.ordinal(F.col("_x.r"), woman))
    named = given.select(case, F.col("_x.d").alias(doc_id), label.alias("_label"))
    told = chunks.join(named, [case, doc_id], "left")
    return told.withColumn(party, F.when(defence & F.col("_label").isNotNull(), F.col("_label")).otherwise(F.col(party))).drop("_label").select(*chunks.columns)


def absent_party_note(defences: Column, without: Column) -> Column:
    """The text, with a correction for each party without defence that it says 50 characters or more after."""
    told = lambda p: (F.instr(defences, p) > 0) & (F.char_length(defences) - F.instr(defences, p) - F.char_length(p) + 1 >= 50)
    wrong = F.filter(without, lambda p: ~F.array_contains(F.array(*[F.lit(x) for x in NO_PARTY]), p) & told(p))
    notes = F.array_join(F.transform(wrong, lambda p: F.concat(F.lit(f"\n{CORRECTION} "), p, F.lit(f": {DISCLAIMER}"))), "\n")
    return F.when((F.size(wrong) > 0) & ~defences.contains(DISCLAIMER), F.concat_ws("\n", defences, notes)).otherwise(defences)


def sourced_sentences(sentences: Column) -> Column:
    """The text of the sentences (text, sources) that have a source."""
    return F.array_join(F.transform(F.filter(sentences, lambda s: F.size(s["sources"]) > 0), lambda s: s["text"]), " ")
