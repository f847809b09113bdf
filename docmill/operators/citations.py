"""Citations against what was retrieved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions import text
from docmill.tables import dealt


def check(answers: DataFrame, available: DataFrame, key: str, answer: str, number: str, pattern: str = text.ARTICLE) -> DataFrame:
    """key, cited, invalid, scrubbed answer and integrity; a citation is valid if it was retrieved for the key."""
    have = available.groupBy(key).agg(F.collect_set(number).alias("_have"))
    cited = answers.withColumn("cited", text.extract_ints(text.digits(F.col(answer)), pattern)).join(have, key, "left")
    wrong = F.array_except("cited", F.coalesce("_have", F.array().cast("array<int>")))
    out = cited.withColumn("invalid", wrong).drop("_have")
    return out.withColumns({"scrubbed": text.scrub_citations(F.col(answer), F.col("invalid")), "integrity": text.citation_integrity(F.col("cited"), F.col("invalid"))})


def unverified(cited: DataFrame, known: list[DataFrame], keys: list[str]) -> DataFrame:
    """Distinct citations that no known source has."""
    every = known[0].select(*keys)
    for k in known[1:]:
        every = every.unionByName(k.select(*keys))
    return cited.select(*keys).distinct().join(every, keys, "left_anti")


def verified_counts(cited: DataFrame, available: DataFrame, key: str, number: str, n_tasks: int | None = None) -> DataFrame:
    """key, total, verified and the missing numbers in order. n_tasks: how many tasks take the rows of both."""
    every = cited.select(key, number, F.lit(True).alias("_cited"), F.lit(False).alias("_ok"))
    have = available.select(key, number).filter(F.col(key).isNotNull() & F.col(number).isNotNull())
    both = dealt(every.unionByName(have.select(key, number, F.lit(False).alias("_cited"), F.lit(True).alias("_ok"))), n_tasks, key)
    each = both.groupBy(key, number).agg(F.bool_or("_cited").alias("_cited"), F.bool_or("_ok").alias("_ok")).filter("_cited")
    return each.groupBy(key).agg(
        F.count("*").alias("total"),
        F.count_if("_ok").alias("verified"),
        F.array_sort(F.collect_list(F.when(~F.col("_ok"), F.col(number)))).alias("missing"),
    )


def fabricated(summaries: DataFrame, inputs: DataFrame, key: str, summary: str, source: str) -> DataFrame:
    """key, number: numbers of a summary that none of the key's inputs has."""
    said = summaries.select(key, F.explode(text.numbers(F.col(summary))).alias("number")).distinct()
    seen = inputs.select(key, F.explode(text.numbers(F.col(source))).alias("number")).distinct()
    return said.join(seen, [key, "number"], "left_anti")
