"""Fan-out and fan-in: branches, tiers of agents, grading of what they found, postponed work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.tables import settled


def branches(df: DataFrame, questions: Column, keep: list[str]) -> DataFrame:
    """One row per different question, with its place and the columns in keep."""
    return df.select(*keep, F.posexplode(F.array_distinct(questions)).alias("branch", "question"))


def retry_set(targets: Column, succeeded: Column) -> Column:
    """Targets that have not succeeded yet, each once, in order."""
    return F.array_except(targets, F.coalesce(succeeded, F.array().cast("array<string>")))


def run_tiers(requests: DataFrame, tiers: list[dict[str, Callable[[DataFrame], DataFrame]]], key: str, agents: str) -> DataFrame:
    """key, agent, response, error of every agent asked for, tier after tier.

    An agent maps requests to (key, response, error). Those of one tier see the requests alone,
    those of later tiers also `earlier`, the responses of the tiers before. Names that no tier has
    give an error row.
    """
    known = [name for tier in tiers for name in tier]
    asked = requests.select(key, F.explode(F.array_distinct(agents)).alias("agent"))
    out = asked.filter(~F.col("agent").isin(known)).select(key, "agent", F.lit("").alias("response"), F.concat(F.lit("unknown agent: "), "agent").alias("error"))
    seen = requests
    for tier in tiers:
        got = None
        for name, run in tier.items():
            made = run(seen.filter(F.array_contains(agents, name))).select(key, F.lit(name).alias("agent"), "response", F.col("error").cast("string"))
            got = made if got is None else got.unionByName(made)
        got = settled(got)  # an agent answers once, whoever reads it
        out = out.unionByName(got)
        said = got.filter("error is null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("agent", "response"))).alias("earlier"))
        seen = requests.join(said, key, "left")
    return out


def graded(docs: DataFrame, relevant: Column, key: str) -> tuple[DataFrame, DataFrame]:
    """The relevant documents (an unknown grade counts as relevant), and key, proceed for every key."""
    told = docs.withColumn("_ok", F.coalesce(relevant, F.lit(True)))
    return told.filter("_ok").drop("_ok"), told.groupBy(key).agg(F.bool_or("_ok").alias("proceed"))


def postponed(events: DataFrame, key: str, ts: str, seq: str, seconds: int = 300) -> DataFrame:
    """Events after which nothing of the key happens for `seconds`, and when that is over."""
    w = Window.partitionBy(key).orderBy(ts, seq)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    quiet = F.coalesce(F.lead(at).over(w) - at > seconds * 1_000_000, F.lit(True))
    return events.withColumns({"quiet": quiet, "due": F.timestamp_micros(at + seconds * 1_000_000)}).filter("quiet").drop("quiet")
