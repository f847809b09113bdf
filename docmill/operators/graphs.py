"""Dependencies of many plans at once: waves of steps, and steps that wait for each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.tables import settled


def peeled(steps: DataFrame, step: str, deps: str) -> DataFrame:
    """step, wave of every step of any number of plans at once; wave is null for steps that can never run.

    step is unique over all plans (a step given twice is one, with the needs of both). Round by round the steps without an
    open need (the frontier) leave with the number of the round, and their dependents' open needs are counted down by
    the edges that end in the frontier. What is left when no frontier is hangs on a cycle or on a step that is not there.
    A round moves the frontier and what is left, not what has gone.
    """
    edges = settled(steps.select(F.col(step).alias("_s"), F.explode_outer(deps).alias("_d")).distinct())
    needs = edges.filter("_d is not null")
    left = settled(edges.groupBy("_s").agg(F.count("_d").alias("_open")))
    waves, wave = [], 0
    while True:
        frontier = left.filter("_open = 0")
        if frontier.isEmpty():
            break
        wave += 1
        waves.append(frontier.select(F.col("_s").alias(step), F.lit(wave).alias("wave")))
        met = needs.join(frontier.select(F.col("_s").alias("_d")), "_d", "left_semi").groupBy("_s").agg(F.count("*").alias("_met"))
        waiting = left.filter("_open > 0").join(met, "_s", "left")
        left = settled(waiting.select("_s", (F.col("_open") - F.coalesce("_met", F.lit(0))).alias("_open")))
    out = left.select(F.col("_s").alias(step), F.lit(None).cast("int").alias("wave"))
    for w in waves:
        out = out.unionByName(w)
    return out


def looped(steps: DataFrame, step: str, deps: str) -> DataFrame:
    """The steps on a cycle, or between two cycles. Needs that are not there make no cycle.

    Round by round those edges go whose needed step needs nothing (or is not there), and those whose step nothing needs, so a
    chain goes from both ends at once. A round moves the edges that are left, not the steps, and not what has gone.
    """
    left = settled(steps.select(F.col(step).alias("_s"), F.explode(deps).alias("_d")).distinct())
    n = left.count()
    while n:
        needing, needed = left.select(F.col("_s").alias("_d")).distinct(), left.select(F.col("_d").alias("_s")).distinct()
        left = settled(left.join(needing, "_d", "left_semi").join(needed, "_s", "left_semi"))
        before, n = n, left.count()
        if n == before:
            break
    return left.select(F.col("_s").alias(step)).distinct()
