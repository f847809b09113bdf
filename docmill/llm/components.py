"""Connected components of a graph of longs, by repeated contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import checkpoint


def _ends(pointers: DataFrame) -> DataFrame:
    """(u, to) with every pointer followed to its end; all that is pointed at has a pointer too."""
    while True:
        onward = pointers.select(F.col("u").alias("to"), F.col("to").alias("next"))
        jumped = checkpoint(pointers.join(onward.hint("merge"), "to").select("u", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        if jumped.filter("moved").isEmpty():
            return jumped.select("u", "to")
        pointers = jumped.select("u", "to")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of edges (u, v).

    Each round points every node at its smallest neighbour (or itself), follows the pointers to
    their ends by doubling, and contracts the edges, so that the nodes that still have an edge at
    least halve in number, and a chain takes as many steps as its length's logarithm. The pointers
    of all rounds are then followed. Every step is written to the shared folder. The minimum is
    taken before the shuffle, so a node with very many edges is no hot key there, and the joins
    are plain equi-joins that Spark can split where one key is hot. They are merge joins: turned
    into broadcasts where sides are small, those of many rounds would add up in the driver.
    """
    both = edges.select("u", "v").filter("u <> v")
    left = checkpoint(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        best = _ends(checkpoint(left.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to"))))
        rounds.append(best)
        to_u, to_v = best.select("u", F.col("to").alias("a")), best.select(F.col("u").alias("v"), F.col("to").alias("b"))
        moved = left.join(to_u.hint("merge"), "u").join(to_v.hint("merge"), "v").filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
        left = checkpoint(moved.distinct())
    if not rounds:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = rounds[0].select(F.col("u").alias("node"), F.col("to").alias("component"))
    for step in rounds[1:]:
        onward = step.select(F.col("u").alias("component"), "to")
        found = found.join(onward.hint("merge"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return found
