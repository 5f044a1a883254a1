"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges per task between the steps of a round.
ROWS = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): the smallest node reachable.

    Each step links neighbours to the least node around them: first those above a node, then
    those below. Minima merge before the shuffle; a node with very many edges is split by the
    engine's skew handling in the join that follows. The rounds grow with the logarithm of a
    component's diameter; each is cut from the last one's lineage.
    """
    edges = cut(edges.where("u <> v").selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct())
    state = _state(edges)
    while state[0]:
        tasks = max(1, state[0] // ROWS)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = both.where("v > u").join(least, "u").where("v <> m").selectExpr("v as u", "m as v").coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").selectExpr("v as u", "m as v")
        edges = cut(small.union(least.selectExpr("u", "m as v")).selectExpr("greatest(u, v) as u", "least(u, v) as v").where("u <> v").coalesce(tasks).distinct())
        state, before = _state(edges), state
        if state == before:
            break
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(edges.select("v", "v").distinct())
