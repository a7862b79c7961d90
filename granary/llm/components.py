"""Connected components over a table of links, by alternating large-star and small-star rounds.

Each round is two aggregations to the least neighbour and two joins back, so a hub's neighbours are never
gathered into one row or task: the minimum is combined map-side and the join is one that Spark splits where
it is skewed. Rounds grow with the logarithm of the input. Each one is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import materialize

MAX_ROUNDS = 60


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, least) with ``least`` the smallest of ``u`` and its neighbours ``v``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("least"))
    return edges.join(least, edges["u"] == F.col("k")).drop("k")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    others = edges.join(least.withColumnRenamed("u", "k"), edges["u"] == F.col("k")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    return others.unionByName(least.select("u", F.col("least").alias("v"))).where("u != v").distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], int(row[1] or 0)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): ``root`` is the least node that it reaches.

    Loops and repeated links do no harm; a node that is in no link is not in the result.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "components")
    before = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        edges = materialize(_small_star(_large_star(edges)), "components")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())
