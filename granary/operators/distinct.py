"""Numbers of different values by stored sketches that can be merged.

A sketch (HyperLogLog, built in) is kept for each group and column, say each month. Different values of any range of groups come from merging these few rows; the rows behind
them are not read again, and a new month adds its sketches beside the others. Nulls are not counted; a group without values counts none; values are hashed to 64 bits first,
so an empty text is a value like any other. Tasks hand on a sketch for each group, never the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two to this power is the number of registers of a sketch (a byte each), and standard errors within which an estimate is taken to be right.
LG_K, ERRORS = 14, 4.0


def error_bound(lg_k: int = LG_K, errors: float = ERRORS) -> float:
    """The relative error that an estimate is held to."""
    return errors * 1.04 / 2 ** (lg_k / 2)


def values(rows: DataFrame, group: Column, columns: dict[str, str]) -> DataFrame:
    """(part, what, value): the named columns of all rows, one below the other, as texts."""
    pairs = ", ".join(f"'{n}', CAST(`{c}` AS STRING)" for n, c in columns.items())
    return rows.select(group.alias("part"), F.expr(f"stack({len(columns)}, {pairs}) AS (what, value)"))


def sketches(rows: DataFrame, group: Column, columns: dict[str, str], lg_k: int = LG_K) -> DataFrame:
    """(part, what, sketch): a sketch for each group and named column. Store it to use it.

    A row goes into all of its group's sketches at once: with a key for each column there would be more keys than the built-in aggregation holds before it sorts all rows.
    """
    hashed = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c).cast("string")))
    wide = rows.select(group.alias("part"), *[hashed(c).alias(n) for n, c in columns.items()]).groupBy("part").agg(*[F.hll_sketch_agg(n, lg_k).alias(n) for n in columns])
    return wide.select("part", F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.col(n).alias("sketch")) for n in columns])).alias("s")).select("part", "s.*")


def merged(stored: DataFrame, group: Column) -> DataFrame:
    """(part, what, estimate) of coarser groups, from stored sketches alone; the group may be an expression over ``part``."""
    joined = stored.select(group.alias("part"), "what", "sketch").groupBy("part", "what").agg(F.hll_union_agg("sketch").alias("sketch"))
    return joined.select("part", "what", F.hll_sketch_estimate("sketch").alias("estimate"))


def exact(rows: DataFrame, group: Column, columns: dict[str, str]) -> DataFrame:
    """(part, what, n): the same counted exactly; values shuffle, once for each task."""
    return values(rows, group, columns).groupBy("part", "what", "value").agg(F.lit(1)).groupBy("part", "what").agg(F.count("value").alias("n"))


def held_to_bound(estimates: DataFrame, counts: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """(part, what, n, within): exact counts, and whether the estimates lie within the bound of them."""
    named = estimates.select(F.col("part").alias("p"), F.col("what").alias("w"), "estimate")
    within = F.abs(F.col("estimate") - F.col("n")) <= F.greatest(F.lit(0.5), error_bound(lg_k) * F.col("n"))
    joined = counts.join(named, F.col("part").eqNullSafe(F.col("p")) & (F.col("what") == F.col("w")), "left")
    return joined.select("part", "what", "n", F.coalesce(within, F.lit(False)).alias("within"))
