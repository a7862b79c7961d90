"""Order statistics without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kth_largest(df: DataFrame, column: str, k: int, rounds: int = 12, bins: int = 2048) -> float | None:
    """The k-th largest value of a double column (nulls left out), by counting values in ever finer ranges.

    Each round is one aggregation to ``bins`` rows; it ends when the range holds one value only. ``k`` beyond the number
    of values gives the least one; no values give None.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    above = 0
    for _ in range(rounds):
        if low is None or low == high or (width := (high - low) / bins) <= 0:
            break
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        inside = df.where(F.col(column).between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for row in inside.orderBy(F.desc("bin")).collect():  # one row for each bin
            low, high = row["low"], row["high"]
            if above + row["n"] >= k:
                break
            above += row["n"]
    return low
