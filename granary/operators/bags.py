"""Bags of rows, compared by digests first.

Rows get a 64-bit digest of their columns. Only the digests shuffle, to find those that occur again; a row whose digest occurs once equals
no other row and passes straight through. Rows whose digests meet are fetched and compared in full, so a digest that two different rows
share costs time and changes nothing. Nulls are equal. Rows are read three times: give stored ones, or such as follow from stored ones row by row.

The digests that occur again are broadcast up to ``BROADCAST_DIGESTS`` of them; beyond that a filter of them is, of 32 MB at most, and the rows that it
lets through are grouped in full: those with such a digest and a few others, which come out as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.sift import with_maybe
from granary.sources.scratch import materialize

#: Digests (8 bytes each) up to which they are broadcast.
BROADCAST_DIGESTS = 1_000_000
#: Copies that one task makes of a row at once.
COPIES = 4096


def quoted(columns: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def counted(rows: DataFrame, columns: list[str], counts: dict[str, Column], broadcast_digests: int | None = None) -> DataFrame:
    """One row for each different row of ``columns``, with the sums of ``counts`` (named, whole numbers)."""
    bound = BROADCAST_DIGESTS if broadcast_digests is None else broadcast_digests
    own = quoted(columns)
    digest = F.xxhash64(*own).alias("digest")
    again = materialize(rows.select(digest).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "met")
    kept = rows.select(*own, digest, *[c.cast("long").alias(n) for n, c in counts.items()])
    sums = [F.sum(n).alias(n) for n in counts]
    n = again.count()
    if n > bound:
        marked = with_maybe(kept, F.col("digest"), again, F.col("digest"), n).withColumnRenamed("maybe", "met")
    else:
        marked = kept.join(F.broadcast(again.withColumn("met", F.lit(True))), "digest", "left").withColumn("met", F.coalesce("met", F.lit(False)))
    return marked.where("NOT met").select(*own, *counts).unionByName(marked.where("met").groupBy(*own).agg(*sums))


def sided(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Different rows of two relations with how often each has them: l and r."""
    both = a.select(*quoted(columns), F.lit(1).alias("left")).unionByName(b.select(*quoted(columns), F.lit(0).alias("left")))
    return counted(both, columns, {"l": F.col("left"), "r": 1 - F.col("left")})


def repeated(rows: DataFrame, times: Column) -> DataFrame:
    """Each row as often as ``times`` says; not at all below one."""
    n, blocks = F.col("__times"), F.col("__block")
    dealt = rows.withColumn("__times", times.cast("long")).where(n > 0).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / COPIES))))
    size = F.least(F.lit(COPIES), n - blocks * COPIES).cast("int")
    return dealt.withColumn("__copy", F.explode(F.sequence(F.lit(1), size))).drop("__times", "__block", "__copy")


def intersect_all(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that both have, as often as both have them."""
    return repeated(sided(a, b, columns), F.least("l", "r")).select(*quoted(columns))


def except_all(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``a`` without as many copies as ``b`` has."""
    return repeated(sided(a, b, columns), F.col("l") - F.col("r")).select(*quoted(columns))
