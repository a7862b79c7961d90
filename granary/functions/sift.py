"""Telling rows that can't meet a key from the others without a shuffle of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter for each key that it holds, and bits of a filter at most (32 MB).
KEY_BITS, MOST_BITS = 16, 1 << 28
_WORD = 1 << 15  # bits of one bitmap of Spark's


def with_maybe(rows: DataFrame, hash_of: Column, keys: DataFrame, key_hash: Column, n: int) -> DataFrame:
    """Add ``maybe``: false only for rows whose hash none of the ``n`` keys has. A Bloom filter of bounded size is broadcast; no row shuffles.

    The keys shuffle once, as places in the filter, so that no task makes bitmaps of the whole filter.
    """
    bits = min(MOST_BITS, max(_WORD, n * KEY_BITS))
    place = lambda h: F.pmod(h, F.lit(bits))
    at = keys.select(place(key_hash).alias("p")).select(F.expr(f"p div {_WORD}").alias("filter_word"), (F.col("p") % _WORD).alias("bit"))
    words = at.repartition("filter_word").groupBy("filter_word").agg(F.bitmap_construct_agg("bit").alias("filter_bits"))
    own = rows.withColumn("filter_place", place(hash_of))
    tested = own.join(F.broadcast(words), F.expr(f"filter_place div {_WORD}") == F.col("filter_word"), "left")
    octet = F.conv(F.hex(F.expr(f"substring(filter_bits, cast((filter_place % {_WORD}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    maybe = F.coalesce(octet.bitwiseAND(F.expr("shiftleft(1, cast(filter_place % 8 as int))")) != 0, F.lit(False))
    return tested.withColumn("maybe", maybe).drop("filter_place", "filter_word", "filter_bits")
