"""Exact deduplication by two-pass Bloom filtering, in DataFrame operations only.

Pass one builds a blocked counting Bloom filter as a table: every text's digest picks one block of eight
counters and two counters in it. The counters are plain sums, so each task sends at most one row for a
block however many copies it holds, and only blocks with a counter of two or more are kept. Pass two
tests each row against that table. A row whose two counters are not both at least two has no equal
anywhere and passes straight through; the others, the possibly repeated ones, shuffle as
(id, digest) pairs, never with their texts. The texts are read once.

The filter is broadcast when its counted rows stay within ``BROADCAST_ROWS``. Beyond that a bitmap of the blocks that it holds, of 32 MB
at most, is broadcast in its place: rows in other blocks pass straight through, and the rest shuffle to meet the filter's own rows.

Texts are equal when they agree after each run of white space is replaced by one space; equality is
decided by the SHA-256 of that form.

Edge cases: a null text counts as empty, and all empty texts are one group. Of rows that agree in text
and id exactly one stays. Null ids lose against others; a group of null ids only keeps one row, with a
null ``keep_id``. An empty table gives an empty result. Other columns are ignored, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import SPACES, materialize, with_maybe

#: Rows of the filter (a long and two small integers each) up to which it is broadcast: 16 MB at most.
BROADCAST_ROWS = 500_000
#: Counters in a block, and blocks for each row: the load that sets the share of false candidates.
SLOTS = 8
BLOCKS_PER_ROW = 2


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_sha256) of every row."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def with_slots(rows: DataFrame, blocks: int) -> DataFrame:
    """Add the block and the two different counters in it that the digest picks."""
    h = F.xxhash64("text_sha256")
    first = F.pmod(F.shiftrightunsigned(h, 40), F.lit(SLOTS)).cast("int")
    step = F.pmod(F.shiftrightunsigned(h, 50), F.lit(SLOTS - 1)).cast("int") + 1
    return rows.select("*", F.pmod(h, F.lit(blocks)).alias("block"), first.alias("slot_a"), F.pmod(first + step, F.lit(SLOTS)).alias("slot_b"))


def repeated_blocks(rows: DataFrame) -> DataFrame:
    """(block, hit): the counters, as bits of ``hit``, that two or more rows have raised."""
    raised = [F.sum(((F.col("slot_a") == i) | (F.col("slot_b") == i)).cast("int")).alias(f"n{i}") for i in range(SLOTS)]
    hit = sum((F.when(F.col(f"n{i}") > 1, 1 << i).otherwise(0) for i in range(SLOTS)), F.lit(0))
    return rows.groupBy("block").agg(*raised).select("block", hit.alias("hit")).where("hit > 0")


def with_hits(rows: DataFrame, bloom: DataFrame, broadcast_rows: int) -> DataFrame:
    """Add ``hit``, the repeated counters of each row's block; null if it has none. ``bloom`` should be cheap to read."""
    bloom, n = bloom.withColumnRenamed("block", "bloom_block"), bloom.count()
    same = F.col("block") == F.col("bloom_block")
    if n <= broadcast_rows:
        return rows.join(F.broadcast(bloom), same, "left")
    sifted = with_maybe(rows, F.xxhash64("block"), bloom, F.xxhash64("bloom_block"), n)
    met = sifted.where("maybe").drop("maybe").join(bloom, same, "left")
    return met.unionByName(sifted.where("NOT maybe").drop("maybe"), allowMissingColumns=True)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialize(fingerprints(docs, id_col, text_col), "exact-rows")
    blocks = max(1, BLOCKS_PER_ROW * rows.count())
    rows = with_slots(rows, blocks)
    bloom = materialize(repeated_blocks(rows), "exact-bloom")
    bits = F.expr("shiftleft(1, slot_a) | shiftleft(1, slot_b)")
    tested = with_hits(rows, bloom, broadcast_rows).withColumn("maybe", F.coalesce(F.col("hit").bitwiseAND(bits) == bits, F.lit(False)))
    alone = tested.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")

    # Copies under one id collapse before they shuffle; explode gives each its row back.
    # Both sides are written first, so that the join reads them alone and Spark can split a group that is large.
    maybe = materialize(tested.where("maybe").groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("copies")), "exact-maybe")
    groups = maybe.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = materialize(groups, "exact-groups").withColumnRenamed("text_sha256", "group_sha256")
    joined = maybe.join(groups, F.col("text_sha256") == F.col("group_sha256")).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    shared = joined.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
    return alone.unionByName(shared)
