"""Helpers shared by the corpus operators: scratch tables in the shared folder, folds, text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.ship import ship_code
from granary.functions.sift import with_maybe  # noqa: F401
from granary.sources.scratch import materialize, scratch_path, shared_dir  # noqa: F401

#: White space of the word rules, as a Java and RE2 character class.
SPACES = r"[\x20\x09-\x0D]+"


#: Rows in an Arrow batch: texts are long, and a worker holds a batch at a time.
BATCH_ROWS = 1_000


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the executors; also bounds the session's Arrow batches, whose default of ten thousand rows is meant for short ones."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    ship_code(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(k))


#: Rows of ids or hashes up to which a table is broadcast (some 10 MB); larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def broadcast_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if its counted rows stay within the bound. ``df`` should be cheap to count."""
    return F.broadcast(df) if df.count() <= rows else df


def text_digest(text: str | Column = "text") -> Column:
    """128 bits of a text, null as empty: with the id, what tells rows apart, also those with null or repeated ids."""
    return F.unhex(F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")))


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, digest): the whole row as one struct, so that its other columns' names cannot clash, beside its id and its text's digest.

    A join on the two carries each text once, in its row.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), text_digest(F.col(f"`{text_col}`")).alias("digest"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def without(rows: DataFrame, gone: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` (row, doc_id, digest) without those in ``gone`` (gone_id, gone_digest), which should be cheap to read.

    Small tables are broadcast. Of larger ones a filter is, and only rows that it lets through shuffle.
    """
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("digest") == F.col("gone_digest"))
    n = gone.count()
    if n <= broadcast_rows:
        return rows.join(F.broadcast(gone), same, "left_anti")
    tested = with_maybe(rows, F.xxhash64("doc_id", "digest"), gone, F.xxhash64("gone_id", "gone_digest"), n)
    return tested.where("NOT maybe").drop("maybe").unionByName(tested.where("maybe").drop("maybe").join(gone, same, "left_anti"))


#: Estimated bytes up to which keys with lists of longs are broadcast.
BROADCAST_BYTES = 16 << 20


def marked(rows: DataFrame, keys: DataFrame, listed: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` (doc_id, digest, ...) with the column ``listed`` of ``keys`` (key_id, key_digest, listed), a list of longs, where they agree, else nulls.

    ``keys`` should be cheap to read. As with :func:`without`, only rows that a filter lets through shuffle if the table is too large for a broadcast.
    """
    same = F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("digest") == F.col("key_digest"))
    n, longs = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(listed)), F.lit(0))).first()
    if 64 * n + 8 * longs <= broadcast_bytes:
        return rows.join(F.broadcast(keys), same, "left").drop("key_id", "key_digest")
    tested = with_maybe(rows, F.xxhash64("doc_id", "digest"), keys, F.xxhash64("key_id", "key_digest"), n)
    met = tested.where("maybe").join(keys, same, "left").drop("maybe", "key_id", "key_digest")
    return met.unionByName(tested.where("NOT maybe").drop("maybe"), allowMissingColumns=True)
