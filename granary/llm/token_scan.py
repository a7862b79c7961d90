"""Token counts by a separator scan over flat, unindexed token files.

A token file is nothing but token ids, little-endian integers of two bytes (four for vocabularies of more than 65,536 entries), documents after one another, each followed
by the end-of-document id. Files are cut into blocks of ``BLOCK_TOKENS``; each task reads one block at a time and finds the separators
in it with one array comparison. A document may span blocks: each block reports how many tokens precede its first separator,
how many follow its last one, and how many separators it has. A prefix scan over these small block records, file by
file, gives each block the number of documents before it and the tokens that the open document brings along;
the blocks' inner counts then need no more than that.

Edge cases: an empty document is a separator alone and counts zero tokens. Tokens after the last separator of a file are a last document
without an end, and are counted. Empty files and an empty folder have no documents. A file that ends within an id is refused, and so is
a separator that doesn't fit the vocabulary's ids. Null texts count as empty; null and repeated ids keep their rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm import bpe, corpus_files
from granary.llm.common import materialize, scratch_path, ship_package

#: Tokens in a block; a task holds one block.
BLOCK_TOKENS = 4 << 20
#: Blocks that a task reads at most, one after another.
BLOCKS_PER_TASK = 64
SEPARATOR = 50256


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", separator: int = SEPARATOR, vocabulary: str | None = None) -> DataFrame:
    """Encode every text into flat token files, one for each partition of ``docs``.

    Returns the manifest (file, ordinal, doc_id), which tells which document stands where. It is not needed for the scan.
    Text that spells the separator is encoded as ordinary text, so that the id stays unique to document ends.
    """
    ship_package(docs.sparkSession)
    path = vocabulary or bpe.default_vocabulary()
    if separator > np.iinfo(bpe.id_type(path)).max:
        raise ValueError(f"the separator {separator} doesn't fit the vocabulary's ids")
    corpus_files.make_folder(folder)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, manifest, at = bpe.quick_codec(path), [], 0
        name = f"{folder}/tokens-{TaskContext.get().partitionId():06d}.bin"
        end = np.array([separator], own.dtype).tobytes()

        def parts() -> Iterator[bytes]:
            nonlocal at
            for batch in batches:
                columns = [pa.array([name] * batch.num_rows, pa.string()), pa.array(np.arange(at, at + batch.num_rows)), batch.column(0)]
                manifest.append(pa.RecordBatch.from_arrays(columns, ["file", "ordinal", "doc_id"]))
                at += batch.num_rows
                for text in batch.column(1):
                    yield own.encode(text.as_py(), specials=False).tobytes() + end

        corpus_files.write_file(name, parts())
        yield from manifest

    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return materialize(source.mapInArrow(run, f"file string, ordinal bigint, doc_id {id_type}"), "token-manifest")


def blocks_of(spark: SparkSession, folder: str, block_tokens: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """(file, block, offset, bytes): the blocks of the files in a folder."""
    sizes = corpus_files.file_sizes(folder)
    if any(size % width for _, size in sizes):
        raise ValueError("a token file ends within a token")
    files = spark.createDataFrame(sizes, "file string, size bigint")
    step = block_tokens * width
    cut = files.where("size > 0").select("file", "size", F.explode(F.expr(f"sequence(0L, (size - 1) div {step})")).alias("block"))
    return cut.select("file", "block", (F.col("block") * step).alias("offset"), F.least(F.lit(step).cast("long"), F.col("size") - F.col("block") * step).alias("bytes"))


def scan_token_files(spark: SparkSession, folder: str, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS, dtype: str = "<u2") -> DataFrame:
    """(file, ordinal, n_tokens): one row for each document in the folder's token files."""
    ship_package(spark)
    width = np.dtype(dtype).itemsize
    blocks = blocks_of(spark, folder, block_tokens, width)
    n = blocks.count()
    blocks = blocks.repartition(max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCKS_PER_TASK)))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = np.frombuffer(corpus_files.read_range(row["file"], row["offset"], row["bytes"]), dtype)
                ends = np.flatnonzero(tokens == separator)
                inner = np.diff(ends) - 1
                record = {
                    "file": row["file"], "block": row["block"], "separators": len(ends), "tokens": len(tokens),
                    "head": int(ends[0]) if len(ends) else len(tokens), "tail": len(tokens) - 1 - int(ends[-1]) if len(ends) else 0, "inner": inner,
                }
                yield pa.RecordBatch.from_pylist([record], schema)

    names = ["separators", "tokens", "head", "tail"]
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), *((n, pa.int64()) for n in names), ("inner", pa.list_(pa.int64()))])
    scanned = materialize(blocks.mapInArrow(scan, "file string, block bigint, separators bigint, tokens bigint, head bigint, tail bigint, inner array<bigint>"), "token-blocks")

    # Prefix scan over the block records, without the counts within the blocks. The document that is open at a block's
    # start brings along the tokens since the last separator before: all so far, less those up to that separator.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    records = scanned.drop("inner").withColumn("ordinal", F.coalesce(F.sum("separators").over(before), F.lit(0))).withColumn("run", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    closed = F.max(F.when(F.col("separators") > 0, F.col("run") + F.col("tokens") - F.col("tail"))).over(before)
    stitched = records.select(
        F.col("file").alias("f"), F.col("block").alias("b"), F.col("ordinal").alias("first"), (F.col("run") - F.coalesce(closed, F.lit(0))).alias("carried"),
        (F.max("block").over(Window.partitionBy("file")) == F.col("block")).alias("last"),
    )
    joined = scanned.join(stitched, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    none = F.array().cast("array<bigint>")
    some = F.col("separators") > 0
    opened = F.when(some, F.col("tail")).otherwise(F.col("carried") + F.col("head"))
    ended = F.when(some, F.concat(F.array(F.col("carried") + F.col("head")), F.col("inner"))).otherwise(none)
    counts = F.concat(ended, F.when(F.col("last") & (opened > 0), F.array(opened)).otherwise(none))
    listed = joined.select("file", "first", F.posexplode_outer(counts).alias("k", "n_tokens")).where("k IS NOT NULL")
    return listed.select("file", (F.col("first") + F.col("k")).alias("ordinal"), "n_tokens")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every document, by way of token files in the shared folder."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-files")
    manifest = write_token_files(docs, folder, id_col, text_col, vocabulary=vocabulary)
    scanned = scan_token_files(spark, folder, dtype=bpe.id_type(vocabulary or bpe.default_vocabulary()).str)
    return manifest.join(scanned, ["file", "ordinal"]).select("doc_id", "n_tokens")
