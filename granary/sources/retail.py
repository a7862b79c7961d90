"""Retail transactions: the raw schema, readers and writers, and a dirty relation derived from the star schema."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.sources.scratch import materialize

#: Columns of a raw transaction file, in order; all are text.
RAW_COLUMNS = ["Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country"]
CORRUPT = "_corrupt_record"


def raw_schema(with_corrupt: bool = False) -> T.StructType:
    names = [*RAW_COLUMNS, *([CORRUPT] if with_corrupt else [])]
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


@contextmanager
def _existing(uri: str) -> Iterator[None]:
    """Turns Spark's error for a path that doesn't exist into the one that Python users expect."""
    try:
        yield
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(uri) from e
        raise


def raw_uri(base: str, folder: str, name: str) -> str:
    """Where a raw file stands: ``base`` is a file system such as ``hdfs://host:port``, ``folder`` an absolute path on it."""
    return "/".join([base.rstrip("/"), folder.strip("/"), name])


def read_raw_csv(spark: SparkSession, path: str, with_corrupt: bool = False, header: bool = True, every_header: bool = False) -> DataFrame:
    """A raw CSV file (RFC 4180 quoting, UTF-8) with the fixed schema; a header that differs is an error, and so is a missing path.

    The header of the first file is looked at, with ``every_header`` that of each one when it is read. With ``with_corrupt``, rows of another number of fields keep their text in ``_corrupt_record``. Without ``header`` the files have none.
    """
    options = {"header": str(header).lower(), "encoding": "UTF-8", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    with _existing(path):
        found = spark.read.options(**options).csv(path).columns
    if header and found != RAW_COLUMNS:
        raise ValueError(f"unexpected header: {found}")
    if every_header:
        options |= {"enforceSchema": "false"}
    if with_corrupt:  # a pruned scan would not look at all fields
        options |= {"columnNameOfCorruptRecord": CORRUPT, "columnPruning": "false"}
    return spark.read.schema(raw_schema(with_corrupt)).options(**options).csv(path)


#: Blocks of files up to which their offsets are broadcast.
BROADCAST_BLOCKS = 100_000


def numbered(rows: DataFrame, number: str = "row", in_file: str = "row_in_file") -> DataFrame:
    """Rows of a table of files with their place in their file and in all files by path, both from 1, in the order in which they stand there.

    A task reads a block from its beginning, so within a block ids that rise with each row give the place. Blocks are counted, and two prefix sums, over the blocks of
    each file and over files, give what lies before each. Windows see a row for each block and each file, never the rows.
    """
    own = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    kept = materialize(own, "numbered")  # pins the ids
    blocks = kept.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first"))
    files = blocks.groupBy("_file").agg(F.sum("n").alias("n"))
    before_file = F.coalesce(F.sum("n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    before_block = F.coalesce(F.sum("n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.withColumn("in_file", before_block).join(files.select("_file", before_file.alias("in_all")), "_file")
    offsets = materialize(offsets.select("_file", "_block", "first", "in_file", "in_all"), "offsets")
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST_BLOCKS else offsets
    at = F.col("_id") - F.col("first") + F.col("in_file") + 1
    return kept.join(offsets, ["_file", "_block"]).select(*[F.col(f"`{c}`") for c in rows.columns], at.alias(in_file), (at + F.col("in_all")).alias(number))


def open_sheets(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Files of sheets as one relation, with a ``sheet`` column, and (sheet, rows, first, last) of each; the header of every file is checked."""
    return sheets_union({name: read_raw_csv(spark, path, every_header=True) for name, path in paths.items()})


def path_exists(spark: SparkSession, uri: str) -> bool:
    """Whether the path is there, as a file or as a folder, which may be empty."""
    try:
        with _existing(uri):
            spark.read.format("binaryFile").load(uri)
    except FileNotFoundError:
        return False
    return True


def is_folder(spark: SparkSession, uri: str) -> bool:
    """Whether the path is there as a folder."""
    return path_exists(spark, uri) and path_exists(spark, f"{uri.rstrip('/')}/.")


def delete(uri: str) -> None:
    """Remove a file, or a folder with all that is in it; ``uri`` is of a kind that pyarrow knows. A missing path is an error."""
    system, path = fs.FileSystem.from_uri(uri)
    kind = system.get_file_info(path).type
    if kind == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    system.delete_dir(path) if kind == fs.FileType.Directory else system.delete_file(path)


def list_files(spark: SparkSession, uri: str) -> DataFrame:
    """(path, length, modificationTime) of the files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri).select("path", "length", "modificationTime")


def read_parquet(spark: SparkSession, uri: str) -> DataFrame:
    """A Parquet table; a missing path is a ``FileNotFoundError``."""
    with _existing(uri):
        return spark.read.parquet(uri)


def described(df: DataFrame) -> DataFrame:
    """(position, column, type, nullable) of a table's columns."""
    rows = [(k, f.name, f.dataType.simpleString(), f.nullable) for k, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, nullable boolean")


def partitions(df: DataFrame) -> DataFrame:
    """(partition, rows) of the partitions that hold rows, as the table would be read now."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("rows"))


def write_parquet(df: DataFrame, uri: str, files: int | None = None) -> None:
    """Overwrite ``uri``; ``files`` bounds their number for small results, which shuffle for it, so that what makes them keeps all its tasks."""
    (df.repartition(files) if files else df).write.mode("overwrite").parquet(uri)


#: Bytes of a file that :func:`write_sized` aims at.
FILE_BYTES = 128 << 20


#: Files that each task's share must fill at least for :func:`write_sized` to cut rows where they lie.
CUT_FILES = 4


def _lengths(spark: SparkSession, uri: str) -> DataFrame:
    return list_files(spark, uri).where("path LIKE '%.parquet'").select("path", "length")


def write_sized(df: DataFrame, uri: str, file_bytes: int = FILE_BYTES) -> int:
    """Overwrite ``uri`` with Parquet files of some ``file_bytes`` each, between half and twice of it unless the whole is less; gives the number of files.

    Rows are written once as they come, so what makes them keeps all its tasks, and these files are measured: compressed sizes can't be told from rows or from what a shuffle
    carries. Where a task reads enough of them, it cuts its rows into files as they lie, and only what is left over at its end is dealt together with others' ends. Else, or if a
    file misses the range, all rows are dealt evenly over as many files as their bytes ask for. Dealt rows compress differently, so files that miss the range are dealt once more.
    """
    spark = df.sparkSession
    draft = materialize(df, "draft")
    facts = [F.coalesce(F.sum("length"), F.lit(0)), F.max("length"), F.min("length"), F.count(F.lit(1))]
    size = lambda path: _lengths(spark, path).agg(*facts).first()
    fits = lambda seen: seen[3] > 0 and seen[1] <= 2 * file_bytes and (seen[3] == 1 or 2 * seen[2] >= file_bytes)
    total = sum(size(path)[0] for path in {f.rsplit("/", 1)[0] for f in draft.inputFiles()})
    shares, rows = partitions(draft).agg(F.count(F.lit(1)), F.sum("rows")).first()
    if shares and total >= CUT_FILES * file_bytes * shares and _known_store(uri):
        _write_cut(draft, uri, file_bytes, max(1, rows * file_bytes // total))
        if fits(seen := size(uri)):
            return seen[3]
    for _ in range(2):
        files = max(1, round(total / file_bytes))
        draft.repartition(files).write.mode("overwrite").parquet(uri)
        total, most, least, _ = seen = size(uri)
        if fits(seen):
            break
    return files


def _known_store(uri: str) -> bool:
    """Whether single files can be deleted there, that is whether pyarrow knows the store."""
    try:
        fs.FileSystem.from_uri(uri)
    except (ValueError, OSError, NotImplementedError):
        return False
    return True


def _write_cut(draft: DataFrame, uri: str, file_bytes: int, file_rows: int) -> None:
    """Overwrite ``uri`` with files of ``file_rows`` rows; files of less than half of ``file_bytes``, tasks' ends, are read again and dealt into files of their own."""
    draft.write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(uri)
    found = _lengths(draft.sparkSession, uri)
    ends = {r["path"]: r["length"] for r in found.where(2 * F.col("length") < file_bytes).collect()}  # one for each task at most, unless sizes vary much
    if not ends:
        return
    if 2 * sum(ends.values()) < file_bytes:  # too little for a file: with the shortest of the others it is enough
        ends |= {r["path"]: r["length"] for r in found.where(2 * F.col("length") >= file_bytes).orderBy("length", "path").limit(1).collect()}
    files = max(1, round(sum(ends.values()) / file_bytes))
    draft.sparkSession.read.schema(draft.schema).parquet(*ends).repartition(files).write.mode("append").parquet(uri)
    for path in ends:
        delete(f"{uri.rstrip('/')}/{path.rsplit('/', 1)[1]}")


def write_csv(df: DataFrame, uri: str, files: int | None = None) -> None:
    (df.repartition(files) if files else df).write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(uri)


def write_json(df: DataFrame, uri: str, files: int | None = None) -> None:
    (df.repartition(files) if files else df).write.mode("overwrite").json(uri)


def sheets_union(sheets: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All sheets, with a ``sheet`` column, and (sheet, rows, first, last) of each. Columns must be the same in all."""
    columns = {tuple(df.columns) for df in sheets.values()}
    if len(columns) != 1:
        raise ValueError("the sheets have different columns")
    parts = [df.withColumn("sheet", F.lit(name)) for name, df in sheets.items()]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    facts = joined.groupBy("sheet").agg(F.count(F.lit(1)).alias("rows"), F.min("InvoiceDate").alias("first"), F.max("InvoiceDate").alias("last"))
    return joined, facts


#: Tables that the dirty relation is made from.
DIRTY_SOURCES = ["lineitem", "orders", "customer", "nation", "part"]


def fingerprint(spark: SparkSession, uris: list[str]) -> str:
    """Changes with the files below the paths: their names, lengths and times. No file is read."""
    files = spark.read.format("binaryFile").load(uris).select("path", "length", "modificationTime")
    return str(files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)"))).first())


def dirty_retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transactions made from lineitem, orders, customer, nation and part: text columns, with every fault the rules look for.

    All rows; exact copies of some; cancellations of some, on the next day. Which row gets which fault follows from its keys.
    """
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in DIRTY_SOURCES}
    joined = (
        t["lineitem"]
        .join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    )
    h = F.expr("7 * l_orderkey + 13 * l_partkey + 31 * l_suppkey + 3 * l_linenumber + cast(l_quantity AS bigint)")
    every = lambda n: F.col("h") % n == 0
    amount = F.col("l_quantity").cast("int").cast("string")
    day = lambda offset, time: F.concat(F.date_add(F.to_date("o_orderdate"), offset).cast("string"), F.lit(time))
    dirty = joined.withColumn("h", h).select(
        "h",
        F.concat(F.when(every(97), "A").otherwise(""), (100000 + F.col("l_orderkey")).cast("string")).alias("Invoice"),
        F.when(every(53), "POST").when(every(59), "M").otherwise(F.lpad(F.col("l_partkey").cast("string"), 5, "0")).alias("StockCode"),
        F.col("p_name").alias("Description"),
        F.when(every(101), "abc").when(every(89), F.concat(F.lit("-"), amount)).otherwise(amount).alias("Quantity"),
        F.when(every(103), "bad-date").when(every(211), F.lit(None)).otherwise(day(0, " 08:26:00")).alias("InvoiceDate"),
        F.when(every(79), "0").when(every(107), "-1.5").otherwise(F.col("p_retailprice").cast("decimal(12,2)").cast("string")).alias("Price"),
        F.when(every(11), F.lit(None)).when(every(113), "  ").otherwise((10000 + F.col("o_custkey")).cast("string")).alias("Customer ID"),
        F.col("n_name").alias("Country"),
        day(1, " 09:00:00").alias("next_day"),
    )
    changed = {"Invoice": F.concat(F.lit("C"), "Invoice"), "Quantity": F.concat(F.lit("-"), "Quantity"), "InvoiceDate": F.col("next_day")}
    own = F.struct(*[F.col(f"`{c}`") for c in RAW_COLUMNS])
    cancelled = F.struct(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in RAW_COLUMNS])
    is_cancelled = every(17) & ~every(97) & ~every(89) & ~every(101)
    rows = dirty.withColumn("rows", F.array_compact(F.array(own, F.when(every(23), own), F.when(is_cancelled, cancelled))))
    return rows.select(F.inline_outer("rows"))  # outer, as no array is empty and the other form would make each one twice
