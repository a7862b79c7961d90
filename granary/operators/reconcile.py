"""Comparing relations: bags of rows, keyed tables, and two sheets that overlap in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators import bags
from granary.sources.retail import RAW_COLUMNS
from granary.sources.scratch import materialize

#: Buckets of keys whose digests are compared.
BUCKETS = 1 << 16


def bag_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of each side, in both (with multiplicity), only in one, and copies within each; nulls are equal."""
    return _bag_facts(bags.sided(a, b, RAW_COLUMNS))


def _bag_facts(rows: DataFrame) -> DataFrame:
    least, more = F.least("l", "r"), lambda c: F.greatest(F.col(c) - 1, F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(
        total("l").alias("left_rows"), total("r").alias("right_rows"), total(least).alias("in_both"), total(F.col("l") - least).alias("left_only"), total(F.col("r") - least).alias("right_only"),
        total(more("l")).alias("left_excess"), total(more("r")).alias("right_excess"), F.count_if((F.col("l") > 0) & (F.col("r") > 0)).alias("distinct_in_both"),
    )


def by_sheet(rows: DataFrame, first: str, second: str, sheet: str, at: str) -> DataFrame:
    """Different rows of two sheets: how often each has them (l, r), whether they lie ``inside`` the time that both cover, and its ends (since, until).

    A row's time is part of it, so all of this is found on the different rows.
    """
    here = lambda name: F.when(F.col(sheet) == name, 1).otherwise(0)
    counted = bags.counted(rows, RAW_COLUMNS, {"l": here(first), "r": here(second)})
    bounds = counted.agg(F.max(F.when(F.col("l") > 0, F.col(at))).alias("until"), F.min(F.when(F.col("r") > 0, F.col(at))).alias("since"))
    inside = F.coalesce(F.col(at).between(F.col("since"), F.col("until")), F.lit(False))
    return counted.crossJoin(F.broadcast(bounds)).select("l", "r", inside.alias("inside"), "since", "until")  # one row


def sheet_overlap(rows: DataFrame, first: str, second: str, sheet: str = "sheet", at: str = "InvoiceDate") -> DataFrame:
    """Bag counts of two sheets within the time that both cover: from the second's first row to the first's last one."""
    return _bag_facts(by_sheet(rows, first, second, sheet, at).where("inside"))


def overlap_report(rows: DataFrame, first: str, second: str, sheet: str = "sheet", at: str = "InvoiceDate") -> DataFrame:
    """What two sheets have in common, as (metric, value): row counts, and how they agree within the time that both cover."""
    own = by_sheet(rows, first, second, sheet, at)
    within, excess = lambda c: F.when(F.col("inside"), c).otherwise(0), lambda c: F.greatest(c - 1, F.lit(0))
    a, b, both = F.col("l"), F.col("r"), F.least("l", "r")
    sums = {
        "first_rows": a, "second_rows": b, "first_within": within(a), "second_within": within(b), "within_both": within(both), "within_first_only": within(a - both),
        "within_second_only": within(b - both), "first_excess": excess(a), "second_excess": excess(b), "excess_without_first_within": excess(a - within(a) + b),
    }
    totals = own.agg(F.min("since").alias("since"), F.max("until").alias("until"), *[F.coalesce(F.sum(c), F.lit(0)).cast("string").alias(n) for n, c in sums.items()])
    names = ["since", "until", *sums]
    return totals.select(F.expr("stack({}, {}) AS (metric, value)".format(len(names), ", ".join(f"'{n}', {n}" for n in names))))


def bucket_digests(table: DataFrame, key: str, columns: list[str], buckets: int) -> DataFrame:
    """(bucket, n, total, parity): of the rows in each bucket of keys their number and an order-free digest, twice 64 bits; each task hands on a bucket once."""
    cells = [F.col(f"`{c}`") for c in (key, *columns)]
    one, two = F.xxhash64(*cells), F.xxhash64(F.lit(1), *cells)
    own = table.select(bucket_of(F.col(f"`{key}`"), buckets), one.cast("decimal(20,0)").alias("one"), two.alias("two"))
    return own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("one").alias("total"), F.bit_xor("two").alias("parity"))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def aligned(a: DataFrame, b: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``columns`` only, in the types that a union of them has, so that equal values have equal digests."""
    own = [df.select(*[F.col(f"`{c}`") for c in columns]) for df in (a, b)]
    kinds = own[0].union(own[1]).schema
    one, two = (df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kinds]) for df in own)
    return one, two


def keyed_changes(a: DataFrame, b: DataFrame, key: str, columns: list[str], tolerance: float = 0.0, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """What two tables with one row for each key don't agree in: ``(changes, same)``; nulls are equal.

    ``changes`` has a row for each key in a bucket that differs, and what it is: ``none``, ``only_left``, ``only_right`` or ``different`` (by more than ``tolerance``). ``same`` is one row with ``rows``, the number of rows
    in buckets that agree. Rows are put in buckets by their keys, and only digests of buckets are compared at first; rows of buckets whose digests agree move no further, so
    what shuffles grows with the differences, not with the tables. Both tables are read twice: give stored ones.
    A bucket that differs passes for equal only if its number of rows and 128 bits of hashes agree.
    """
    a, b = aligned(a, b, [key, *columns])
    x, y = (bucket_digests(df, key, columns, buckets).select("bucket", F.struct("n", "total", "parity").alias(side)) for df, side in ((a, "l"), (b, "r")))
    agree = F.coalesce(F.col("l").eqNullSafe(F.col("r")), F.lit(False))
    compared = materialize(x.join(y, "bucket", "full_outer").select("bucket", agree.alias("agree"), F.col("l.n").alias("n")), "buckets")
    apart = F.broadcast(compared.where("NOT agree").select("bucket"))  # an integer for each bucket at most
    named = lambda df, s: df.join(apart, bucket_of(F.col(f"`{key}`"), buckets) == F.col("bucket"), "left_semi").select(*[F.col(f"`{c}`").alias(f"{s}{i}") for i, c in enumerate((key, *columns))], F.lit(1).alias(s))
    joined = named(a, "l").join(named(b, "r"), F.col("l0").eqNullSafe(F.col("r0")), "full_outer")
    differ = F.lit(False)
    for i in range(1, len(columns) + 1):
        le, ri = F.col(f"l{i}"), F.col(f"r{i}")
        near = F.abs(le.cast("double") - ri.cast("double")) <= tolerance if tolerance else F.lit(False)
        differ = differ | ~(le.eqNullSafe(ri) | F.coalesce(near, F.lit(False)))
    change = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").when(differ, "different").otherwise("none")
    told = joined.select(F.when(F.col("l").isNull(), F.col("r0")).otherwise(F.col("l0")).alias(key), change.alias("change"))
    return told, compared.agg(F.coalesce(F.sum(F.when(F.col("agree"), F.col("n"))), F.lit(0)).alias("rows"))


def keyed_differences(a: DataFrame, b: DataFrame, key: str, columns: list[str], tolerance: float = 0.0, buckets: int = BUCKETS) -> DataFrame:
    """(rows, only_left, only_right, different) of two tables with one row for each key; as :func:`keyed_changes`, of which it is the count."""
    told, same = keyed_changes(a, b, key, columns, tolerance, buckets)
    kinds = ("only_left", "only_right", "different")
    counts = told.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("change") == k).alias(k) for k in kinds])
    return counts.crossJoin(F.broadcast(same)).select((F.col("n") + F.col("rows")).alias("rows"), *kinds)  # one row each
