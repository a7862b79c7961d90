"""Profiles of raw transactions: each a single aggregation, nothing is removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import ranks
from granary.functions.typed import blank, price, quantity, timestamp
from granary.operators import bags
from granary.sources.retail import CORRUPT, RAW_COLUMNS
from granary.sources.scratch import materialize

#: Texts that stand for a missing value.
PLACEHOLDERS = ["nan", "NaN", "None", "NULL", "null", "N/A"]
#: Quantiles of the numeric profile.
POINTS = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}


def raw(name: str) -> Column:
    return F.col(f"`{name}`")


def size(df: DataFrame) -> DataFrame:
    """(records, columns, corrupt): corrupt rows are known if they were kept when the table was read; their column isn't one of the table's."""
    corrupt = F.count_if(F.col(CORRUPT).isNotNull()) if CORRUPT in df.columns else F.lit(0).cast("long")
    return df.agg(F.count(F.lit(1)).alias("records"), F.lit(len([c for c in df.columns if c != CORRUPT])).alias("columns"), corrupt.alias("corrupt"))


def missingness(df: DataFrame) -> DataFrame:
    """(column, nulls, blanks, placeholders, pct_null) of each raw column."""
    cells = df.select(F.expr("stack({}, {}) AS (column, value)".format(len(RAW_COLUMNS), ", ".join(f"'{c}', `{c}`" for c in RAW_COLUMNS))))
    counts = cells.groupBy("column").agg(F.count_if(F.col("value").isNull()).alias("nulls"), F.count_if(blank(F.col("value"))).alias("blanks"), F.count_if(F.col("value").isin(PLACEHOLDERS)).alias("placeholders"), F.count(F.lit(1)).alias("n"))
    return counts.select("column", "nulls", "blanks", "placeholders", F.round(100 * F.col("nulls") / F.col("n"), 2).alias("pct_null"))


def unparseable(df: DataFrame) -> DataFrame:
    """Values that are there but do not parse, of three columns."""
    parsed = {"Quantity": quantity, "Price": price, "InvoiceDate": timestamp}
    return df.agg(*[F.count_if(raw(c).isNotNull() & f(raw(c)).isNull()).alias(c) for c, f in parsed.items()])


def copies(df: DataFrame) -> DataFrame:
    return bags.counted(df, RAW_COLUMNS, {"n": F.lit(1)})


def duplicates(df: DataFrame) -> DataFrame:
    """Groups of equal rows, rows in them, rows in excess, most copies, distinct rows, and the excess in percent."""
    more = F.when(F.col("n") > 1, F.col("n"))
    facts = copies(df).agg(F.count(more).alias("groups"), F.coalesce(F.sum(more), F.lit(0)).alias("rows_in_groups"), F.sum(F.col("n") - 1).alias("excess"), F.max(more).alias("max_copies"), F.count(F.lit(1)).alias("distinct_rows"))
    return facts.select("*", F.round(100 * F.col("excess") / (F.col("excess") + F.col("distinct_rows")), 2).alias("pct_excess"))


def duplicates_by_month(df: DataFrame) -> DataFrame:
    return copies(df).where("n > 1").groupBy(F.substring("InvoiceDate", 1, 7).alias("month")).agg(F.sum(F.col("n") - 1).alias("excess"))


def cardinality(df: DataFrame) -> DataFrame:
    """Distinct values of five columns, from one scan: each task hands on a value once."""
    names = {"customers": "Customer ID", "invoices": "Invoice", "countries": "Country", "stock_codes": "StockCode", "descriptions": "Description"}
    cells = df.select(F.expr("stack({}, {}) AS (what, value)".format(len(names), ", ".join(f"'{n}', `{c}`" for n, c in names.items()))))
    return cells.groupBy("what", "value").agg(F.lit(1)).groupBy("what").agg(F.count("value").alias("n"))


def numeric_stats(df: DataFrame) -> DataFrame:
    """(column, min, max, mean, exact quantiles) of quantity and price."""
    parsed = df.select(quantity(raw("Quantity")).alias("q"), price(raw("Price")).alias("p"))
    tall = parsed.select(F.expr("stack(2, 'Quantity', CAST(q AS DOUBLE), 'Price', CAST(p AS DOUBLE)) AS (column, value)"))
    few = materialize(tall.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), "numeric-values")  # each different value once: the rows are read and parsed once
    known = F.sum(F.when(F.col("value").isNotNull(), F.col("n")))
    stats = few.groupBy("column").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.try_divide(F.sum(F.col("value") * F.col("n")), known), 4).alias("mean"))
    points = ranks.quantiles(few, ["column"], F.col("value"), POINTS, copies=F.col("n"))  # a row for each column
    return stats.join(F.broadcast(points), "column", "left").select("column", "min", "max", "mean", *POINTS)


def date_range(df: DataFrame) -> DataFrame:
    at = timestamp(F.col("InvoiceDate"))
    return df.agg(F.min(at).alias("first"), F.max(at).alias("last"))


def rows_by_month(df: DataFrame) -> DataFrame:
    return df.groupBy(F.date_format(timestamp(F.col("InvoiceDate")), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def invoice_kind() -> Column:
    i = F.col("Invoice")
    return F.when(i.rlike(r"^\d{6}$"), "normal").when(i.rlike(r"^C\d{6}$"), "cancellation").when(i.rlike(r"^A\d{6}$"), "adjustment").otherwise("other")


def invoice_types(df: DataFrame) -> DataFrame:
    """(type, rows, invoices): sales, cancellations, adjustments, others."""
    invoices = df.groupBy(invoice_kind().alias("type"), "Invoice").agg(F.count(F.lit(1)).alias("n"))
    return invoices.groupBy("type").agg(F.sum("n").alias("rows"), F.count("Invoice").alias("invoices"))


def sign(c: Column) -> Column:
    return F.when(c < 0, "negative").when(c == 0, "zero").when(c > 0, "positive").otherwise("unparsed")


def traits(df: DataFrame) -> DataFrame:
    """The rows with what their profile depends on: the signs of quantity and price, whether the invoice is a cancellation, whether a customer is known."""
    known, cancelled = raw("Customer ID").isNotNull(), F.coalesce(F.col("Invoice").startswith("C"), F.lit(False))
    return df.withColumns({"quantity_sign": sign(quantity(F.col("Quantity"))), "price_sign": sign(price(F.col("Price"))), "cancelled": cancelled, "with_customer": known})


def value_issues(df: DataFrame) -> DataFrame:
    """(measure, sign, cancelled, with_customer, n): rows by the sign of quantity and of price; a null trait stands for either.

    Traits have few combinations, so one aggregation leaves some dozen rows, and all margins are sums of these.
    """
    few = traits(df).groupBy("quantity_sign", "price_sign", "cancelled", "with_customer").agg(F.count(F.lit(1)).alias("n"))
    tall = few.select(F.expr("stack(2, 'quantity', quantity_sign, 'price', price_sign) AS (measure, sign)"), "cancelled", "with_customer", "n")
    for margin in ("cancelled", "with_customer"):
        tall = tall.withColumn(margin, F.explode(F.array(F.col(margin), F.lit(None).cast("boolean"))))
    return tall.groupBy("measure", "sign", "cancelled", "with_customer").agg(F.sum("n").alias("n"))


def customer_issues(df: DataFrame) -> DataFrame:
    """One row about customers and countries, by way of the different (customer, invoice, country)."""
    customer = raw("Customer ID")
    few = df.groupBy(customer.alias("customer"), "Invoice", "Country").agg(F.count(F.lit(1)).alias("n"))
    rows = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    known = F.col("customer").isNotNull()
    counts = few.agg(
        rows(~known).alias("rows_without_customer"), rows(known & ~F.col("customer").rlike(r"^\d{5}$")).alias("rows_with_malformed_customer"),
        rows(F.col("Country") == "Unspecified").alias("rows_without_country"),
    )
    invoices = few.where(~known).select("Invoice").distinct().agg(F.count("Invoice").alias("invoices_without_customer"))
    spread = few.where(known).groupBy("customer").agg((F.min("Country") != F.max("Country")).alias("several"))
    return counts.crossJoin(invoices).crossJoin(spread.agg(F.count_if("several").alias("customers_in_several_countries")))  # one row each


def special_codes(df: DataFrame) -> DataFrame:
    """(StockCode, rows, example): codes that don't look like a product's."""
    return df.where(~F.col("StockCode").rlike(r"^\d{5}[A-Za-z]*$")).groupBy("StockCode").agg(F.count(F.lit(1)).alias("rows"), F.min("Description").alias("example"))


def top_countries(df: DataFrame, n: int = 10) -> DataFrame:
    return df.groupBy("Country").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "Country").limit(n)


def samples(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows, by all columns, of each kind that there is, and the rows with the largest quantities.

    A kind is an invoice type with the row's traits. Each task hands on ``n`` rows of a kind at most.
    """
    order = [raw(c).asc_nulls_first() for c in RAW_COLUMNS]
    customer = F.when(F.col("with_customer"), "customer").otherwise("no customer")
    kind = F.concat_ws(", ", invoice_kind(), F.concat(F.col("quantity_sign"), F.lit(" quantity")), F.concat(F.col("price_sign"), F.lit(" price")), customer)
    place = F.row_number().over(Window.partitionBy("kind").orderBy(*order))
    first = traits(df).withColumn("kind", kind).withColumn("place", place).where(F.col("place") <= n)
    largest = df.orderBy(F.desc(F.abs(quantity(F.col("Quantity")))), *order).limit(n).withColumn("kind", F.lit("largest quantity"))
    return first.select(*[raw(c) for c in RAW_COLUMNS], "kind").unionByName(largest)
