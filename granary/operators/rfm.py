"""Recency, frequency and monetary value of customers, and statistics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import ranks
from granary.sources.scratch import materialize

OFFSET_DAYS = 1
FEATURES = ["Recency", "Frequency", "Monetary"]
QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def analysis_date(tx: DataFrame, fixed: str | None = None, offset: int = OFFSET_DAYS) -> DataFrame:
    """One row: the fixed date, else the day of the latest transaction plus the offset."""
    day = F.lit(fixed).cast("date") if fixed else F.date_add(F.to_date(F.max("InvoiceDate")), offset)
    return tx.agg(day.alias("AnalysisDate"))


def customers(tx: DataFrame) -> DataFrame:
    """(CustomerID, first, last, Frequency, Amount): one row for each customer, written, so that what is made from it reads the transactions no second time.

    Two levels of aggregation count distinct invoices without a copy of each row for it.
    """
    invoices = tx.groupBy("CustomerID", "InvoiceNo").agg(F.min("InvoiceDate").alias("first"), F.max("InvoiceDate").alias("last"), F.sum("Amount").alias("amount"))
    own = invoices.groupBy("CustomerID").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.count("InvoiceNo").alias("Frequency"), F.sum("amount").cast("decimal(28,2)").alias("Amount")
    )
    return materialize(own, "customers")


def rfm(tx: DataFrame, fixed: str | None = None, offset: int = OFFSET_DAYS, tenure: bool = False) -> DataFrame:
    """(CustomerID, Recency, Frequency, Monetary) from CustomerID, InvoiceNo, InvoiceDate, Amount; with ``tenure`` also Tenure, the days since the first transaction.

    The latest day comes from the customers' last ones, so the transactions are read once.
    """
    own = customers(tx)
    date = analysis_date(own.select(F.col("last").alias("InvoiceDate")), fixed, offset)
    dated = own.crossJoin(F.broadcast(date))  # one row
    days = lambda c: F.date_diff("AnalysisDate", F.to_date(c)).cast("int")
    more = [days("first").alias("Tenure")] if tenure else []
    return dated.select("CustomerID", days("last").alias("Recency"), "Frequency", F.col("Amount").cast("double").alias("Monetary"), *more)


def unpivoted(table: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """(feature, value): one row for each customer and feature."""
    return table.select(F.expr("stack({}, {}) AS (feature, value)".format(len(features), ", ".join(f"'{f}', CAST({f} AS DOUBLE)" for f in features))))


def describe(table: DataFrame, digits: int = 4) -> DataFrame:
    """Minimum, maximum, mean, sample deviation, population skewness of each feature by one aggregation, and exact quantiles."""
    value, own = F.col("value"), lambda c: F.round(c, digits)
    tall = unpivoted(table)
    stats = tall.groupBy("feature").agg(
        F.count("value").alias("n"), own(F.min(value)).alias("min"), own(F.max(value)).alias("max"), own(F.avg(value)).alias("mean"),
        own(F.stddev_samp(value)).alias("std"), own(F.skewness(value)).alias("skew"),
    )
    points = ranks.quantiles(tall, ["feature"], value, QUANTILES)  # a row for each feature
    return stats.join(F.broadcast(points), "feature", "left").select("feature", "n", "min", "max", "mean", "std", "skew", *[own(name).alias(name) for name in QUANTILES])


def iqr_outliers(table: DataFrame, factor: float = 1.5) -> DataFrame:
    """Fences of each feature and how many customers lie strictly beyond them; none is removed."""
    tall = unpivoted(table)
    quartiles = ranks.quantiles(tall, ["feature"], F.col("value"), {"low": 0.25, "high": 0.75})
    reach = factor * (F.col("high") - F.col("low"))
    fences = quartiles.select("feature", (F.col("low") - reach).alias("lower"), (F.col("high") + reach).alias("upper"))
    counted = tall.join(F.broadcast(fences), "feature").groupBy("feature", "lower", "upper")
    return counted.agg(F.count_if(F.col("value") < F.col("lower")).alias("below"), F.count_if(F.col("value") > F.col("upper")).alias("above")).select(
        "feature", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"), "below", "above"
    )


def correlations(table: DataFrame) -> DataFrame:
    pairs = [("Recency", "Frequency"), ("Recency", "Monetary"), ("Frequency", "Monetary")]
    return table.agg(*[F.round(F.corr(a, b), 3).alias(f"{a}_{b}") for a, b in pairs])


def one_time_buyers(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("Frequency") == 1).alias("one_time_buyers"))


def top_share(table: DataFrame, share: float = 0.01) -> DataFrame:
    """(n_top, top_amount, total_amount, top_pct): what the customers with the highest spend bring in; at least one counts.

    The least spend among them is found by counting, so that no task ranks all customers; of equal ones any will do.
    """
    money, count = F.col("Monetary").cast("decimal(28,2)"), [0, 0]

    def least_of(n: int) -> dict[str, int]:
        count[:] = n, min(n, max(1, int(n * share + 0.5)))
        return {"least": n - count[1] + 1}

    least = ranks.at_ranks(table, [], F.col("Monetary"), least_of).get((), {}).get("least")
    if least is None:
        return table.agg(F.lit(0).cast("long").alias("n_top"), *[F.lit(None).cast("double").alias(c) for c in ("top_amount", "total_amount", "top_pct")])
    above = F.sum(F.when(F.col("Monetary") > least, money)), F.count_if(F.col("Monetary") > least)
    top = F.coalesce(above[0], F.lit(0)) + (F.lit(count[1]) - above[1]) * F.lit(least).cast("decimal(28,2)")
    sums = table.agg(top.cast("double").alias("top_amount"), F.sum(money).cast("double").alias("total_amount"))
    return sums.select(F.lit(count[1]).cast("long").alias("n_top"), "top_amount", "total_amount", F.round(100 * F.try_divide("top_amount", "total_amount"), 2).alias("top_pct"))


def top_customers(table: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` customers by each feature, highest first; ties go by id."""
    parts = [table.orderBy(F.desc(f), "CustomerID").limit(n).withColumn("by", F.lit(f)).withColumn("place", F.row_number().over(Window.partitionBy("by").orderBy(F.desc(f), "CustomerID"))) for f in FEATURES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("by", "place", "CustomerID", *FEATURES)
