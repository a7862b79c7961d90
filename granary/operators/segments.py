"""Profiles of customer segments, with tenure, shares and self-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import ranks
from granary.operators.rfm import analysis_date
from granary.sources.scratch import materialize

MEASURES = ["Recency", "Frequency", "Monetary", "Tenure"]


def with_tenure(customers: DataFrame, tx: DataFrame, fixed: str | None = None, offset: int = 1) -> DataFrame:
    """Add ``Tenure``: days from the first transaction to the analysis date; null for customers without one. The transactions are read once."""
    own = materialize(tx.groupBy("CustomerID").agg(F.min("InvoiceDate").alias("first"), F.max("InvoiceDate").alias("last")), "first-dates")
    dated = own.crossJoin(F.broadcast(analysis_date(own.select(F.col("last").alias("InvoiceDate")), fixed, offset)))  # one row
    return customers.join(dated.select("CustomerID", F.date_diff("AnalysisDate", F.to_date("first")).cast("int").alias("Tenure")), "CustomerID", "left")


def measured(customers: DataFrame, *labels: str, measures: list[str] = MEASURES) -> DataFrame:
    """(labels..., measure, value): one row for each customer and measure that it has."""
    own = [m for m in measures if m in customers.columns]
    return customers.select(*labels, F.expr("stack({}, {}) AS (measure, value)".format(len(own), ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in own))))


def rule_segments(rfm: DataFrame, label: str = "Cluster") -> DataFrame:
    """Four segments by whether recency and spend lie below or above their median: a clustering that SQL can repeat."""
    medians = ranks.quantiles(measured(rfm, measures=["Recency", "Monetary"]), ["measure"], F.col("value"), {"median": 0.5})
    own = medians.agg(F.max(F.when(F.col("measure") == "Recency", F.col("median"))).alias("r"), F.max(F.when(F.col("measure") == "Monetary", F.col("median"))).alias("m"))
    number = (F.when(F.col("Recency") > F.col("r"), 2).otherwise(0) + F.when(F.col("Monetary") > F.col("m"), 1).otherwise(0)).cast("int")
    return rfm.crossJoin(F.broadcast(own)).select(*rfm.columns, number.alias(label))


def profile(customers: DataFrame, label: str = "Cluster") -> DataFrame:
    """One row for each segment: size, means and medians, spend, shares of all, and ratios of its medians to all customers' medians.

    What all customers have is summed from the segments' rows; medians of every segment and of all come from one search.
    """
    money = F.col("Monetary").cast("decimal(28,2)")
    own = customers.groupBy(label).agg(
        F.count(F.lit(1)).alias("CustomerCount"), *[F.avg(F.col(m).cast("double")).alias(f"Avg{m}") for m in MEASURES],
        F.sum(money).alias("money"), F.count_if(F.col("Frequency") == 1).alias("once"),
    )
    own = materialize(own, "segments")  # a row for each segment
    all_of = own.agg(F.sum("CustomerCount").alias("all_n"), F.sum("money").cast("double").alias("all_money"))
    scope = F.explode(F.array(F.col(label).cast("string"), F.lit(None).cast("string"))).alias("scope")  # null: all customers
    counted = measured(customers, label).groupBy(label, "measure", "value").agg(F.count(F.lit(1)).alias("copies"))  # before each is in two scopes
    found = ranks.quantiles(counted.select(scope, "measure", "value", "copies"), ["scope", "measure"], F.col("value"), {"median": 0.5}, copies=F.col("copies"))
    wide = found.groupBy("scope").agg(*[F.max(F.when(F.col("measure") == m, F.col("median"))).alias(f"Median{m}") for m in MEASURES])
    overall = wide.where("scope IS NULL").select(*[F.col(f"Median{m}").alias(f"all_{m}") for m in MEASURES[:3]])
    pct = lambda a, b: F.round(100 * F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 2)
    medians = wide.where("scope IS NOT NULL")
    joined = own.withColumn("TotalMonetary", F.col("money").cast("double")).join(F.broadcast(medians), F.col(label).cast("string") == F.col("scope"), "left")
    joined = joined.crossJoin(F.broadcast(all_of)).crossJoin(F.broadcast(overall))  # one row each
    return joined.select(
        label, "CustomerCount", *[F.round(f"Avg{m}", 2).alias(f"Avg{m}") for m in MEASURES], *[f"Median{m}" for m in MEASURES], "TotalMonetary",
        pct("once", "CustomerCount").alias("OneTimeBuyerPct"), pct("CustomerCount", "all_n").alias("CustomerPct"), pct("TotalMonetary", "all_money").alias("MonetaryPct"),
        *[F.round(F.try_divide(f"Median{m}", f"all_{m}"), 2).alias(f"{m}VsOverall") for m in MEASURES[:3]],
    )


def check_rows(flat: DataFrame, checks: list[tuple[str, str, str, float]]) -> DataFrame:
    """(check, value, expected, passed) from one row of figures: for each check its name, two expressions, and by how much they may differ."""
    number = lambda e: F.expr(e).cast("double")
    near = lambda a, b, by: F.coalesce(F.abs(a - b) <= by, F.lit(False))
    rows = [F.struct(F.lit(n).alias("check"), F.round(number(a), 2).alias("value"), F.round(number(b), 2).alias("expected"), near(number(a), number(b), by).alias("passed")) for n, a, b, by in checks]
    return flat.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


#: What a profile conserves: columns that add up to a sum over the customers, and columns that are shares of all.
ADDS_UP = {"CustomerCount": "count(1)", "TotalMonetary": "sum(CAST(Monetary AS DECIMAL(28,2)))"}
SHARES = ["CustomerPct", "MonetaryPct"]


def profile_checks(customers: DataFrame, profiled: DataFrame, label: str = "Cluster") -> DataFrame:
    """(check, value, expected, passed): what a profile conserves of the customers, and what holds for each of them."""
    rows = customers.agg(*[F.expr(c).alias(f"all_{n}") for n, c in ADDS_UP.items()], F.count_if(F.col("Tenure").isNull()).alias("no_tenure"), F.count_if(F.col("Tenure") < F.col("Recency")).alias("short"))
    sums = profiled.agg(*[F.sum(n).alias(n) for n in (*ADDS_UP, *SHARES)], F.min(label).alias("low"), F.max(label).alias("high"), F.count(F.lit(1)).alias("k"))
    conserved = [(f"{n} adds up", n, f"all_{n}", 0.05) for n in ADDS_UP] + [(f"{n} adds up to 100", n, "100", 0.05) for n in SHARES]
    held = [("customers without tenure", "no_tenure", "0", 0), ("tenures below recency", "short", "0", 0), ("labels begin at", "low", "0", 0), ("labels end at", "high", "k - 1", 0)]
    return check_rows(rows.crossJoin(sums), conserved + held)  # one row each


def name() -> Column:
    """A segment's name by how it compares with the others, never by its number."""
    recent, spends = F.col("RecencyVsOverall") <= 1, F.col("MonetaryVsOverall") > 1
    return F.when(recent & spends, "active, high value").when(recent, "active, low value").when(spends, "lapsing, high value").otherwise("lapsing, low value")


def labels(profiled: DataFrame, label: str = "Cluster") -> DataFrame:
    """(label, Name) of each segment."""
    return profiled.select(label, name().alias("Name"))
