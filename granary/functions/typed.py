"""Typed columns from raw text; what does not parse becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
#: Money is exact: prices and line amounts are decimals.
PRICE, AMOUNT = "decimal(18,4)", "decimal(18,3)"
#: Names of the typed table's text columns, by their raw names.
RENAMED = {"Invoice": "InvoiceNo", "StockCode": "StockCode", "Description": "Description", "Customer ID": "CustomerID", "Country": "Country"}


def quantity(raw: Column) -> Column:
    return raw.try_cast("int")


def price(raw: Column) -> Column:
    """Null for NaN and infinities too."""
    return raw.try_cast(PRICE)


def timestamp(raw: Column) -> Column:
    return F.try_to_timestamp(raw, F.lit(TS_FORMAT)).cast("timestamp_ntz")


def typed(raw: DataFrame, *more: str) -> DataFrame:
    """InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country, Amount, and columns ``more`` as they are."""
    q, p = quantity(F.col("Quantity")), price(F.col("Price"))
    names = {v: F.col(f"`{k}`") for k, v in RENAMED.items()}
    return raw.select(
        names["InvoiceNo"].alias("InvoiceNo"), names["StockCode"].alias("StockCode"), names["Description"].alias("Description"),
        q.alias("Quantity"), timestamp(F.col("InvoiceDate")).alias("InvoiceDate"), p.alias("UnitPrice"),
        names["CustomerID"].alias("CustomerID"), names["Country"].alias("Country"), (q * p).cast(AMOUNT).alias("Amount"), *more,
    )


def violated(condition: Column) -> Column:
    """A rule's condition as a flag: unknown counts as not violated."""
    return F.coalesce(condition, F.lit(False))


def blank(c: Column) -> Column:
    return F.trim(c) == ""
