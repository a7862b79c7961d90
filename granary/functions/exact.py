"""Exact sums of products of two-digit decimals, added up as whole numbers: no row needs a decimal of its own."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def hundredths(x: Column, digits: int) -> Column:
    """A double as ``decimal(digits, 2)``, in hundredths, as a long; null where it doesn't fit.

    A double that is the nearest one to a number of hundredths is that number. Others are rounded from their digits, by a cast to a decimal.
    """
    near = F.rint(x * 100)
    plain = (near / 100 == x) & (F.abs(x) < 10.0 ** (digits - 2))
    return F.when(plain, near.cast("long")).otherwise((x.try_cast(f"decimal({digits},2)") * 100).cast("long"))


def sum_parts(steps: Column, name: str) -> list[Column]:
    """The sums of the upper and the lower halves of longs, as ``name_high`` and ``name_low``, for :func:`total`. Neither overflows within 2^31 rows."""
    return [F.sum(F.shiftright(steps, 32)).alias(f"{name}_high"), F.sum(steps.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{name}_low")]


def total(name: str) -> Column:
    """The sum of ten-thousandths from its :func:`sum_parts`, as ``decimal(28, 4)``."""
    whole = F.col(f"{name}_high").cast("decimal(20,0)") * F.lit(1 << 32) + F.col(f"{name}_low")
    return (whole * F.lit(Decimal("0.0001"))).cast("decimal(28,4)")
