"""Sums by whole numbers against sums of decimals."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from granary.functions import exact
from granary.plans import retail

ODD = [0.285, 1.005, 2.675, 0.005, -0.015, -0.0, 1e-9, 4.35, 1.115, 9999999999.99, -9999999999.99, 123456789.125, None]


def test_hundredths_are_those_of_decimals(spark):
    rng = random.Random(1)
    values = ODD + [rng.randrange(10**9) / 100 for _ in range(2_000)] + [rng.uniform(-1e6, 1e6) for _ in range(2_000)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    wrong = df.where(~exact.hundredths(F.col("x"), 12).eqNullSafe((F.col("x").cast("decimal(12,2)") * 100).cast("long")))
    assert wrong.count() == 0
    unfit = spark.createDataFrame([(1e10,), (9999999999.996,), (float("nan"),), (float("inf"),)], "x double")
    assert unfit.where(exact.hundredths(F.col("x"), 12).isNotNull()).count() == 0


def test_totals_beyond_longs(spark):
    steps = [(1 << 62) - 3, (1 << 62) - 1, (1 << 62) + 11, -7]
    for own in (steps, [-s for s in steps], [None, 5], [None]):
        df = spark.createDataFrame([(s,) for s in own], "s bigint").agg(*exact.sum_parts(F.col("s"), "s")).select(exact.total("s").alias("t"))
        known = [s for s in own if s is not None]
        assert df.first()["t"] == (Decimal(sum(known)).scaleb(-4) if known else None) and df.schema["t"].dataType.simpleString() == "decimal(28,4)"


def _tables(spark, path, lines, orders):
    spark.createDataFrame(lines, "l_orderkey bigint, l_extendedprice double, l_discount double").write.parquet(f"{path}/lineitem.parquet")
    kinds = "o_orderkey bigint, o_custkey bigint, o_orderdate string"
    spark.createDataFrame(orders, kinds).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")).write.parquet(f"{path}/orders.parquet")
    return str(path)


def test_orders_totals_are_those_of_their_lines(spark, tmp_path):
    rng = random.Random(2)
    lines = [(rng.choice([*range(9), None]), rng.choice([*ODD, 17.5, 901.03]), rng.choice([0.04, 0.1, 0.055, 0.0, None])) for _ in range(400)] + [(7, None, 0.1), (5, float("nan"), 0.1), (6, 3.0, float("inf")), (77, 1e12, 0.1), (77, float("nan"), 500.0)]
    orders = [(k, k % 3, f"1998-01-0{k + 1}") for k in range(8)] + [(3, 9, "1999-01-01"), (None, 4, "1999-01-01"), (50, 5, "1999-01-01")]
    found = retail.order_totals(spark, path := _tables(spark, tmp_path, lines, orders))
    joined = retail.table(spark, path, "lineitem").join(retail.table(spark, path, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    amount = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    plain = joined.groupBy("o_custkey", "o_orderkey", "o_orderdate").agg(F.sum(amount))  # orders without lines, and lines without orders, are in neither
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join, totals = (next(i for i, s in enumerate(plan) if word in s) for word in ("Join", "Aggregate [l_orderkey"))
    assert join < totals  # lines are added up below the join


@pytest.mark.parametrize("line", [(1, 1e12, 0.1), (1, 5.0, 100.0)])
def test_an_amount_that_does_not_fit_fails(spark, tmp_path, line):
    path = _tables(spark, tmp_path, [line, (1, 3.0, 0.1), (1, float("nan"), 0.1), (1, 2.0, float("inf"))], [(1, 1, "1998-01-01")])
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE|CAST_|out of range|cannot be represented|overflow"):
        retail.order_totals(spark, path).collect()
