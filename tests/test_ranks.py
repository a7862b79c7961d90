"""Exact order statistics against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from granary.functions import ranks


def expected(values, share):
    values = sorted(values)
    return values[ranks.rank_of(share, len(values)) - 1]


@pytest.mark.parametrize("small", [10_000, 40])
def test_quantiles_of_many_groups(spark, small):
    rng = random.Random(small)
    groups = {
        "even": [float(x) for x in range(3000)], "one": [7.5], "same": [2.0] * 900, "half": [5.0] * 1500 + [rng.random() for _ in range(1500)],
        "wide": [math.exp(rng.uniform(-300, 300)) for _ in range(2000)], "signs": [rng.gauss(0, 1e6) for _ in range(2000)] + [0.0, -0.0], "twos": [1.0, 2.0] * 400,
    }
    rows = [(g, v) for g, own in groups.items() for v in own] + [(None, 1.0), (None, 3.0), ("even", None), ("none", None)]
    rng.shuffle(rows)
    points = {"low": 0.001, "p07": 0.07, "mid": 0.5, "p9": 0.9, "top": 1.0, "least": 0.0}
    found = {r["g"]: r for r in ranks.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], F.col("v"), points, small=small, sketch=200).collect()}
    assert set(found) == {*groups, None}
    for g, own in {**groups, None: [1.0, 3.0]}.items():
        assert {p: found[g][p] for p in points} == {p: expected(own, share) for p, share in points.items()}


def test_ranks_are_exact_in_decimals():
    assert [ranks.rank_of(p, 100) for p in (0.07, 0.07000001, 0.29, 0.99, 1.0, 0.0)] == [7, 8, 29, 99, 100, 1]


def test_ranks_without_groups(spark):
    df = spark.createDataFrame([(float(x % 37),) for x in range(500)] + [(None,)], "x double")
    values = sorted(float(x % 37) for x in range(500))
    found = ranks.at_ranks(df, [], F.col("x"), lambda n: {str(k): k for k in (-3, 1, 14, 250, n, n + 9)}, small=50)[()]
    assert found == {"-3": 0.0, "1": 0.0, "14": values[13], "250": values[249], "500": 36.0, "509": 36.0}
    assert ranks.at_ranks(df.where("false"), [], F.col("x"), lambda n: {"k": 1}) == {}
    assert ranks.quantiles(df.where("false"), [], F.col("x"), {"p": 0.5}).count() == 0


def test_rounds_are_few(spark, monkeypatch):
    rounds = []
    narrowed = ranks._narrowed
    monkeypatch.setattr(ranks, "_narrowed", lambda *a: (rounds.append(1), narrowed(*a))[1])
    rng = random.Random(4)
    df = spark.createDataFrame([(math.exp(rng.gauss(0, 50)),) for _ in range(20_000)], "x double")
    found = ranks.at_ranks(df, [], F.col("x"), lambda n: {"a": n // 3, "b": n // 2}, small=100)[()]
    values = sorted(r["x"] for r in df.collect())
    assert found == {"a": values[20_000 // 3 - 1], "b": values[9_999]}
    assert len(rounds) <= 3


def test_equal_values_are_counted_first(spark, monkeypatch):
    """Many rows of few different values are no reason for a round, and a row may stand for several."""
    monkeypatch.setattr(ranks, "_narrowed", lambda *_: pytest.fail("a round"))
    df = spark.range(30_000).select((F.col("id") % 7).cast("double").alias("x"), F.lit("g").alias("g"))
    wanted = {"a": 0.1, "b": 0.5, "c": 1.0}
    assert ranks.quantiles(df, ["g"], F.col("x"), wanted).first()[1:] == (0.0, 3.0, 6.0)
    few = spark.createDataFrame([("g", 1.0, 5), ("g", 2.0, 1), ("g", 1.0, 2), ("g", None, 90), ("h", 3.0, 1)], "g string, x double, n long")
    found = {r["g"]: r[1:] for r in ranks.quantiles(few, ["g"], F.col("x"), {"low": 0.87, "high": 0.88}, copies=F.col("n")).collect()}
    assert found == {"g": (1.0, 2.0), "h": (3.0, 3.0)}


@pytest.mark.parametrize("values, expected", [(["3", "x", "1", "3"], (1.0, 3.0, 2.3333, 3.0)), (["x"], (None, None, None, None))])
def test_numeric_profile_with_values_that_do_not_parse(spark, values, expected):
    from granary.operators.profiling import numeric_stats

    df = spark.createDataFrame([(v, v) for v in values], "Quantity string, Price string")
    assert {r["column"]: (r["min"], r["max"], r["mean"], r["p50"]) for r in numeric_stats(df).collect()} == {"Quantity": expected, "Price": expected}
