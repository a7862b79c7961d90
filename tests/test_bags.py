"""Bags of rows, and the time line of cancellations, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_rules import DAY, raw, row

from granary.operators import bags, rules
from granary.sources.retail import RAW_COLUMNS


def some_rows(rng, n):
    return [row(str(rng.randrange(4)), text=rng.choice(["a", None]), customer=rng.choice([None, "", "x"])) for _ in range(n)]


@pytest.mark.parametrize("bound", [None, 0])
def test_counted_and_set_operations(spark, monkeypatch, bound):
    if bound is not None:
        monkeypatch.setattr(bags, "BROADCAST_DIGESTS", bound)
    rng = random.Random(3)
    a, b = some_rows(rng, 60), some_rows(rng, 40) + [row("only b")]
    left, right = Counter(a), Counter(b)
    plain = lambda df: Counter(tuple(r) for r in df.collect())
    assert {tuple(r)[:8]: r["n"] for r in bags.counted(raw(spark, a), RAW_COLUMNS, {"n": F.lit(1)}).collect()} == left
    assert {tuple(r)[:8]: (r["l"], r["r"]) for r in bags.sided(raw(spark, a), raw(spark, b), RAW_COLUMNS).collect()} == {x: (left[x], right[x]) for x in left | right}
    assert plain(bags.intersect_all(raw(spark, a), raw(spark, b), RAW_COLUMNS)) == left & right
    assert plain(bags.except_all(raw(spark, a), raw(spark, b), RAW_COLUMNS)) == left - right
    assert bags.intersect_all(raw(spark, []), raw(spark, b), RAW_COLUMNS).count() == 0


def test_nulls_in_other_places_are_other_rows(spark):
    rows = [row(text=None, customer="a"), row(text="a", customer=None)]
    assert bags.counted(raw(spark, rows), RAW_COLUMNS, {"n": F.lit(1)}).count() == 2


def shuffled_rows(df):
    """Rows that each exchange of the plan that ran has written."""
    out = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        if name == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            walk(node.plan())
        else:
            children = node.children()
            for i in range(children.size()):
                walk(children.apply(i))

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_rows_whose_digest_is_alone_do_not_shuffle(spark, tmp_path):
    raw(spark, [row(str(i)) for i in range(500)] + [row("1")]).write.parquet(str(tmp_path / "rows"))
    df = bags.counted(spark.read.parquet(str(tmp_path / "rows")), RAW_COLUMNS, {"n": F.lit(1)})
    assert [r["Invoice"] for r in df.collect() if r["n"] > 1] == ["1"]
    assert 1 <= sum(shuffled_rows(df)) <= 2  # the copies of one row; the other 499 are in no exchange


def test_only_rows_of_cancelled_keys_shuffle(spark, tmp_path):
    rows = [row(str(500000 + i), code=f"2{i:04d}") for i in range(400)] + [row("C600000", code="20007", quantity="-5", at=DAY.format(3))]
    rules.folded(raw(spark, rows)).write.parquet(str(tmp_path / "rows"))
    found = rules.match_cancellations(spark.read.parquet(str(tmp_path / "rows")))
    assert shuffled_rows(found) == [2]
    assert [r["InvoiceNo"] for r in found.where("matched").collect()] == ["500007"]


def test_beyond_the_bound_few_other_rows_shuffle(spark, tmp_path):
    raw(spark, [row(str(i)) for i in range(500)] + [row("1")]).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    df = bags.counted(rows, RAW_COLUMNS, {"n": F.lit(1)}, broadcast_digests=0)
    assert 2 <= sum(shuffled_rows(df)) < 25  # not all 501
    assert Counter(r["n"] for r in df.collect()) == {1: 499, 2: 1}


def test_beyond_the_bound_few_rows_of_other_keys_shuffle(spark, tmp_path):
    rows = [row(str(500000 + i), code=f"2{i:04d}") for i in range(400)] + [row("C600000", code="20007", quantity="-5", at=DAY.format(3))]
    rules.folded(raw(spark, rows)).write.parquet(str(tmp_path / "rows"))
    found = rules.match_cancellations(spark.read.parquet(str(tmp_path / "rows")), broadcast_keys=0)
    assert 2 <= sum(shuffled_rows(found)) < 25  # not all 401
    assert [r["InvoiceNo"] for r in found.where("matched").collect()] == ["500007"]
    assert found.count() == 401


def test_repeated_rows_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(bags, "COPIES", 3)
    df = spark.createDataFrame([("a", 7), ("b", 3), ("c", 0), ("d", -1), ("e", 1)], "x string, n int")
    assert Counter(r["x"] for r in bags.repeated(df, F.col("n")).collect()) == {"a": 7, "b": 3, "e": 1}


def expected_matches(rows):
    """Of each key's purchases no later than its last cancellation, as many as it has cancellations, the latest first."""
    keys = {}
    for r in rows:
        keys.setdefault((r["CustomerID"], r["StockCode"], abs(r["Quantity"]), r["UnitPrice"]), []).append(r)
    out = Counter()
    for (customer, *_), own in keys.items():
        cancels = [r for r in own if r["InvoiceNo"].startswith("C")]
        if customer is None or not cancels:
            continue
        last = max(r["InvoiceDate"] for r in cancels)
        bought = [r for r in own if not r["InvoiceNo"].startswith("C") and r["Quantity"] > 0 and r["InvoiceDate"] <= last]
        bought.sort(key=lambda r: (r["InvoiceDate"], r["InvoiceNo"], r["Description"] is not None, r["Description"] or "", r["Country"]), reverse=True)
        out.update((r["InvoiceNo"], r["InvoiceDate"], r["Description"], r["CustomerID"], r["StockCode"], r["Quantity"]) for r in bought[: len(cancels)])
    return out


@pytest.mark.parametrize("bound", [None, 0])
def test_cancellations_close_the_latest_purchases(spark, bound):
    rng = random.Random(11)
    rows = []
    for k in range(400):
        cancel = rng.random() < 0.25
        quantity = rng.choice(["5", "7"])
        rows.append(row(f"{'C' if cancel else ''}{500000 + k}", rng.choice(["10001", "10002"]), rng.choice(["a", "b", None]), f"-{quantity}" if cancel or rng.random() < 0.1 else quantity, DAY.format(rng.randrange(1, 9)), "2.5", rng.choice(["1", "1", "2", None])))
    sound = rules.folded(raw(spark, rows)).where("InvoiceDate IS NOT NULL")
    found = rules.match_cancellations(sound, broadcast_keys=bound)
    assert found.count() == sound.count()
    names = ("InvoiceNo", "InvoiceDate", "Description", "CustomerID", "StockCode", "Quantity")
    assert Counter(tuple(r[n] for n in names) for r in found.where("matched").collect()) == expected_matches(sound.collect())


def test_a_hot_key_and_rows_of_other_keys(spark):
    rows = [row(str(500000 + i), at=DAY.format(1 + i % 9)) for i in range(300)] + [row("C600000", quantity="-5", at=DAY.format(9)), row("C600001", quantity="-5", at=DAY.format(2))]
    rows += [row(str(700000 + i), code=f"2000{i}") for i in range(9)]
    found = rules.match_cancellations(rules.folded(raw(spark, rows)))
    assert {r["cancels"] for r in found.where("StockCode = '10001'").collect()} == {2}
    assert [r["InvoiceNo"] for r in found.where("matched").orderBy("InvoiceNo").collect()] == ["500287", "500296"]
    assert {r["cancels"] for r in found.where("StockCode <> '10001'").collect()} == {None}
