"""Reconciliation by bucket digests, sketches of different values, and files sized by bytes."""

import random

import pytest
from pyspark.sql import functions as F
from test_bags import shuffled_rows

from granary.operators import distinct, reconcile
from granary.sources import retail

KEYED = "k string, n long, x double"


def changed_tables(rng, keys):
    """Two tables by key: a few rows dropped, added, moved by a little and by much, and made null."""
    left = {f"k{i}": (rng.randrange(100), rng.random()) for i in range(keys)} | {None: (1, None)}
    right = dict(left)
    del right["k3"], left["k4"]
    right["k5"], right["k6"], right["k7"] = (left["k5"][0], left["k5"][1] + 0.001), (left["k6"][0], left["k6"][1] + 1), (None, left["k7"][1])
    return left, right


def plain_changes(left, right, tolerance):
    def differ(a, b):
        return any((x is None) != (y is None) or x is not None and abs(x - y) > tolerance for x, y in zip(a, b, strict=True))

    return {k: "only_left" if k not in right else "only_right" if k not in left else "different" for k in left | right if k not in right or k not in left or differ(left[k], right[k])}


@pytest.mark.parametrize("buckets", [1, 7, 1 << 16])
@pytest.mark.parametrize("tolerance", [0.0, 0.01])
def test_changes_equal_a_plain_comparison(spark, buckets, tolerance):
    left, right = changed_tables(random.Random(buckets), 60)
    a, b = (spark.createDataFrame([(k, *v) for k, v in t.items()], KEYED) for t in (left, right))
    expected = plain_changes(left, right, tolerance)
    told, _ = reconcile.keyed_changes(a, b, "k", ["n", "x"], tolerance, buckets)
    assert {r["k"]: r["change"] for r in told.where("change <> 'none'").collect()} == expected
    counts = reconcile.keyed_differences(a, b, "k", ["n", "x"], tolerance, buckets).first().asDict()
    kinds = list(expected.values())
    assert counts == {"rows": len(left | right), **{k: kinds.count(k) for k in ("only_left", "only_right", "different")}}


def test_rows_of_equal_buckets_do_not_shuffle(spark, tmp_path):
    left, right = changed_tables(random.Random(1), 2000)
    paths = [str(tmp_path / n) for n in "ab"]
    for path, t in zip(paths, (left, right), strict=True):
        spark.createDataFrame([(k, *v) for k, v in t.items()], KEYED).write.parquet(path)
    told, same = reconcile.keyed_changes(*[spark.read.parquet(p) for p in paths], "k", ["n", "x"])
    assert same.first()["rows"] >= 1900
    assert sum(shuffled_rows(told)) < 100


def test_types_of_both_sides_may_differ_and_tables_be_empty(spark):
    a, b = spark.createDataFrame([("a", 1, 2.0)], "k string, n int, x float"), spark.createDataFrame([("a", 1, 2.0)], KEYED)
    count = lambda x, y: tuple(reconcile.keyed_differences(x, y, "k", ["n", "x"]).first())
    assert count(a, b) == (1, 0, 0, 0)
    assert count(a, b.limit(0)) == (1, 1, 0, 0)
    assert count(a.limit(0), b) == (1, 0, 1, 0)
    assert count(a.limit(0), b.limit(0)) == (0, 0, 0, 0)


def test_sketches_merge_to_what_all_rows_have(spark):
    """Months that share half of their values: sums of months would count these twice, merged sketches don't."""
    n = 60_000
    rows = spark.range(3 * n).select((F.col("id") % 3).alias("month"), F.expr(f"(id div 3) + (id % 3) * {n // 2}").cast("string").alias("v"))
    stored = distinct.sketches(rows, F.col("month"), {"v": "v"})
    year = distinct.merged(stored, F.lit("all")).first()["estimate"]
    assert abs(year - 2 * n) <= distinct.error_bound() * 2 * n
    months = distinct.held_to_bound(distinct.merged(stored, F.col("part")), distinct.exact(rows, F.col("month"), {"v": "v"})).collect()
    assert {(r["part"], r["n"], r["within"]) for r in months} == {(m, n, True) for m in range(3)}
    wrong = stored.where("part < 2")
    assert not all(r["within"] for r in distinct.held_to_bound(distinct.merged(wrong, F.col("part")), distinct.exact(rows, F.col("month"), {"v": "v"})).collect())


def test_sketches_of_nulls_empty_texts_and_no_rows(spark):
    rows = spark.createDataFrame([("m", None), ("m", ""), ("m", ""), ("e", None), (None, "x")], "part string, v string")
    stored = distinct.sketches(rows, F.col("part"), {"v": "v"})
    assert {r["part"]: r["estimate"] for r in distinct.merged(stored, F.col("part")).collect()} == {"m": 1, "e": 0, None: 1}
    assert all(r["within"] for r in distinct.held_to_bound(distinct.merged(stored, F.col("part")), distinct.exact(rows, F.col("part"), {"v": "v"})).collect())
    assert distinct.merged(distinct.sketches(rows.limit(0), F.col("part"), {"v": "v"}), F.col("part")).count() == 0


def test_a_group_has_one_row_for_all_its_sketches_until_they_are_told_apart(spark):
    rows = spark.range(0, 300, 1, 2).select((F.col("id") % 3).alias("part"), F.col("id").alias("v"), (F.col("id") % 7).alias("w"))
    stored = distinct.sketches(rows, F.col("part"), {"v": "v", "w": "w"})
    assert shuffled_rows(stored) == [6]  # three of each task, not a row for each group and column
    assert {(r["part"], r["what"]) for r in stored.collect()} == {(p, c) for p in range(3) for c in "vw"}
    assert all(abs(r["estimate"] - {"v": 100, "w": 7}[r["what"]]) <= 1 for r in distinct.merged(stored, F.col("part")).collect())


@pytest.mark.parametrize("tasks", [1, 40])
def test_files_are_of_the_size_asked_for(spark, tmp_path, tasks):
    rows = spark.range(0, 300_000, 1, tasks).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    path, size = str(tmp_path / "t"), 1 << 20
    files = retail.write_sized(rows, path, size)
    lengths = [r["length"] for r in retail.list_files(spark, path).where("path LIKE '%.parquet'").collect()]
    assert files == len(lengths) > 5
    assert all(size / 2 <= x <= 2 * size for x in lengths)
    assert spark.read.parquet(path).agg(F.count("id"), F.sum("id")).first() == (300_000, 300_000 * 299_999 // 2)


def test_a_small_and_an_empty_table_are_one_file(spark, tmp_path):
    for name, n in (("small", 5), ("empty", 0)):
        retail.write_sized(spark.range(0, n, 1, 8).toDF("id"), str(tmp_path / name))
        assert retail.read_parquet(spark, str(tmp_path / name)).count() == n
        assert retail.list_files(spark, str(tmp_path / name)).where("path LIKE '%.parquet'").count() == 1


@pytest.mark.parametrize("parts", [1, 3])
def test_sized_files_of_large_shares_are_cut_where_rows_lie(spark, tmp_path, monkeypatch, parts):
    """Rows don't move, but for the ends of tasks; none is lost or doubled, and each file is in the range."""
    rows, path, size = spark.range(0, 400_000, 1, parts).select("id", F.md5(F.col("id").cast("string")).alias("t")), str(tmp_path / "cut"), 1 << 19
    dealt, cut = [], retail._write_cut
    monkeypatch.setattr(retail, "_write_cut", lambda *a: (dealt.append(1), cut(*a))[1])
    files = retail.write_sized(rows, path, size)
    lengths = [r["length"] for r in retail.list_files(spark, path).where("path LIKE '%.parquet'").collect()]
    assert dealt and files == len(lengths) > 4 * parts
    assert size / 2 <= min(lengths) and max(lengths) <= 2 * size
    back = spark.read.parquet(path)
    assert back.count() == back.distinct().count() == 400_000 and back.exceptAll(rows).isEmpty()
    blocks = back.groupBy(F.input_file_name()).agg((F.max("id") - F.min("id") + 1 == F.count("id")).alias("whole")).where("whole").count()
    assert blocks >= files - 2 * parts  # all but the files of ends hold rows that stood together
