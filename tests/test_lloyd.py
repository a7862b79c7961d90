"""Joint K-Means against plain Python and the library's K-Means."""

import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from granary.operators import lloyd
from granary.operators.clustering import fit_kmeans, silhouette


def blobs(seed, n=240):
    rng = random.Random(seed)
    return [(i, rng.gauss(3 * (i % 3), 0.6), rng.gauss(2 * (i % 2), 0.5)) for i in range(n)]


def distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def plain_run(points, k):
    """Centers and iterations, on the grid."""
    taken = [min(points, key=lambda p: (distance(p[1], (0, 0)), p[0]))[1]]
    while len(taken) < k:
        taken.append(min(points, key=lambda p: (-min(distance(p[1], c) for c in taken), p[0]))[1])
    centers, iterations = [tuple(map(float, c)) for c in taken], 0
    while True:
        own = [[] for _ in centers]
        for _, x in points:
            own[min(range(k), key=lambda i: distance(x, centers[i]))].append(x)
        new = [tuple(sum(c) / len(g) for c in zip(*g, strict=True)) if g else centers[i] for i, g in enumerate(own)]
        iterations += 1
        if max(distance(a, b) for a, b in zip(new, centers, strict=True)) <= 100.0**2:
            return sorted(new), iterations
        centers = new


@pytest.fixture(scope="module")
def tables(spark):
    parts = [spark.createDataFrame(blobs(s), "id int, a double, b double") for s in (1, 2)]
    return lloyd.on_grid(parts[0], "id", ["a", "b"], "one").unionByName(lloyd.on_grid(parts[1], "id", ["a", "b"], "two")).cache()


def test_all_runs_equal_plain_ones(tables):
    rows = {v: [(r["key"], tuple(r["x"])) for r in tables.where(F.col("variant") == v).collect()] for v in ("one", "two")}
    runs = lloyd.fit(tables, [2, 3, 5])
    assert {(r.variant, r.k) for r in runs} == {(v, k) for v in rows for k in (2, 3, 5)}
    for r in runs:
        centers, iterations = plain_run(rows[r.variant], r.k)
        assert r.iterations == iterations
        assert [pytest.approx(c) for c in centers] == list(r.centers)
        assert r.converged


def test_passes_are_shared_by_all_runs(tables, monkeypatch):
    passes, sums = [], lloyd._sums
    monkeypatch.setattr(lloyd, "_sums", lambda *a: (passes.append(1), sums(*a))[1])
    runs = lloyd.fit(tables, [2, 3, 4, 5])
    assert len(passes) == max(r.iterations for r in runs) < sum(r.iterations for r in runs)


def test_cost_and_silhouette_against_the_library(spark, tables):
    one = tables.where("variant = 'one'")
    runs = lloyd.fit(one, [3, 6])
    cost = {r["k"]: r["cost"] for r in lloyd.clusters(one, runs).groupBy("k").agg(F.sum("cost").alias("cost")).collect()}
    vectors = one.select("key", F.transform("x", lambda c: c.cast("double") / lloyd.GRID).alias("v")).withColumn("features", array_to_vector("v"))
    for k in (3, 6):
        assert cost[k] <= 1.1 * fit_kmeans(vectors, k).summary.trainingCost
    scores = {r["k"]: r["silhouette"] for r in lloyd.silhouettes(one, runs).collect()}
    for run in runs:
        labelled = lloyd.assigned(one, [run]).join(vectors.select("key", "v"), "key")
        assert scores[run.k] == pytest.approx(silhouette(labelled, "v", "cluster").first()["silhouette"], abs=1e-5)


def test_equal_points_and_none(spark):
    same = lloyd.on_grid(spark.createDataFrame([(i, 1.5) for i in range(5)], "id int, a double"), "id", ["a"])
    (run,) = lloyd.fit(same, [3])
    assert run.converged
    assert [(r["cluster"], r["n"], r["cost"]) for r in lloyd.clusters(same, [run]).collect()] == [(0, 5, 0.0)]
    with pytest.raises(ValueError):
        lloyd.fit(same.where("false"), [2])


def test_a_stored_model_gives_the_same_clusters(spark, tables, tmp_path):
    runs = lloyd.fit(tables, [3])
    lloyd.model_table(spark, runs, "v1").unionByName(lloyd.model_table(spark, runs[:1], "v2")).write.parquet(str(tmp_path / "model"))
    model = spark.read.parquet(str(tmp_path / "model"))
    own = lambda runs: {(r["variant"], r["key"]): r["cluster"] for r in lloyd.assigned(tables, runs).collect()}
    assert own(lloyd.from_table(model, "v1")) == own(runs)
    assert len(lloyd.from_table(model, "v2")) == 1
    with pytest.raises(KeyError):
        lloyd.from_table(model, "v3")


def test_a_stored_scaler_equals_scaling(spark, tables):
    from granary.operators.clustering import apply_scaler, fit_scaler, scaled

    df = spark.createDataFrame([(1, 0.0, 5.0), (2, 3.0, 5.0), (3, 9.0, 5.0)], "id int, a double, b double")
    for log in (True, False):
        model = fit_scaler(df, ["a", "b"], log)
        assert apply_scaler(df, model).orderBy("id").collect() == scaled(df, ["a", "b"], log).orderBy("id").collect()
        assert apply_scaler(df.where("id = 2"), model).first()["z_b"] == 0.0


def test_facts_are_exact_and_taken_once(spark, tables, monkeypatch):
    rng = random.Random(5)
    rows = [("one", i, [rng.randrange(-(1 << 60), 1 << 60), rng.randrange(-9, 9)]) for i in range(500)]
    points = spark.createDataFrame(rows, "variant string, key int, x array<bigint>")
    run = lloyd.Run("one", 2, ((-1e18, 0.0), (1e18, 0.0)))
    own = {c: [x for _, _, x in rows if (distance(x, run.centers[0]) > distance(x, run.centers[1])) == bool(c)] for c in (0, 1)}
    found = lloyd._sums(points, [run])["one", 2]
    assert {c: (f.n, f.sums) for c, f in found.items()} == {c: (len(g), [sum(s) for s in zip(*g, strict=True)]) for c, g in own.items()}
    passes, sums = [], lloyd._sums
    monkeypatch.setattr(lloyd, "_sums", lambda *a: (passes.append(1), sums(*a))[1])
    features = tables.select("key", F.col("x")[0].alias("a")).groupBy("key").agg(F.max("a").alias("a"))
    runs = [lloyd.Run(v, 2, ((0.0, 0.0), (3e6, 2e6))) for v in ("one", "two")]
    swept = lloyd.sweep(tables, runs, features, ["a"], "key").collect()
    assert len(swept) == 4 and len(passes) == 1  # sizes, costs and silhouettes from the same facts
    kept = lloyd.assigned(tables.withColumn("more", F.col("key") + 1), runs).where("more = key + 1")
    assert kept.count() == 480


def test_passes_read_blocks_with_the_same_sums(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(v, i, [rng.randrange(-(1 << b), 1 << b) for b in (22, 60, 36)]) for v in ("one", "two") for i in range(3_000)] + [("one", None, [1, 2, 3])]
    points = spark.createDataFrame(rows, "variant string, key int, x array<bigint>").repartition(3)
    blocks = lloyd.packed(points)
    assert blocks.count() <= 2 * 3 * (1 + 1_001 * 24 // lloyd.BLOCK) and blocks.agg(F.sum("n")).first()[0] == len(rows)
    runs = [lloyd.Run(v, k, tuple((1e6 * i, 1e17 * i, 0.0) for i in range(k))) for v in ("one", "two") for k in (2, 3)]
    plain, own = lloyd._sums(points, runs), lloyd._sums(blocks, runs)
    facts = lambda found: {(run, c): (f.n, f.sums) for run, g in found.items() for c, f in g.items()}
    assert facts(own) == facts(plain)
    assert all(f.d == pytest.approx(plain[run][c].d) and f.squares == pytest.approx(plain[run][c].squares) for run, g in own.items() for c, f in g.items())
    assert lloyd.farthest_first(blocks, 3) == lloyd.farthest_first(points, 3)
    widths, sums = [], lloyd._sums
    monkeypatch.setattr(lloyd, "_sums", lambda p, *a: (widths.append(p.schema["x"].dataType.simpleString()), sums(p, *a))[1])
    lloyd.fit(points, [2], max_iter=2)
    assert widths == ["binary"] * 2  # no pass reads a row for each point


def test_ties_of_far_points_go_to_the_lesser_key(spark):
    points = spark.createDataFrame([("v", 7, [-5, 0]), ("v", 3, [5, 0]), ("v", 5, [0, 5]), ("v", 9, [0, 0])], "variant string, key int, x array<bigint>").coalesce(1)
    assert lloyd.farthest_first(points, 2) == {"v": [(0.0, 0.0), (5.0, 0.0)]}


def test_clusters_carry_their_customers_without_a_join(spark, sf_dir, monkeypatch):
    from granary.plans import retail

    plans, written = {}, retail.materialize
    monkeypatch.setattr(retail, "materialize", lambda df, name: (plans.__setitem__(name, df._jdf.queryExecution().executedPlan().toString()), written(df, name))[1])
    own, points, run = retail._clusters(spark, sf_dir, tenure=True)
    assert "Join" not in plans["clusters"] and "Exchange" not in plans["clusters"]
    assert own.columns == ["CustomerID", "Recency", "Frequency", "Monetary", "Tenure", "Cluster"] and points.columns == ["variant", "key", "x"]
    joined = retail.rfm.rfm(retail.order_totals(spark, sf_dir), tenure=True).join(lloyd.assigned(points, [run]).select(F.col("key").alias("CustomerID"), F.col("cluster").alias("Cluster")), "CustomerID")
    assert sorted(own.collect()) == sorted(joined.collect())


def test_points_without_coordinates_are_an_error(spark):
    points = spark.createDataFrame([("one", 1, [1, None])], "variant string, key int, x array<bigint>")
    with pytest.raises(Exception, match="lacks coordinates"):
        lloyd.farthest_first(points, 2)
