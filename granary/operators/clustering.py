"""Scaling, K-Means, assignment and measures of a clustering; the measures and the scaling in relational form."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED, MAX_ITER, TOLERANCE = 42, 100, 1e-4


def fit_scaler(table: DataFrame, features: list[str], log: bool = True) -> DataFrame:
    """The model of :func:`apply_scaler` as a table, (feature, log, mean, std): one row for each feature, to be stored and applied to other rows."""
    tall = table.select(F.expr("stack({}, {}) AS (feature, x)".format(len(features), ", ".join(f"'{f}', CAST({f} AS DOUBLE)" for f in features))))
    x = F.log1p("x") if log else F.col("x")
    return tall.groupBy("feature").agg(F.lit(log).alias("log"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))


def apply_scaler(table: DataFrame, model: DataFrame) -> DataFrame:
    """Add ``z_<feature>`` by a stored model: (x - mean) / deviation, of log(1 + x) where it says so; 0 where the deviation is none."""
    known = [r["feature"] for r in model.select("feature").orderBy("feature").collect()]  # a row for each feature
    row = model.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("log", "mean", "std")))).alias("_model"))
    joined = table.crossJoin(F.broadcast(row))  # one row

    def z(f: str) -> Column:
        own, x = F.col("_model")[f], F.col(f).cast("double")
        return F.coalesce(F.try_divide(F.when(own["log"], F.log1p(x)).otherwise(x) - own["mean"], own["std"]), F.lit(0.0))

    return joined.select(*table.columns, *[z(f).alias(f"z_{f}") for f in known])


def scaled(table: DataFrame, features: list[str], log: bool = True) -> DataFrame:
    """Add ``z_<feature>``: (x - mean) / sample deviation, of log(1 + x) if ``log``; 0 where the deviation is none."""
    x = {f: F.log1p(F.col(f).cast("double")) if log else F.col(f).cast("double") for f in features}
    stats = table.agg(*[F.avg(c).alias(f"m_{f}") for f, c in x.items()], *[F.stddev_samp(c).alias(f"s_{f}") for f, c in x.items()])
    joined = table.crossJoin(F.broadcast(stats))  # one row
    return joined.select(*table.columns, *[F.coalesce(F.try_divide(c - F.col(f"m_{f}"), F.col(f"s_{f}")), F.lit(0.0)).alias(f"z_{f}") for f, c in x.items()])


def scaling_summary(table: DataFrame, features: list[str]) -> DataFrame:
    """(feature, kind, mean, std, min, max) of raw, logarithmic and scaled values."""
    z = scaled(table, features)
    kinds = [(f, kind, c) for f in features for kind, c in (("raw", f"CAST({f} AS DOUBLE)"), ("log", f"log1p(CAST({f} AS DOUBLE))"), ("scaled", f"z_{f}"))]
    tall = z.select(F.expr("stack({}, {}) AS (feature, kind, value)".format(len(kinds), ", ".join(f"'{f}', '{k}', {c}" for f, k, c in kinds))))
    near = lambda c: F.round(c, 4) + F.lit(0.0)  # noqa: E731  turns -0.0 into 0.0
    return tall.groupBy("feature", "kind").agg(near(F.avg("value")).alias("mean"), near(F.stddev_samp("value")).alias("std"), near(F.min("value")).alias("min"), near(F.max("value")).alias("max"))


def assembled(table: DataFrame, columns: list[str], to: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=to).transform(table)


def fit_kmeans(table: DataFrame, k: int, features_col: str = "features", seed: int = SEED, max_iter: int = MAX_ITER, tol: float = TOLERANCE) -> KMeansModel:
    """The library's K-Means (k-means||, Euclidean), to compare :mod:`granary.operators.lloyd` with. The table is read many times: write it first."""
    return KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol=features_col, predictionCol="Cluster").fit(table)


def selected_k(k: int | None) -> int:
    """The number of clusters to fit; it must have been chosen first, from the sweep."""
    if k is None or k < 2:
        raise ValueError("choose the number of clusters from the sweep first; two at least")
    return k


def centroids(points: DataFrame, vector: str, label: str) -> DataFrame:
    """(label, n, center, norm) of each group: the mean vector, and the mean squared length of its points."""
    cells = points.select(label, F.posexplode(vector).alias("i", "x"))
    means = cells.groupBy(label, "i").agg(F.sum("x").alias("sum"))
    facts = points.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.sum(squared(F.col(vector))).alias("squares"))
    gathered = means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "sum"))), lambda s: s["sum"]).alias("sums"))  # one entry a dimension
    return gathered.join(facts, label).select(label, "n", F.transform("sums", lambda s: s / F.col("n")).alias("center"), (F.col("squares") / F.col("n")).alias("squares"))


def squared(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def distances(points: DataFrame, vector: str, label: str) -> DataFrame:
    """Add ``d``: for each group (label, n, mean squared distance to its points, squared distance to its center), by label.

    Groups are few; their centers come as one broadcast row.
    """
    c = centroids(points, vector, label)
    row = c.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "n", "center", "squares"))).alias("groups"))
    own = points.crossJoin(F.broadcast(row))  # one row
    each = lambda g: F.struct(
        g["label"].alias("label"), g["n"].alias("n"),
        (squared(F.col(vector)) + g["squares"] - 2 * dot(F.col(vector), g["center"])).alias("mean_square"),
        (squared(F.col(vector)) + squared(g["center"]) - 2 * dot(F.col(vector), g["center"])).alias("to_center"),
    )
    return own.withColumn("d", F.transform("groups", each)).drop("groups")


def assign_nearest(points: DataFrame, vector: str, label: str, key: str) -> DataFrame:
    """(key, label, nearest, distance): the group whose center is nearest; the least label of equal ones."""
    near = F.array_min(F.transform("d", lambda g: F.struct(F.round(g["to_center"], 6).alias("near"), g["label"].alias("nearest"), g["to_center"].alias("distance"))))
    return distances(points, vector, label).select(key, label, near.alias("m")).select(key, label, "m.nearest", "m.distance")


def silhouette(points: DataFrame, vector: str, label: str) -> DataFrame:
    """One row, the mean silhouette with squared Euclidean distances; points alone in their group score 0."""
    own = F.filter("d", lambda g: g["label"] == F.col(label))[0]
    a = F.when(own["n"] > 1, own["mean_square"] * own["n"] / F.greatest(own["n"] - 1, F.lit(1)))
    b = F.array_min(F.transform(F.filter("d", lambda g: g["label"] != F.col(label)), lambda g: g["mean_square"]))
    s = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    scored = distances(points, vector, label).select(a.alias("a"), b.alias("b"))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise(s)), 6).alias("silhouette"))


def inertia(points: DataFrame, vector: str, label: str) -> DataFrame:
    """(label, n, inertia): squared distances to the group's own center."""
    own = F.filter("d", lambda g: g["label"] == F.col(label))[0]["to_center"]
    return distances(points, vector, label).groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(own), 3).alias("inertia"))


def cluster_means(table: DataFrame, features: list[str], label: str = "Cluster") -> DataFrame:
    return table.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col(f).cast("double")), 2).alias(f"mean_{f}") for f in features])
