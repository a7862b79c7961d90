"""Every retail query against its SQL."""

import pytest
from compare import same_rows

from granary import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, sf_dir, name):
    same_rows(catalog.queries()[name](spark, sf_dir), duck, catalog.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_kmeans_clusters_are_dense_and_ordered(spark, sf_dir):
    rows = catalog.queries()["kmeans_fit"](spark, sf_dir).collect()
    assert {r["Cluster"] for r in rows} == {0, 1, 2, 3}
    assert len({r["CustomerID"] for r in rows}) == len(rows)


def test_silhouette_equals_the_library(spark, sf_dir):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from granary.operators.clustering import silhouette

    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = points.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("int").alias("prediction"))
    assert silhouette(points, "embedding", "label").first()["silhouette"] == pytest.approx(ClusteringEvaluator().evaluate(vectors), abs=1e-5)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
