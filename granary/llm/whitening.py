"""Whitening of embeddings over their distinct vectors.

Equal vectors are grouped, and the fit runs over the groups: each counts once, or as often as it occurs (``weights``). Two passes over the distinct vectors
give the covariance: exact sums of whole numbers first, then in each task a product of matrices, centred before it is multiplied and weighted. Only a table of
dimensions by dimensions meets, in an aggregation, and goes to the driver, where its eigenvectors are taken. Each distinct vector is whitened once; rows get
their values by a join on the vector's digest. Vectors that hold more than a thousandth of all rows, a thousand at most, are joined by broadcast, so
no task gathers the rows of one vector.

Edge cases: rows whose vector is null or holds a null or an entry that is not finite are dropped; null and repeated ids keep a row each. Shorter vectors count as
filled up with zeros, empty ones as zeros. A component whose eigenvalue is zero but for rounding has null as its whitened value and stays out of the
identity error, which is null if no component is left. A deviation that no 64-bit integer holds is null. Vectors of fewer than four dimensions
have as many components as dimensions. Empty tables give an empty result. Other columns are ignored, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import materialize, ship_package, text_digest
from granary.llm.vectors import matrix, sound, whole, widths

COMPONENTS = 4
#: Eigenvalues up to this share of the trace count as zero.
ROUNDING = 1e-12
#: Vectors with more than this share of all rows are joined by broadcast: at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
_LONG = (1 << 63) - 1


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(digest, x, copies) of each different vector of ``rows`` (id, digest, x), written."""
    return materialize(rows.groupBy("digest").agg(F.any_value("x").alias("x"), F.count(F.lit(1)).alias("copies")), "distinct")


def weight(weights: str) -> Column:
    if weights not in ("one", "count"):
        raise ValueError("weights are 'one' or 'count'")
    return F.lit(1).cast("long") if weights == "one" else F.col("copies")


def sums(distinct: DataFrame, width: int, weights: str) -> tuple[int, list[int]]:
    """The total weight and each dimension's weighted sum, exact."""
    total = distinct.agg(F.coalesce(F.sum(weight(weights)), F.lit(0))).first()[0]
    cells = distinct.select(F.posexplode("x").alias("i", "v"), weight(weights).alias("w"))
    each = cells.groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)") * F.col("w")).alias("s")).collect()  # a row for each dimension
    known = {r["i"]: int(r["s"]) for r in each}
    return total, [known.get(i, 0) for i in range(width)]


def covariance(vectors: DataFrame, column: str, mean: np.ndarray, n: float) -> np.ndarray:
    """The covariance of the lists in ``column``, weighted by ``w``: each task centres its rows, multiplies, and hands on one matrix."""
    width = len(mean)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((width, width))
        for batch in batches:
            centred = matrix(batch.column(0), width).astype(np.float64) - mean
            own += (centred * batch.column(1).to_numpy()[:, None]).T @ centred
        if width:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(own.reshape(-1))], ["cell", "v"])

    products = vectors.select(F.col(column), "w").mapInArrow(multiply, "cell bigint, v double")
    out = np.zeros(width * width)
    for r in products.groupBy("cell").agg(F.sum("v").alias("v")).collect():  # dimensions squared, at any number of rows
        out[r["cell"]] = r["v"]
    return out.reshape(width, width) / max(n, 1)


def deviations(x: np.ndarray, n: int, total: list[int], most: int) -> list[int | None]:
    """Sums over dimensions of (n * x - S) squared, exact; None where 64 bits don't hold one."""
    bound = n * most + max(map(abs, total), default=0)
    if bound * bound * max(1, x.shape[1]) <= _LONG:
        moved = n * x.astype(np.int64) - np.array(total, np.int64)
        return (moved * moved).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, total, strict=True)) for row in x.tolist()]
    return [v if v <= _LONG else None for v in exact]


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, weights: str = "one", hot_share: float = HOT_SHARE) -> DataFrame:
    """A row for each kept row and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark = table.sparkSession
    ship_package(spark)
    vector = F.col(f"`{vector_col}`")
    own = table.where(sound(vector)).select(F.col(f"`{id_col}`").alias("id"), whole(vector).alias("x"))
    rows = own.select("id", text_digest(F.concat_ws(",", F.col("x").cast("array<string>"))).alias("digest"), "x")
    distinct = distinct_vectors(rows)
    _, width, most = widths(distinct)
    n, total = sums(distinct, width, weights)
    mean = np.array([s / n if n else 0.0 for s in total])
    weighted = distinct.withColumn("w", weight(weights).cast("double"))
    own_covariance = covariance(weighted, "x", mean, n)
    trace = float(np.trace(own_covariance))
    value, vectors = np.linalg.eigh(own_covariance)  # dimensions by dimensions
    kept = min(components, width)
    value, vectors = value[::-1][:kept], vectors[:, ::-1][:, :kept]
    sound_value = value > ROUNDING * trace
    basis = vectors / np.sqrt(np.where(sound_value, value, 1.0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width)
            z = (x.astype(np.float64) - mean) @ basis
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z.tolist(), pa.list_(pa.float64())), pa.array(deviations(x, n, total, most), pa.int64()), batch.column(2), batch.column(3)], ["digest", "z", "deviation", "copies", "w"])

    projected = weighted.select("digest", "x", "copies", "w").mapInArrow(project, "digest binary, z array<double>, deviation bigint, copies bigint, w double")
    white = materialize(projected, "whitened")
    centre = white.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.col("z")[k] * F.col("w")), F.lit(0.0)) for k in range(kept)]).first()[1:]
    again = covariance(white, "z", np.array(centre) / max(n, 1), n)[np.ix_(sound_value, sound_value)]
    error = float(np.abs(again - np.eye(len(again))).max()) if len(again) else None
    facts = [(k + 1, float(value[k] / trace) if trace else 0.0, bool(sound_value[k])) for k in range(kept)]
    per = F.array(*[F.struct(F.lit(k).cast("int").alias("component"), F.when(F.lit(ok), F.col("z")[k - 1]).alias("whitened"), F.lit(e).alias("explained")) for k, e, ok in facts])
    if not facts:
        per = F.array().cast("array<struct<component:int,whitened:double,explained:double>>")
    joined = joined_back(rows.select("id", "digest"), white, hot_share)
    return joined.select("id", F.explode(per).alias("c"), "deviation").select(
        F.col("id").alias(id_col), "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error")
    )


def joined_back(rows: DataFrame, white: DataFrame, hot_share: float) -> DataFrame:
    """``rows`` (id, digest) with the columns of ``white``: vectors of many rows by broadcast, the others by a shuffle of ids and digests."""
    values = white.select("digest", "z", "deviation", "copies")
    least = hot_share * (values.agg(F.sum("copies")).first()[0] or 0)
    hot, cold = values.where(F.col("copies") > least), values.where(F.col("copies") <= least)
    if hot.isEmpty():
        return rows.join(cold, "digest")
    mark = F.broadcast(hot.withColumn("hot", F.lit(True)))  # fewer than 1 / hot_share rows
    marked = rows.join(mark, "digest", "left")
    return marked.where("hot").drop("hot").unionByName(marked.where("hot IS NULL").select("id", "digest").join(cold, "digest"))
