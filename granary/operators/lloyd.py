"""K-Means for many numbers of clusters and many variants of the points at once.

All runs share their passes: a pass takes each point to its nearest center of every run that still moves, and one aggregation gives the sums of all clusters of
all runs. Runs start from a farthest-first traversal, which is the same for all of them: the first k of its points are the start of the run with k clusters.

Coordinates lie on a grid of ``GRID`` steps to the unit and are whole numbers there, so sums are exact, centers don't depend on the order of rows or on
partitions, and a run can be repeated anywhere. Distances are in the points' own units in all results. Clusters are numbered by their centers.

The driver holds the centers: runs x clusters x dimensions. Points are read once into blocks of a few hundred, which are written; a pass reads these and never gathers
them; distances are taken in Arrow batches, and a task hands on a row for each cluster of each run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.ship import ship_code
from granary.functions.small import small_table
from granary.sources.scratch import materialize

GRID = 1_000_000
MAX_ITER, TOLERANCE = 100, 1e-4


@dataclass(frozen=True)
class Run:
    """One number of clusters of one variant: its centers on the grid, by cluster, and how the fit ended."""

    variant: str
    k: int
    centers: tuple[tuple[float, ...], ...]
    iterations: int = 0
    converged: bool = False


def on_grid(table: DataFrame, key: str, columns: list[str], variant: str = "", more: list[str] | None = None) -> DataFrame:
    """(variant, key, x, more...): the points' coordinates as whole numbers of grid steps, and columns that stay as they are."""
    steps = [F.round(F.col(c).cast("double") * GRID).cast("long") for c in columns]
    return table.select(F.lit(variant).alias("variant"), F.col(key).alias("key"), F.array(*steps).alias("x"), *(more or []))


#: Points that are summed at once: so few that sums of 32-bit halves, and of values below ``SHORT``, are exact as doubles.
SLICE, SHORT = 1 << 16, 1 << 37
#: Bytes of coordinates in a block of points: a batch of ten thousand blocks is still small beside a task's memory.
BLOCK = 1 << 13


def _by_variant(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch, np.ndarray]]:
    """(variant, its rows, their points' coordinates as dimensions x points) of each batch; a row is a point, or a block of :func:`packed`. A missing coordinate is an error."""
    for whole in batches:
        blocks = not hasattr(whole.schema.field("x").type, "value_type")
        step = SLICE // (BLOCK // 8) if blocks else SLICE
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            for variant in pc.unique(batch.column("variant")).to_pylist():
                own = batch.filter(pc.equal(batch.column("variant"), variant))
                x = own.column("x")
                if blocks:
                    points = np.frombuffer(b"".join(x.to_pylist()), np.int64).reshape(pc.sum(own.column("n")).as_py(), -1)
                else:
                    cells = x.flatten()
                    if x.null_count or cells.null_count:
                        raise ValueError("a point lacks coordinates")
                    points = cells.to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
                yield variant, own, np.ascontiguousarray(points.T)


def _in_blocks(points: DataFrame) -> bool:
    return isinstance(points.schema["x"].dataType, T.BinaryType)


def packed(points: DataFrame) -> DataFrame:
    """(variant, n, keys, x): the points in blocks, written: n keys, and the bytes of n times the coordinates. A pass over blocks costs little beside one over rows."""
    ship_code(points.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for variant, own, x in _by_variant(batches):
            size, rows = max(1, BLOCK // (8 * len(x))), np.ascontiguousarray(x.T, np.int64)
            ends = [*range(0, own.num_rows, size), own.num_rows]
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), own.column("key"))
            columns = [pa.array([variant] * len(keys), pa.string()), pa.array(np.diff(ends).astype(np.int32)), keys, pa.array([rows[a:b].tobytes() for a, b in pairwise(ends)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["variant", "n", "keys", "x"])

    kinds = points.schema
    schema = T.StructType([kinds["variant"], T.StructField("n", T.IntegerType()), T.StructField("keys", T.ArrayType(kinds["key"].dataType)), T.StructField("x", T.BinaryType())])
    return materialize(points.select("variant", "key", "x").mapInArrow(pack, schema), "blocks")


def _distances(x: np.ndarray, centers: tuple[tuple[float, ...], ...]) -> np.ndarray:
    """Squared distances, centers x points, added up dimension by dimension."""
    own = x.astype(np.float64)
    out = np.zeros((len(centers), own.shape[1]))
    for d, center in zip(out, centers, strict=True):
        for v, c in zip(own, center, strict=True):
            away = v - c
            d += away * away
    return out


def _least(blocks: DataFrame, score: Callable[[str, np.ndarray], np.ndarray]) -> dict[str, tuple[float, ...]]:
    """{variant: point} with the least score, of equal ones the one with the least key. A batch hands on its points with the least score only."""
    ship_code(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for variant, own, x in _by_variant(batches):
            d = score(variant, x)
            best = np.flatnonzero(d == d.min())
            keys, cells = own.column("keys").flatten().take(pa.array(best)), pa.array(list(x[:, best].T), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([variant] * len(best), pa.string()), pa.array(d[best]), keys, cells], names=["variant", "d", "key", "x"])

    kinds = blocks.schema
    schema = T.StructType([kinds["variant"], T.StructField("d", T.DoubleType()), T.StructField("key", kinds["keys"].dataType.elementType), T.StructField("x", T.ArrayType(T.LongType()))])
    found = blocks.mapInArrow(run, schema).groupBy("variant").agg(F.min(F.struct("d", "key", "x")).alias("s"))
    return {r["variant"]: tuple(map(float, r["s"]["x"])) for r in found.collect()}  # a row for each variant


def farthest_first(points: DataFrame, k: int) -> dict[str, list[tuple[float, ...]]]:
    """{variant: k points}: the point nearest the origin, then always the one farthest from those taken; ties go to the lesser key. A pass for each."""
    blocks = points if _in_blocks(points) else packed(points)
    taken = {v: [x] for v, x in _least(blocks, lambda _, x: _distances(x, ((0.0,) * len(x),))[0]).items()}
    for _ in range(k - 1):
        for v, x in _least(blocks, lambda v, x: -_distances(x, taken[v]).min(axis=0)).items():
            taken[v].append(x)
    return taken


def assigned(points: DataFrame, runs: list[Run]) -> DataFrame:
    """(variant, k, key, x, cluster, d, ...): each point in each run, with its nearest center (the first of equal ones), the squared distance on the grid, and other columns as they are."""
    ship_code(points.sparkSession)
    more = [c for c in points.columns if c not in ("variant", "key", "x")]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for variant, own, x in _by_variant(batches):
            for r in runs:
                if r.variant == variant:
                    ds = _distances(x, r.centers)
                    columns = {
                        "variant": own.column("variant"), "k": pa.array(np.full(own.num_rows, r.k, np.int32)), "key": own.column("key"), "x": own.column("x"),
                        "cluster": pa.array(ds.argmin(axis=0).astype(np.int32)), "d": pa.array(ds.min(axis=0)),
                    } | {c: own.column(c) for c in more}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kinds = points.schema
    made = [T.StructField("k", T.IntegerType()), T.StructField("cluster", T.IntegerType()), T.StructField("d", T.DoubleType())]
    schema = T.StructType([kinds["variant"], made[0], kinds["key"], kinds["x"], *made[1:], *[kinds[c] for c in more]])
    return points.mapInArrow(nearest, schema)


@dataclass
class Facts:
    """What a run's cluster holds: points, sums of their coordinates (exact), their squared lengths and squared distances to the center, on the grid."""

    n: int
    sums: list[int]
    squares: float
    d: float


def _sums(points: DataFrame, runs: list[Run]) -> dict[tuple[str, int], dict[int, Facts]]:
    """One pass over points or blocks for all runs: {(variant, k): {cluster: facts}}. A task adds up its points and hands on a row for each cluster of each run."""
    ship_code(points.sparkSession)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], Facts] = {}
        for variant, _, x in _by_variant(batches):
            parts = [[(0, v)] if -SHORT < v.min() and v.max() < SHORT else [(32, v >> 32), (0, v & 0xFFFFFFFF)] for v in x]
            parts, squares = [[(by, w.astype(np.float64)) for by, w in own] for own in parts], _distances(x, ((0.0,) * len(x),))[0]
            for i, r in enumerate(runs):
                if r.variant != variant:
                    continue
                ds = _distances(x, r.centers)
                cluster, most = ds.argmin(axis=0), len(r.centers)
                of = lambda w, c=cluster, m=most: np.bincount(c, weights=w, minlength=m)
                n, sq, d, sums = np.bincount(cluster, minlength=most), of(squares), of(ds.min(axis=0)), [[(by, of(w)) for by, w in own] for own in parts]
                for c in np.flatnonzero(n):
                    own = found.setdefault((i, int(c)), Facts(0, [0] * len(x), 0.0, 0.0))
                    own.n, own.squares, own.d = own.n + int(n[c]), own.squares + float(sq[c]), own.d + float(d[c])
                    own.sums = [s + sum(int(w[c]) << by for by, w in one) for s, one in zip(own.sums, sums, strict=True)]
        rows = [{"run": i, "cluster": c, "n": f.n, "squares": f.squares, "d": f.d, **{f"s{j}": Decimal(s) for j, s in enumerate(f.sums)}} for (i, c), f in found.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    width = len(runs[0].centers[0])
    kinds = [("run", pa.int32()), ("cluster", pa.int32()), ("n", pa.int64()), ("squares", pa.float64()), ("d", pa.float64()), *[(f"s{j}", pa.decimal128(38, 0)) for j in range(width)]]
    schema = "run int, cluster int, n bigint, squares double, d double, " + ", ".join(f"s{j} decimal(38,0)" for j in range(width))
    parts = points.select("variant", *(["n"] if _in_blocks(points) else []), "x").mapInArrow(add, schema).groupBy("run", "cluster")
    out: dict[tuple[str, int], dict[int, Facts]] = {}
    for r in parts.agg(*[F.sum(c).alias(c) for c in ("n", "squares", "d", *[f"s{j}" for j in range(width)])]).collect():  # a row for each cluster of each run
        run = runs[r["run"]]
        out.setdefault((run.variant, run.k), {})[r["cluster"]] = Facts(r["n"], [int(r[f"s{j}"]) for j in range(width)], r["squares"], r["d"])
    return out


def fit(points: DataFrame, ks: list[int], max_iter: int = MAX_ITER, tolerance: float = TOLERANCE) -> list[Run]:
    """All runs of all variants, iterated until no center moves more than ``tolerance``. ``points`` are read once, into blocks; each pass reads these.

    A center without points stays where it is. Fewer points than centers give equal centers, of which the first takes all.
    """
    blocks = packed(points)
    starts = farthest_first(blocks, max(ks))
    if not starts:
        raise ValueError("there are no points to cluster")
    runs = {(v, k): Run(v, k, tuple(c[:k])) for v, c in starts.items() for k in ks}
    limit = (tolerance * GRID) ** 2
    for _ in range(max_iter):
        moving = [r for r in runs.values() if not r.converged]
        if not moving:
            break
        sums = _sums(blocks, moving)
        for r in moving:
            own = sums[r.variant, r.k]
            centers = tuple(tuple(s / own[i].n for s in own[i].sums) if i in own else c for i, c in enumerate(r.centers))
            moved = max(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for x, y in zip(centers, r.centers, strict=True))
            runs[r.variant, r.k] = Run(r.variant, r.k, centers, r.iterations + 1, moved <= limit)
    return [Run(r.variant, r.k, tuple(sorted(r.centers)), r.iterations, r.converged) for r in runs.values()]


def model_table(spark: SparkSession, runs: list[Run], version: str) -> DataFrame:
    """(version, variant, k, cluster, center): the model of these runs as a table, in the points' units; :func:`from_table` reads it back."""
    rows = [(version, r.variant, r.k, i, [x / GRID for x in c]) for r in runs for i, c in enumerate(r.centers)]
    return small_table(spark, {"version": "string", "variant": "string", "k": "int", "cluster": "int", "center": pa.list_(pa.float64())}, rows)


def from_table(model: DataFrame, version: str) -> list[Run]:
    """The runs of a stored version; a version that isn't there is an error."""
    centers: dict[tuple[str, int], dict[int, tuple[float, ...]]] = {}
    for r in model.where(F.col("version") == version).collect():  # a row for each cluster
        centers.setdefault((r["variant"], r["k"]), {})[r["cluster"]] = tuple(x * GRID for x in r["center"])
    if not centers:
        raise KeyError(version)
    return [Run(v, k, tuple(c[i] for i in sorted(c))) for (v, k), c in centers.items()]


def clusters(points: DataFrame, runs: list[Run], known: dict[tuple[str, int], dict[int, Facts]] | None = None) -> DataFrame:
    """(variant, k, cluster, n, cost, center): a row for each cluster that has points; costs and centers in the points' units. ``known``: the runs' facts, if there already."""
    found = _sums(points, runs) if known is None else known
    rows = [(r.variant, r.k, i, f.n, f.d / float(GRID) ** 2, [x / GRID for x in r.centers[i]]) for r in runs for i, f in sorted(found.get((r.variant, r.k), {}).items())]
    return small_table(points.sparkSession, {"variant": "string", "k": "int", "cluster": "int", "n": "long", "cost": "double", "center": pa.list_(pa.float64())}, rows)


def _scores(x: np.ndarray, centers: tuple[tuple[float, ...], ...], facts: dict[int, Facts]) -> np.ndarray:
    """The silhouette of each point of a run, from the facts of its clusters."""
    own, p = _distances(x, centers).argmin(axis=0), x / GRID
    squares = np.zeros(p.shape[1])
    for v in p:
        squares += v * v
    a, b = np.zeros(len(squares)), np.full(len(squares), np.inf)
    for i, f in facts.items():
        mixed = np.zeros(len(squares))
        for v, s in zip(p, f.sums, strict=True):
            mixed += v * (s / GRID)
        total = np.maximum(f.n * squares + f.squares / float(GRID) ** 2 - 2 * mixed, 0.0)
        mine = own == i
        a[mine] = total[mine] / (f.n - 1) if f.n > 1 else np.inf  # alone: no score
        b = np.where(mine, b, np.minimum(b, total / f.n))
    most = np.maximum(a, b)
    return np.where(np.isfinite(most) & (most > 0), (b - a) / np.where(np.isfinite(most) & (most > 0), most, 1.0), 0.0)


def silhouettes(points: DataFrame, runs: list[Run], known: dict[tuple[str, int], dict[int, Facts]] | None = None) -> DataFrame:
    """(variant, k, silhouette): the mean over all points, with squared Euclidean distances; a point alone in its cluster scores 0.

    Means of squared distances to a cluster follow from its size, its sums and its sum of squares, so this takes two passes for all runs, one if their facts are ``known``.
    """
    found = _sums(points, runs) if known is None else known

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for variant, _, x in _by_variant(batches):
            for i, r in enumerate(runs):
                if r.variant == variant:
                    with np.errstate(invalid="ignore"):
                        s = _scores(x, r.centers, found[r.variant, r.k])
                    own = sums.setdefault(i, [0, 0.0])
                    own[0], own[1] = own[0] + len(s), own[1] + float(s.sum())
        yield pa.RecordBatch.from_arrays([pa.array([runs[i].variant for i in sums], pa.string()), pa.array([runs[i].k for i in sums], pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([s for _, s in sums.values()], pa.float64())], names=["variant", "k", "n", "s"])

    parts = points.select("variant", "x").mapInArrow(score, "variant string, k int, n bigint, s double")
    return parts.groupBy("variant", "k").agg((F.sum("s") / F.sum("n")).alias("silhouette"))


def sweep(points: DataFrame, runs: list[Run], features: DataFrame, names: list[str], key: str) -> DataFrame:
    """(variant, k, cluster, n, pct, least_n, cost, iterations, converged, silhouette, mean_<name>...): every cluster of every run, with the means of its own features.

    Run's figures (the size of its smallest cluster, cost, iterations, silhouette) are the same in all of its rows.
    """
    known = _sums(points, runs)
    sizes = clusters(points, runs, known)
    scores = materialize(silhouettes(points, runs, known), "scores")
    measured = points.join(features.select(F.col(key).alias("key"), *names), "key")  # before each point becomes a row for each run
    means = assigned(measured, runs).groupBy("variant", "k", "cluster").agg(*[F.avg(F.col(n).cast("double")).alias(f"mean_{n}") for n in names])
    totals = sizes.groupBy("variant", "k").agg(F.sum("n").alias("all"), F.min("n").alias("least_n"), F.sum("cost").alias("total_cost"))  # a row for each run
    ended = small_table(points.sparkSession, {"variant": "string", "k": "int", "iterations": "int", "converged": "boolean"}, [(r.variant, r.k, r.iterations, r.converged) for r in runs])
    joined = sizes.drop("center", "cost").join(means, ["variant", "k", "cluster"])
    for part in (totals, scores, ended):
        joined = joined.join(F.broadcast(part), ["variant", "k"])
    return joined.select("variant", "k", "cluster", "n", (100 * F.col("n") / F.col("all")).alias("pct"), "least_n", F.col("total_cost").alias("cost"), "iterations", "converged", "silhouette", *[f"mean_{n}" for n in names])
