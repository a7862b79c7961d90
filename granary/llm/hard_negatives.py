"""Hard-negative mining by best-first search in an R-tree that is packed by sorting and tiling.

The index. Rows are dealt out by ranges of (label, slab of the widest dimension, second widest dimension), so a partition is a tile: rows near
one another, mostly of one label. Each tile packs its rows into leaves by sorting and tiling over the dimensions that are widest in it, and stores
of each leaf the bounding box, so the index is a table of leaves. Within a tile, boxes of boxes make the upper levels.

The search. A query goes to each tile whose labels it may take. From a box, the inner product's interval follows coordinate by coordinate: each one adds
the lesser and the greater of the products with both sides. A queue takes the box with the highest end of its interval first; a box goes if its interval
misses all score windows, or if its end is strictly below the k-th score that every window has so far (an equal score may win by its id). What tiles find is
merged by (query, window), ``k`` rows a tile at most. Every row that can be in a result is looked at, so results are exact.

Two searches: an anchor's positives (same label, all scores), then its negatives (other labels, a window for each positive), all windows of an anchor at once.

What is bounded: a task holds one tile (``TILE_ROWS`` rows, about) and a batch of queries; nothing of the table goes to the driver but its counts and two
dimensions' numbers.

Edge cases: rows with a null label, a null vector or a component that is null or not finite take no part. A null id is no anchor, and comes last of equal
scores. Repeated rows are rows of their own: an anchor's copy can be its positive, and each copy of an anchor is an anchor. Shorter vectors count as filled up with zeros;
empty ones score 0. Of equal scores and ids any copy is taken, which the result cannot tell. Scores are exact in 64 bits; beyond that they wrap, as sums of longs do,
and no box is pruned. A positive score below zero leaves an empty window. Empty tables give empty results. Other columns are ignored, so names cannot clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import BROADCAST_ROWS, materialize, ship_package
from granary.llm.vectors import matrix, sound, whole, widths

#: Rows of a tile about, and at least if there are fewer tiles than tasks; rows of a leaf; boxes in a box.
TILE_ROWS, LEAST_TILE_ROWS, LEAF_ROWS, FANOUT = 32_768, 1_024, 128, 16
#: Negatives have a score from the first to the second of these percentages of the positive's.
LOW_PCT, HIGH_PCT = 30, 90
POSITIVES, NEGATIVES = 5, 10

_LAST_ID = (1 << 63) - 1
_EXACT = 1 << 53


def tile_count(rows: int, tasks: int) -> int:
    """Tiles of a bounded size; as many as there are tasks if they aren't too small then."""
    return max(1, -(-rows // TILE_ROWS), min(tasks, -(-rows // LEAST_TILE_ROWS)))


def widest(rows: DataFrame, n: int = 2) -> list[int]:
    """The numbers of the ``n`` dimensions of the largest variance; the lower one of equal ones."""
    each = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.var_pop("v").alias("spread"))
    return [r["i"] for r in each.orderBy(F.desc("spread"), "i").limit(n).collect()]


def str_order(x: np.ndarray, leaf_rows: int) -> np.ndarray:
    """An order of the rows in which each ``leaf_rows`` of them make a leaf: sort by the widest dimension, cut into slabs, and go on within each by the next one."""
    order = np.argsort(-x.astype(np.float64).var(axis=0), kind="stable") if len(x) else np.zeros(0, np.int64)
    dims = order[: max(1, min(len(order), int(np.log2(max(2, len(x) / leaf_rows)))))]

    def tiled(at: np.ndarray, k: int) -> np.ndarray:
        leaves = -(-len(at) // leaf_rows)
        if k == len(dims) or leaves < 2:
            return at
        at = at[np.argsort(x[at, dims[k]], kind="stable")]
        slabs = min(leaves, round(leaves ** (1 / (len(dims) - k)) + 0.5))
        step = -(-leaves // slabs) * leaf_rows
        return np.concatenate([tiled(at[i : i + step], k + 1) for i in range(0, len(at), step)])

    return tiled(np.arange(len(x)), 0)


def packed_tree(rows: DataFrame, n: int, width: int, most: int, tasks: int) -> DataFrame:
    """The leaves of all tiles, from (row, id, label, x): tile, leaf, their bounding box, least and greatest label, and the rows."""
    tiles, dims = tile_count(n, tasks), widest(rows)
    number = "int" if most < 1 << 31 else "bigint"
    keys: list[Column] = [F.col("label")]
    if dims:
        at = lambda i: F.coalesce(F.get("x", F.lit(i)), F.lit(0))
        slabs = max(1, round(tiles**0.5))
        cuts = rows.agg(F.percentile_approx(at(dims[0]), [k / slabs for k in range(1, slabs)] or [0.5], 10_000).alias("cuts"))
        rows = rows.crossJoin(F.broadcast(cuts))  # one row
        keys += [F.size(F.filter("cuts", lambda c: c <= at(dims[0]))), at(dims[-1])]
    dealt = rows.repartitionByRange(tiles, *keys, "id", "row").select("row", "id", "label", "x")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, parts = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
        if not parts:
            return
        row, ids, labels = (np.concatenate([b.column(i).to_numpy() for b in parts]) for i in range(3))
        x = np.concatenate([matrix(b.column(3), width) for b in parts])
        order = str_order(x, LEAF_ROWS)
        for leaf, begin in enumerate(range(0, len(order), LEAF_ROWS)):
            own = order[begin : begin + LEAF_ROWS]
            cells = {
                "tile": tile, "leaf": leaf, "label_lo": labels[own].min(), "label_hi": labels[own].max(), "box_lo": x[own].min(axis=0), "box_hi": x[own].max(axis=0),
                "rows": row[own], "ids": ids[own], "labels": labels[own], "x": x[own].reshape(-1),
            }
            yield pa.RecordBatch.from_pylist([cells], schema=leaf_schema)

    lists = pa.list_(pa.int32() if number == "int" else pa.int64())
    kinds = {"tile": pa.int32(), "leaf": pa.int32(), "label_lo": pa.int64(), "label_hi": pa.int64(), "box_lo": lists, "box_hi": lists, "rows": pa.list_(pa.int64()), "ids": pa.list_(pa.int64()), "labels": pa.list_(pa.int64()), "x": lists}
    leaf_schema = pa.schema(list(kinds.items()))
    sql = f"tile int, leaf int, label_lo bigint, label_hi bigint, box_lo array<{number}>, box_hi array<{number}>, rows array<bigint>, ids array<bigint>, labels array<bigint>, x array<{number}>"
    return materialize(dealt.mapInArrow(pack, sql), "rtree")


class Tile:
    """The tree over a tile's leaves: nodes level by level, leaves first, the root last."""

    def __init__(self, leaves: list[dict], width: int, most: int):
        self.exact = width * most * most < _EXACT
        self.number = np.float64 if self.exact else np.int64
        self.rows, self.ids, self.labels = ([np.asarray(x[c], np.int64) for x in leaves] for c in ("rows", "ids", "labels"))
        self.x = [np.asarray(x["x"]).reshape(-1, width).astype(self.number) for x in leaves]
        level = [np.array([x[c] for x in leaves], np.float64).reshape(len(leaves), width) for c in ("box_lo", "box_hi")]
        labels = [np.array([x[c] for x in leaves], np.int64) for c in ("label_lo", "label_hi")]
        lows, highs, label_lo, label_hi = [level[0]], [level[1]], [labels[0]], [labels[1]]
        self.children: list[range | None] = [None] * len(leaves)
        below = 0
        while len(lows[-1]) > 1:
            starts = np.arange(0, len(lows[-1]), FANOUT)
            self.children += [range(below + s, below + min(s + FANOUT, len(lows[-1]))) for s in starts]
            below += len(lows[-1])
            for parts, least in ((lows, np.minimum), (highs, np.maximum), (label_lo, np.minimum), (label_hi, np.maximum)):
                parts.append(least.reduceat(parts[-1], starts, axis=0))
        self.lo, self.hi, self.label_lo, self.label_hi = (np.concatenate(p) for p in (lows, highs, label_lo, label_hi))

    def intervals(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest inner product of each query with any point of each node's box."""
        up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
        least, most = up @ self.lo.T + down @ self.hi.T, up @ self.hi.T + down @ self.lo.T
        if not self.exact:  # room for rounding; without bounds where a score may wrap
            reach = (up - down) @ np.maximum(np.abs(self.lo), np.abs(self.hi)).T
            room = np.where(reach < 2.0**62, reach * 1e-9 + 1, np.inf)
            least, most = least - room, most + room
        return least, most

    def search(self, query: np.ndarray, least: np.ndarray, most: np.ndarray, label: int, same: bool, own_row: int, windows: list[tuple[float, float]], k: int) -> list[tuple]:
        """(scores, ids, rows) of the first ``k`` rows in each window, by falling score, then by id."""
        found = [(np.zeros(0, np.int64),) * 3 for _ in windows]
        needs = [low for low, _ in windows]  # the least score that still counts, for each window
        top = max(high for _, high in windows)
        fits = (self.label_lo <= label) & (label <= self.label_hi) if same else (self.label_lo != label) | (self.label_hi != label)
        root = len(self.children) - 1
        queue = [(-most[root], root)]
        while queue:
            end, node = heapq.heappop(queue)
            if -end < min(needs):
                break  # no box that is left reaches any window's k-th score
            if not fits[node] or least[node] > top:
                continue
            if self.children[node] is not None:
                for child in self.children[node]:
                    heapq.heappush(queue, (-most[child], child))
                continue
            scores = (self.x[node] @ query).astype(np.int64)
            labels = self.labels[node]
            right = (labels == label) & (self.rows[node] != own_row) if same else labels != label
            right &= (scores >= min(needs)) & (scores <= top)
            at = np.flatnonzero(right)
            if not len(at):
                continue
            for j, (_, high) in enumerate(windows):
                here = at[(scores[at] >= needs[j]) & (scores[at] <= high)]
                if len(here):
                    both = [np.concatenate(p) for p in zip(found[j], (scores[here], self.ids[node][here], self.rows[node][here]), strict=True)]
                    best = np.lexsort((both[2], both[1], -both[0]))[:k]
                    found[j] = tuple(p[best] for p in both)
                    if len(best) == k:
                        needs[j] = max(needs[j], int(found[j][0][-1]))
        return found


def nearest(tree: DataFrame, asks: DataFrame, same: bool, k: int, width: int, most: int, tasks: int) -> DataFrame:
    """(key, j, score, id, row): the first ``k`` rows of each tile in each window ``j`` of each query in ``asks`` (key, label, x, bounds)."""
    spans = tree.groupBy("tile").agg(F.min("label_lo").alias("from_label"), F.max("label_hi").alias("to_label"))
    spans = materialize(spans, "tiles")
    n_tiles = spans.count()
    if n_tiles <= BROADCAST_ROWS:
        may = (F.col("from_label") <= F.col("label")) & (F.col("label") <= F.col("to_label")) if same else (F.col("from_label") != F.col("label")) | (F.col("to_label") != F.col("label"))
        routed = asks.join(F.broadcast(spans), may).drop("from_label", "to_label")
    else:  # the same without the labels: to every tile
        routed = asks.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tree.agg(F.max("tile")).first()[0]))))
    number = dict(tree.dtypes)["x"]
    routed = routed.select("tile", F.lit(-1).alias("leaf"), "key", "label", F.col("x").cast(number).alias("x"), "bounds")
    stream = tree.unionByName(routed, allowMissingColumns=True).repartition(max(1, min(n_tiles, 4 * tasks)), "tile")
    stream = stream.sortWithinPartitions("tile", F.desc("leaf")).select(*tree.columns, "key", "label", "bounds")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves: list[dict] = []
        number, tile = None, None
        for batch in batches:
            tiles, is_ask = batch.column("tile").to_numpy(), batch.column("leaf").to_numpy() < 0
            edges = [0, *(np.flatnonzero((np.diff(tiles) != 0) | np.diff(is_ask)) + 1).tolist(), len(tiles)]
            for begin, end in zip(edges, edges[1:], strict=False):
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                if tiles[begin] != number:
                    leaves, number, tile = [], tiles[begin], None
                if not is_ask[begin]:
                    names = ("label_lo", "label_hi", "box_lo", "box_hi", "rows", "ids", "labels", "x")
                    values = {c: part.column(c) for c in names}
                    leaves += [{c: v[i].as_py() if c.startswith("label_") else v[i].values.to_numpy() for c, v in values.items()} for i in range(part.num_rows)]
                    continue
                if tile is None:
                    if not leaves:
                        continue
                    tile, leaves = Tile(leaves, width, most), []
                queries = matrix(part.column("x"), width)
                least, greatest = tile.intervals(queries)
                out: dict[str, list] = {c: [] for c in ("key", "j", "score", "id", "row")}
                for i, (key, label, bounds) in enumerate(zip(part.column("key").to_pylist(), part.column("label").to_pylist(), part.column("bounds").to_pylist(), strict=True)):
                    windows = [(b["low"], b["high"]) for b in bounds]
                    own = tile.search(queries[i].astype(tile.number), least[i], greatest[i], label, same, key, windows, k)
                    for j, (scores, ids, rows) in enumerate(own):
                        for c, v in (("key", [key] * len(scores)), ("j", [j] * len(scores)), ("score", scores.tolist()), ("id", ids.tolist()), ("row", rows.tolist())):
                            out[c] += v
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if c == "j" else pa.int64()) for c, v in out.items()], list(out))

    return stream.mapInArrow(search, "key bigint, j int, score bigint, id bigint, row bigint")


def first_of(found: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The first ``k`` rows of each group over all tiles, with their ``place`` from 1. Tasks hand on ``k`` rows of a group at most."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id", "row"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def hard_negatives(
    table: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low_pct: int = LOW_PCT, high_pct: int = HIGH_PCT,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchor`` (a condition on the id, named ``id``) holds."""
    spark = table.sparkSession
    ship_package(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vector = F.col(f"`{vector_col}`")
    taken = table.where(sound(vector) & F.col(f"`{label_col}`").isNotNull())
    own = taken.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), whole(vector).alias("x"))
    numbered = own.select(F.monotonically_increasing_id().alias("row"), F.coalesce("id", F.lit(_LAST_ID)).alias("id"), "label", "x", F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = materialize(numbered, "vectors")
    n, width, most = widths(rows)
    tree = packed_tree(rows.drop("anchor"), n, width, most, tasks)
    anchors = rows.where("anchor").select(F.col("row").alias("key"), F.col("id").alias("anchor_id"), "label", "x")
    everything = F.array(F.struct(F.lit(-(1 << 63)).alias("low"), F.lit((1 << 63) - 1).alias("high")))
    near = first_of(nearest(tree, anchors.select("key", "label", "x", everything.alias("bounds")), True, positives, width, most, tasks), positives, ["key"])
    near = materialize(near.select("key", (F.col("place") - 1).alias("j"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    share = lambda pct, to: to(F.col("positive_score").cast("decimal(20,0)") * pct / 100).cast("long")
    window = F.struct("j", share(low_pct, F.ceil).alias("low"), share(high_pct, F.floor).alias("high"))
    windows = near.groupBy("key").agg(F.array_sort(F.collect_list(window)).alias("bounds"))  # ``positives`` entries at most
    asks = anchors.join(windows, "key").select("key", "label", "x", F.transform("bounds", lambda b: F.struct(b["low"].alias("low"), b["high"].alias("high"))).alias("bounds"))
    far = first_of(nearest(tree, asks, False, negatives, width, most, tasks), negatives, ["key", "j"])
    shown = lambda c: F.when(F.col(c) != _LAST_ID, F.col(c)).alias(c)
    named = far.select("key", "j", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(near, ["key", "j"]).join(anchors.select("key", "anchor_id"), "key")
    return named.select("anchor_id", shown("positive_id"), "rank", shown("negative_id"), "positive_score", "negative_score")
