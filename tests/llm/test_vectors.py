"""Hard negatives and whitening (12, 13)."""

import math
import random

import numpy as np
import pytest
from compare import same_rows
from helpers import rows_of
from pyspark.sql import functions as F

from granary.llm import hard_negatives, whitening
from granary.llm.queries import oracle_sql, queries

SCHEMA = "vec_id long, embedding array<float>, label int, row string, x string, digest string, tile int, key int, copies int"


def table(spark, rows):
    """(vec_id, embedding, label) with columns whose names the operators use too."""
    return spark.createDataFrame([(*r, "r", "x", "d", 1, 2, 3) for r in rows], SCHEMA)


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def whole(v, scale=256):
    return [math.floor(scale * float(np.float32(c))) for c in v]


def mined(rows, every=100, positives=5, negatives=10):
    """Plain Python: sorted rows of the result."""
    own = [(i, label, whole(v)) for i, v, label in rows if label is not None and usable(v)]
    by_id = lambda i: (i is None, i)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (anchor, label, x) in enumerate(own):
        if anchor is None or anchor % every:
            continue
        scored = [(dot(x, y), i, k, other) for k, (i, other, y) in enumerate(own) if k != a]
        order = lambda s: (-s[0], by_id(s[1]), s[2])
        for p, pid, _, _ in sorted((s for s in scored if s[3] == label), key=order)[:positives]:
            wanted = sorted((s for s in scored if s[3] != label and 30 * p <= 100 * s[0] <= 90 * p), key=order)[:negatives]
            out += [(anchor, pid, k, nid, p, n) for k, (n, nid, _, _) in enumerate(wanted, 1)]
    return sorted(out, key=repr)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mine(df, every=100, **more):
    return rows_of(hard_negatives.hard_negatives(df, F.col("id") % every == 0, **more), *COLUMNS)


def test_op12_query_equals_sql(spark, duck, sf_dir):
    same_rows(queries()["op12_hard_negatives"](spark, sf_dir), duck, oracle_sql()["op12_hard_negatives"])


def test_op12_on_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0.3, 1) for _ in range(4)], rng.randrange(3)) for i in range(150)]
    rows += [(i, rows[i][1], rows[i][2]) for i in range(0, 60, 3)]  # copies, of anchors too
    rows += [(200, None, 1), (201, [1.0, None, 1.0, 1.0], 1), (202, [1.0, float("nan"), 1.0, 1.0], 1), (203, [float("inf"), 1.0, 1.0, 1.0], 1), (204, [1.0, 1.0, 1.0, 1.0], None)]
    rows += [(None, [2.0, 2.0, 2.0, 2.0], 1), (None, [2.0, 2.0, 2.0, 2.0], 2), (205, [], 1), (206, [1.0], 2), (207, [0.0] * 4, 0), (210, [0.5] * 4, 77)]
    rows += [(300 + i, [1.0, 1.0, 1.0, 1.0], i % 2) for i in range(120)]  # ties
    rng.shuffle(rows)
    assert mine(table(spark, rows), every=10) == mined(rows, every=10)
    assert mine(table(spark, []), every=10) == []
    assert mine(table(spark, [(0, [1.0], 1)]), every=10) == []


def test_many_small_tiles_and_leaves(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST_TILE_ROWS", 10)
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 40)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0.5 * (i % 3), 0.4) for _ in range(6)], 0 if i % 3 else rng.randrange(4)) for i in range(600)]  # a hot label
    assert mine(table(spark, rows), every=20, positives=3, negatives=4) == mined(rows, 20, 3, 4)
    monkeypatch.setattr(hard_negatives, "BROADCAST_ROWS", 0)
    assert mine(table(spark, rows), every=20, positives=3, negatives=4) == mined(rows, 20, 3, 4)


def test_large_numbers_stay_exact(spark):
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-4e5, 4e5) for _ in range(8)], i % 2) for i in range(60)]
    assert mine(table(spark, rows), every=10) == mined(rows, every=10)


def test_packing_keeps_all_rows_and_boxes_prune():
    rng = np.random.default_rng(3)
    x = rng.integers(-100, 100, (1000, 5))
    order = hard_negatives.str_order(x, 16)
    assert sorted(order.tolist()) == list(range(1000))
    leaves = [{"label_lo": 0, "label_hi": 0, "box_lo": x[o].min(0), "box_hi": x[o].max(0), "rows": o, "ids": o, "labels": o * 0, "x": x[o].reshape(-1)} for o in np.split(order, range(16, 1000, 16))]
    tile = hard_negatives.Tile(leaves, 5, 128)
    queries = rng.integers(-100, 100, (20, 5)).astype(float)
    least, most = tile.intervals(queries)
    visited = []
    for q, lo, hi in zip(queries, least, most, strict=True):
        scores = (x @ q).astype(int)
        seen = [scores[o] for o in np.split(order, range(16, 1000, 16))]
        assert all(lo[k] <= s.min() and s.max() <= hi[k] for k, s in enumerate(seen))
        tile.x = [Counted(v, visited) for v in tile.x]
        (found,) = tile.search(q, lo, hi, 1, False, -1, [(-math.inf, math.inf)], 7)
        assert found[1].tolist() == np.lexsort((np.arange(1000), -scores))[:7].tolist()
    assert len(visited) < 20 * len(leaves) / 2


class Counted:
    """A matrix that notes when it is multiplied."""

    def __init__(self, x, visited):
        self.x, self.visited = getattr(x, "x", x), visited

    def __matmul__(self, q):
        self.visited.append(1)
        return self.x @ q


def whitened(rows, components=4, weights="one"):
    """Plain numpy: n, {id: deviation}, |whitened| by row, explained."""
    own = [(i, whole(v)) for i, v, _ in rows if usable(v)]
    width = max((len(v) for _, v in own), default=0)
    own = [(i, v + [0] * (width - len(v))) for i, v in own]
    different = sorted({tuple(v) for _, v in own})
    count = {v: 1 if weights == "one" else sum(tuple(x) == v for _, x in own) for v in different}
    n = sum(count.values())
    x, w = np.array(different, float), np.array([count[v] for v in different], float)
    mean = (x * w[:, None]).sum(0) / n
    e, v = np.linalg.eigh(((x - mean) * w[:, None]).T @ (x - mean) / n)
    e, v = e[::-1], v[:, ::-1]
    total = [sum(count[d] * d[i] for d in different) for i in range(width)]
    out = []
    for i, row in own:
        z = (np.array(row) - mean) @ v[:, :components] / np.sqrt(e[:components])
        dev = sum((n * a - s) ** 2 for a, s in zip(row, total, strict=True))
        out += [(i, k + 1, n, dev, round(abs(float(z[k])), 6), round(float(e[k] / e.sum()), 9)) for k in range(min(components, width))]
    return sorted(out, key=repr)


def found_white(df, **more):
    rows = whitening.whiten(df, **more).collect()
    assert all(r["identity_error"] <= 1e-6 for r in rows)
    signs = {}
    return sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 6), round(r["explained"], 9)) for r in rows), key=repr), signs


def test_op13_query_equals_numpy(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = queries()["op13_whitening"](spark, sf_dir)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    own = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 6), round(r["explained"], 9)) for r in found.collect()), key=repr)
    assert own == whitened(rows)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_op13_on_odd_rows(spark, weights):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1 + k) for k in range(5)], 1) for i in range(80)]
    rows += [(500 + i, [0.25, 0.5, 0.5, -1.0, 0.125], 1) for i in range(60)]  # one vector with over a third of the rows
    rows += [(900, [0.25 + 1e-4, 0.5, 0.5, -1.0, 0.125], 1), (901, None, 1), (902, [None] * 5, 1), (903, [float("nan")] * 5, 1), (904, [float("-inf"), 0.0, 0.0, 0.0, 0.0], 1)]
    rows += [(None, [1.0] * 5, None), (None, [1.0] * 5, None), (1, rows[1][1], 2), (905, [3.0], 1), (906, [], 1)]
    own, _ = found_white(table(spark, rows), weights=weights)
    assert own == whitened(rows, weights=weights)
    again, _ = found_white(table(spark, rows), weights=weights, hot_share=2.0)
    assert again == own


def test_one_sign_for_all_rows(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 3), rng.gauss(0, 2), rng.gauss(0, 1)], 1) for i in range(50)]
    z = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whiten(table(spark, rows)).collect()}
    assert {k for _, k in z} == {1, 2, 3}
    for k in (1, 2, 3):
        assert abs(sum(z[i, k] for i in range(50))) < 1e-9
        assert sum(z[i, k] ** 2 for i in range(50)) / 50 == pytest.approx(1)


def test_op13_without_spread_or_rows(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    rows = whitening.whiten(table(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(rows)] == [(i, k, 1, 0, None, 0.0, None) for i in (1, 2) for k in (1, 2)]
    flat = whitening.whiten(table(spark, [(1, [1.0, 2.0], 0), (2, [3.0, 2.0], 0)])).collect()
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True)}
    huge = whitening.whiten(table(spark, [(1, [3e38], 0), (2, [0.0], 0)])).collect()
    assert {r["deviation"] for r in huge} == {None}
    with pytest.raises(ValueError):
        whitening.whiten(table(spark, []), weights="none")
