"""Exact order statistics of many groups at once, by counting.

Equal values are counted first, so all else sees each different value of a group once. All ranks that are wanted, of all groups, are narrowed together. Each round
is one aggregation: it counts the values of each group between the splitters of its open ranges, and sketches each part (a few hundred entries) for the splitters
of the next round. A range that holds a wanted rank is cut into some thirty parts of about as many different values a round, so ranges shrink by that factor whatever
the values are like. Parts of ``SMALL`` different values or fewer are sorted, each in one task, and the value is read off; groups that have no more need no round.

Nothing is ranked in a window, no group is gathered, and the driver sees a few numbers for each open range. Groups are few: features, clusters, months.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.small import small_table
from granary.sources.scratch import materialize

#: Parts that a range is cut into; entries of a sketch; different values that a task may sort.
PARTS, SKETCH, SMALL = 32, 500, 10_000


def rank_of(share: float, n: int) -> int:
    """The rank, from 1, of a quantile: the least one that ``share`` of ``n`` values don't exceed. Exact in the share's decimals."""
    return max(1, -(-(Fraction(str(share)) * n) // 1))


@dataclass
class Open:
    """A range that holds wanted ranks: exclusive bounds (None: none), how many values lie below it, how many different ones in it, and where to cut it."""

    low: float | None
    high: float | None
    below: int
    n: int
    cuts: list[float]
    ranks: dict[str, int] = field(default_factory=dict)


def _sketch(value: Column, sketch: int) -> Column:
    return F.percentile_approx(value, [i / PARTS for i in range(1, PARTS)], sketch)


def _part(splits: Column, value: Column) -> Column:
    """Twice the number of splitters below the value, and one more if it is a splitter."""
    return 2 * F.size(F.filter(splits, lambda s: s < value)) + F.array_contains(splits, value).cast("int")


def _with_splits(values: DataFrame, by: list[str], cells: dict[tuple, list[Open]], inner: bool) -> tuple[DataFrame, dict[tuple, list[float]]]:
    """The values in open ranges with their ``part`` (both null for other values), by each group's splitters: the ranges' bounds, and with ``inner`` their cuts."""
    splits = {g: sorted({b for o in opens for b in (o.low, o.high, *(o.cuts if inner else ())) if b is not None}) for g, opens in cells.items()}
    spans = pa.list_(pa.struct([("low", pa.float64()), ("high", pa.float64())]))
    columns = {f"g{i}": values.schema[c].dataType.simpleString() for i, c in enumerate(by)} | {"splits": pa.list_(pa.float64()), "spans": spans}
    rows = [(*g, splits[g], [{"low": o.low, "high": o.high} for o in cells[g]]) for g in cells]
    table = F.broadcast(small_table(values.sparkSession, columns, rows))  # a row for each group
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"g{i}"))
    v = F.col("value")
    within = F.exists("spans", lambda s: (s["low"].isNull() | (s["low"] < v)) & (s["high"].isNull() | (v < s["high"])))
    part = F.when(within, _part(F.col("splits"), v)).alias("part")  # values in no open range stay as nulls: a filter would be pushed below the join, where it can't be evaluated
    return values.join(table, same).select(*by, part, F.when(within, v).alias("value"), "copies"), splits


def at_ranks(table: DataFrame, by: list[str], value: Column, wanted: Callable[[int], dict[str, int]], small: int = SMALL, sketch: int = SKETCH, copies: Column | None = None) -> dict[tuple, dict[str, float | None]]:
    """{group: {name: value}} at the ranks (from 1, by rising value) that ``wanted`` names for a group of n values; nulls are left out.

    A rank beyond n gives the greatest value, one below 1 the least. ``table`` is read once; ``copies`` says how often a row's value counts (once).
    """
    tall = table.select(*by, value.cast("double").alias("value"), (F.lit(1) if copies is None else copies).cast("long").alias("copies")).where("value IS NOT NULL")
    values = materialize(tall.groupBy(*by, "value").agg(F.sum("copies").alias("copies")), "values")
    groups = values.groupBy(*by) if by else values.groupBy()
    first = groups.agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies"), _sketch(F.col("value"), sketch).alias("cuts")).collect()  # a row for each group
    known: dict[tuple, dict[str, float | None]] = {}
    cells: dict[tuple, list[Open]] = {}
    for r in first:
        if r["n"]:
            g = tuple(r[c] for c in by)
            ranks = {name: min(max(1, k), r["copies"]) for name, k in wanted(r["copies"]).items()}
            known[g] = dict.fromkeys(ranks)
            cells[g] = [Open(None, None, 0, r["n"], r["cuts"], ranks)]
    while any(o.n > small for opens in cells.values() for o in opens):
        cells = _narrowed(values, by, cells, known, sketch)
    if cells:
        _read_off(values, by, cells, known)
    return known


def _narrowed(values: DataFrame, by: list[str], cells: dict[tuple, list[Open]], known: dict, sketch: int) -> dict[tuple, list[Open]]:
    """One round: every open range by its parts. Ranks that fall on a splitter, or in a part of one value, are known."""
    within, splits = _with_splits(values, by, cells, inner=True)
    v = F.col("value")
    parts = within.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies"), F.min(v).alias("low"), F.max(v).alias("high"), _sketch(v, sketch).alias("cuts"))
    found: dict[tuple, list] = {}
    for r in parts.collect():  # at most 2 * PARTS for each open range
        if r["part"] is not None:
            found.setdefault(tuple(r[c] for c in by), []).append(r)
    left: dict[tuple, list[Open]] = {}
    for g, opens in cells.items():
        s = splits[g]
        for o in opens:
            begin, end = (-1 if o.low is None else 2 * s.index(o.low) + 1), (2 * len(s) + 1 if o.high is None else 2 * s.index(o.high) + 1)
            below, ranks = o.below, dict(o.ranks)
            for r in sorted((r for r in found.get(g, []) if begin < r["part"] < end), key=lambda r: r["part"]):
                own = {name: k for name, k in ranks.items() if below < k <= below + r["copies"]}
                if own and r["low"] == r["high"]:
                    known[g].update(dict.fromkeys(own, r["low"]))
                elif own:
                    i = r["part"] // 2
                    left.setdefault(g, []).append(Open(s[i - 1] if i else None, s[i] if i < len(s) else None, below, r["n"], r["cuts"], own))
                below += r["copies"]
    return left


def _read_off(values: DataFrame, by: list[str], cells: dict[tuple, list[Open]], known: dict) -> None:
    """The ranks in ranges of few values: each range is sorted in one task, and only the wanted values leave it."""
    within, splits = _with_splits(values, by, cells, inner=False)
    upwards = Window.partitionBy(*by, "part").orderBy("value")  # ``small`` values at most
    placed = within.where("part IS NOT NULL").withColumn("until", F.sum("copies").over(upwards))
    columns = {f"g{i}": values.schema[c].dataType.simpleString() for i, c in enumerate(by)} | {"at": "int", "name": "string", "place": "long"}
    rows = []
    for g, opens in cells.items():
        for o in opens:
            part = 0 if o.low is None else 2 * (splits[g].index(o.low) + 1)
            rows += [(*g, part, name, k - o.below) for name, k in o.ranks.items()]
    asked = F.broadcast(small_table(values.sparkSession, columns, rows))
    same = (F.col("part") == F.col("at")) & (F.col("place") > F.col("until") - F.col("copies")) & (F.col("place") <= F.col("until"))
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"g{i}"))
    for r in placed.join(asked, same).select(*by, "name", "value").collect():  # a row for each rank
        known[tuple(r[c] for c in by)][r["name"]] = r["value"]


def quantiles(table: DataFrame, by: list[str], value: Column, points: dict[str, float], small: int = SMALL, sketch: int = SKETCH, copies: Column | None = None) -> DataFrame:
    """(by..., names of ``points``...): exact quantiles of each group, each a value that occurs; one row for each group."""
    found = at_ranks(table, by, value, lambda n: {name: rank_of(p, n) for name, p in points.items()}, small, sketch, copies)
    columns = {c: table.schema[c].dataType.simpleString() for c in by} | dict.fromkeys(points, "double")
    return small_table(table.sparkSession, columns, [(*g, *(own[p] for p in points)) for g, own in found.items()])
