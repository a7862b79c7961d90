"""Figures taken while a table is written, so that no second pass counts what has just been made.

They are observed in the stage that writes, whose tasks count once each however often they are tried, so they are those of the rows written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from granary.functions.small import small_table
from granary.sources import retail
from granary.sources.scratch import materialize


def materialize_observed(df: DataFrame, name: str, figures: dict[str, Column]) -> tuple[DataFrame, dict]:
    """``df`` written and read again, and ``figures`` (aggregates without distinct) over it, from the same job."""
    seen = Observation()
    kept = materialize(df.observe(seen, *[c.alias(n) for n, c in figures.items()]), name)
    return kept, seen.get


def write_observed(df: DataFrame, uri: str, figures: dict[str, Column]) -> dict:
    """Write ``df`` as Parquet and give back ``figures`` over it."""
    seen = Observation()
    retail.write_parquet(df.observe(seen, *[c.alias(n) for n, c in figures.items()]), uri)
    return seen.get


def step_figures(rules: list[str], removed_by: Column, early: Column, copies: Column, amount: Column, duplicates: str) -> dict[str, Column]:
    """For each rule, and for what stays, how many raw rows it takes and their amount, as aggregates over folded rows.

    A row that breaks an early rule goes with all its copies; else its copies but one are duplicates, and the one goes by its own rule.
    """
    whole, rest = F.coalesce(early, F.lit(False)), copies - 1
    out: dict[str, Column] = {}
    for i, rule in enumerate([*rules, None]):
        own = removed_by.isNull() if rule is None else removed_by == rule
        n = F.when(own, F.when(whole, copies).otherwise(1)).otherwise(0)
        if rule == duplicates:
            n = F.when(whole, 0).otherwise(rest)
        out[f"n{i}"] = F.coalesce(F.sum(n), F.lit(0))
        out[f"amount{i}"] = F.sum((amount * n).cast("decimal(28,3)"))
    return out


def audit_table(df: DataFrame, rules: list[str], seen: dict) -> DataFrame:
    """(step, rule, rows_before, rows_removed, rows_after, amount_removed) from the figures of :func:`step_figures`."""
    taken = [int(seen[f"n{i}"]) for i in range(len(rules) + 1)]
    rows, left = [], sum(taken)
    for i, rule in enumerate(rules):
        rows.append((i + 1, rule, left, taken[i], left - taken[i], float(seen[f"amount{i}"] or 0)))
        left -= taken[i]
    return small_table(df.sparkSession, {"step": "int", "rule": "string", "rows_before": "long", "rows_removed": "long", "rows_after": "long", "amount_removed": "double"}, rows)
