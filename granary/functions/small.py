"""Small tables made on the driver: centers, splitters, facts of a run."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "date": pa.date32()}


def small_table(spark: SparkSession, columns: dict[str, str | pa.DataType], rows: list[tuple]) -> DataFrame:
    """A table of a few rows as part of the plan itself: no job makes it. ``columns``: names and types; types that aren't known here go by Spark's own way."""
    kinds = {n: _KINDS.get(k) if isinstance(k, str) else k for n, k in columns.items()}
    if None in kinds.values():  # then all types must be given as text
        return spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in columns.items()))
    arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=list(kinds)))
