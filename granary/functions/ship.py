"""The library's code on executors, for functions that run in Arrow batches there."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for each application, as they may not have it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        if (root / "granary").is_dir():  # else it came as an archive, which the executors have too
            archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='granary-')}/granary-code", "zip", root, "granary")
            context.addPyFile(archive)
        _shipped.add(context.applicationId)
