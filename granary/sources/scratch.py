"""Tables that are written once and read several times, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_stored: dict[tuple[str, str], tuple[str, DataFrame]] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, in local mode a folder of this application; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = spark.sparkContext.applicationId
        if own not in _own_dirs:
            _own_dirs[own] = "file://" + tempfile.mkdtemp(prefix="granary-")
        path = _own_dirs[own]
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a re-read instead of a recomputation, and pins
    whatever the plan derives from partition numbers.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, name: str, version: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name``, written when it is first asked for in this application, and again if its ``version`` has changed or its files are gone."""
    key = (spark.sparkContext.applicationId, name)
    if key in _stored and _stored[key][0] == version:
        df = _stored[key][1]
        try:
            return spark.read.schema(df.schema).parquet(*{f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]})
        except AnalysisException:
            pass
    _stored[key] = version, materialize(make(), re.sub(r"\W+", "-", name))
    return _stored[key][1]
