"""Where plans keep tables that all executors read."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of our own, on a single machine only."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there:
        return re.sub("^file:/(?!/)", "file:///", there).rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='faultline-')}")
    return shared(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, so its lineage ends there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()


_SCRATCH: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one, as a URI; it goes at the driver's end."""
    folder = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(folder if re.match(r"\w+:", folder) else f"file://{folder}")
    return _SCRATCH[-1]


def _cleared() -> None:
    for folder in _SCRATCH:
        with contextlib.suppress(OSError, ValueError):
            where, path = fs.FileSystem.from_uri(folder)
            where.delete_dir(path)


atexit.register(_cleared)
