"""A folder that driver and executors share, for tables that live as long as the session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

from .storage import Store

_own: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; only a session on one machine may go without it, under a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lamina-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = f"file://{_own[0]}"
    path = f"{base.rstrip('/')}/lamina-{uuid.uuid4().hex}/{name}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        Store(spark, path.rpartition("/")[0]).delete()
    except Exception:  # the driver's JVM may have ended before
        pass
