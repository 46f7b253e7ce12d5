"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and all of Spark is this one process, a folder of our own, removed at the end."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quillframe-tables-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"
