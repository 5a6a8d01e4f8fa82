"""Python workers import this package from the driver's path, where they can see it."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parents[1])


def share_package(spark: SparkSession) -> None:
    env = spark.sparkContext.environment
    found = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in found:
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, *found]))


def _folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a folder of this machine's, which only a local master shares with its tasks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = Path(tempfile.mkdtemp(prefix="gaugework-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def checkpoints(spark: SparkSession) -> None:
    """checkpoint() writes to spark.checkpoint.dir."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(_folder(spark))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one."""
    return f"{_folder(spark)}/gaugework/{name}-{uuid.uuid4().hex}"


def done(spark: SparkSession, path: str) -> bool:
    """Whether a write to path has ended, in any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
