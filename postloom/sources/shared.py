"""The folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a folder of this process serves a session of one JVM; a cluster, whose
    executors could not read it, is refused.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master == "local" or master.startswith("local["):
        return _own_dir()
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


@cache
def _session_dir(root: str, session: str) -> str:
    return f"{root}/postloom-{session}-{uuid.uuid4().hex[:8]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table, in a folder of this session that goes when the session's process ends."""
    path = _session_dir(shared_dir(spark), spark.sparkContext.applicationId)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{path}/{name}-{uuid.uuid4().hex}"
