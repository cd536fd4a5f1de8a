"""The folder for intermediate tables that the driver and all executors reach."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []
_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder in local mode, and an error on a cluster, whose machines would not share one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        kept = tempfile.TemporaryDirectory(prefix="corvine-")
        atexit.register(kept.cleanup)
        _own.append(f"file://{kept.name}")
    return _own[0]


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``shared_root``."""
    _made.append(f"{shared_root(spark)}/corvine-{uuid.uuid4().hex}")
    return _made[-1]


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def remove_made(spark: SparkSession) -> int:
    """Delete the folders that ``shared_dir`` gave to this process, once no result that reads them is needed. Returns their number."""
    count = len(_made)
    while _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return count
