"""Folders that the driver and the executors share, for tables that a query writes on its way."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}
_LEFT: list[tuple[SparkSession, str]] = []


def shared(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="driftwell-core-")
    return _OWN[app]


def fresh(spark: SparkSession, name: str) -> str:
    """A path there that nothing has used; it goes when the driver ends."""
    if not _LEFT:
        atexit.register(_drop_all)
    path = f"{shared(spark)}/driftwell/{name}-{uuid.uuid4().hex}"
    _LEFT.append((spark, path))
    return path


def checkpoints(spark: SparkSession) -> None:
    """Have ``DataFrame.checkpoint`` write there, unless a folder is set already."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(fresh(spark, "checkpoints"))


def _drop_all() -> None:
    for spark, path in _LEFT:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may have ended before
            return
