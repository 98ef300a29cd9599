"""Tables written once in the folder that the driver and the executors share.

A staged table cuts the lineage: what reads it does not depend on shuffle files or cached
blocks of an executor that may be lost.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_LEFT: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Have Spark send this package to its Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(package)
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix=f"{name}-")), f"{name}-{app}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.join(name, os.path.relpath(os.path.join(folder, f), package)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shipped(f):
    """``f(spark, ...)`` after ``ship(spark)``."""

    @functools.wraps(f)
    def run(spark, *more):
        ship(spark)
        return f(spark, *more)

    return run


def give_back() -> None:
    """Return to the system what the allocators of this process hold without use."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, giving back what is free after each of them and at the end.

    A worker outlives its task and waits for the next, perhaps beside a stage that has no
    Python at all; it should not keep the memory of its largest batch meanwhile.
    """

    def kept_small(batches: Iterator) -> Iterator:
        def each() -> Iterator:
            for b in batches:
                yield b
                del b
                give_back()

        yield from run(each())
        give_back()

    return kept_small


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="driftwell-")
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/driftwell/{name}-{uuid.uuid4().hex}"
    if not _LEFT:
        atexit.register(_drop_all)
    _LEFT.append((spark, path))
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._driftwell_path = path
    return out


def hashed_sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """The ``rows`` rows of ``df`` (of ``total``) with the smallest hashes of ``key``.

    Hashes beyond what that many rows need are filtered first (with a margin of 10 % and
    four standard deviations), so that tasks together send about as many rows as are taken.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    if total > rows:
        df = df.filter(place < int((1 << 40) * min(1.0, (1.1 * rows + 4 * rows**0.5) / total)))
    return df.orderBy(place, key).limit(rows)


def release(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for t in tables:
        if path := getattr(t, "_driftwell_path", None):
            _drop(t.sparkSession, path)
            _LEFT[:] = [x for x in _LEFT if x[1] != path]


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_all() -> None:
    for spark, path in _LEFT:
        try:
            _drop(spark, path)
        except Exception:  # the JVM may have ended before
            return
