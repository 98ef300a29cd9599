"""Persisted tables: Parquet batches under a log of manifest versions.

A commit writes its batches first and then one manifest, which names every batch of every
table; readers pin a version, so they see whole commits only. What was written but never
named is not read. A manifest is put in place by a rename that fails if the version exists:
of two writers, one wins and the other learns of the conflict. All access goes through
Hadoop file systems, so a store can be wherever Spark reads and writes.

Batches are of two kinds: "A" rows have keys that were not live (inserts, compacted bases),
"U" rows change or delete live keys. A view scans the first with pushed filters and lays
the newest of the second over them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import snapshot
from .catalog import CatalogError, IndexDef, TableDef


class ConflictError(RuntimeError):
    """Another commit changed the same table since the transaction began."""


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        path = self._path("_log")
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def versions(self) -> list[int]:
        return sorted(int(f.getPath().getName()[:20]) for f in self._fs.listStatus(self._path("_log")) if f.getPath().getName().endswith(".json"))

    def version(self) -> int:
        return max(self.versions(), default=0)

    def tables(self, version: int | None = None) -> dict[str, TableDef]:
        """The catalog as of a version; its size is that of the metadata, never of the data."""
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._path("_log", f"{version:020d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {d["name"]: TableDef.from_json(d) for d in json.loads(text)["tables"]}

    def publish(self, tables: dict[str, TableDef], since: int, touched: set[str]) -> int:
        """Commit a catalog built on version ``since``; only the touched tables are taken from it. Returns the new version."""
        while True:
            now = self.version()
            current = self.tables(now) if now != since else None
            if current is not None:
                before = self.tables(since)
                for t in touched:
                    if (current.get(t) and current[t].to_json()) != (before.get(t) and before[t].to_json()):
                        raise ConflictError(f"table {t} was changed by another commit")
                own = {t: tables[t] for t in touched if t in tables}
                tables = {n: d for n, d in current.items() if n not in touched} | own
                since = now
            if self._put(now + 1, {"tables": [d.to_json() for _, d in sorted(tables.items())]}):
                return now + 1

    def _put(self, version: int, content: dict) -> bool:
        temp, to = self._path("_log", f".{uuid.uuid4().hex}.tmp"), self._path("_log", f"{version:020d}.json")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if self._fs.exists(to):
            self._fs.delete(temp, False)
            return False
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(temp, to, self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:  # the JVM's FileAlreadyExistsException: another writer was first
            if "AlreadyExists" not in str(e):
                raise
            self._fs.delete(temp, False)
            return False
        return True

    def write_batch(self, table: TableDef, rows: DataFrame, kind: str, seq: int, *more: str) -> DataFrame:
        """Write rows (all columns, ``_op`` for kind "U", and ``more``) as a batch and read it back; nothing sees it before a manifest names it.

        ``rows`` is computed once: checks and counts go over what was written. Row groups carry
        a Bloom filter of the primary key, which point reads skip by.
        """
        path = f"{table.name}/{seq:020d}-{uuid.uuid4().hex}"
        if kind == "A":
            rows = rows.withColumn("_op", F.lit("P"))
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema]
        out = rows.select(*columns, "_op", F.lit(seq).cast("long").alias("_seq"), *more)
        out.write.option(f"parquet.bloom.filter.enabled#{table.primary_key}", "true").parquet(f"{self.root}/{path}")
        table.batches.append([kind, seq, path])
        return self.spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])).parquet(f"{self.root}/{path}")

    def forget_batch(self, table: TableDef) -> None:
        """Take back the batch written last, which no manifest names yet."""
        _, _, path = table.batches.pop()
        self._fs.delete(self._path(path), True)

    def write_postings(self, table: TableDef, index: IndexDef, postings: DataFrame) -> None:
        """Write an index's posting lists, each value's chunks side by side, so that a lookup's filter skips the row groups of other values."""
        path = f"{table.name}/_index/{index.name}-{uuid.uuid4().hex}"
        postings.repartitionByRange("value", "part").sortWithinPartitions("value", "part").write.parquet(f"{self.root}/{path}")
        index.path, index.built = path, table.last()

    def read_postings(self, table: TableDef, index: IndexDef) -> DataFrame:
        kind = table.schema[index.columns[0]].dataType if len(index.columns) == 1 else T.StringType()
        schema = T.StructType([T.StructField("value", kind), T.StructField("part", T.IntegerType()), T.StructField("pks", T.ArrayType(table.schema[table.primary_key].dataType))])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{index.path}")

    def read_log(self, table: TableDef, kinds: str = "AU", after: int = -1) -> DataFrame | None:
        """The batches of these kinds that came after batch ``after``; None if there are none."""
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in table.schema] + [T.StructField("_op", T.StringType()), T.StructField("_seq", T.LongType())])
        paths = [f"{self.root}/{p}" for k, s, p in table.batches if k in kinds and s > after]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def view(self, table: TableDef) -> DataFrame:
        """The table's live rows."""
        base, changes = self.read_log(table, "A"), self.read_log(table, "U")
        if base is None and changes is None:
            return self.spark.createDataFrame([], table.schema)
        if base is None:
            out = changes.limit(0)
        elif changes is None:
            out = base
        else:
            out = snapshot.overlay(base, changes, [table.primary_key])
        return out.select(*table.schema.names)

    def compact(self, name: str) -> int:
        """Rewrite a table as one batch without tombstones; older versions still read their own batches."""
        since = self.version()
        tables = self.tables(since)
        if name not in tables:
            raise CatalogError(f"there is no table {name}")
        t = tables[name]
        rows = self.view(TableDef.from_json(t.to_json()))
        seq, t.batches = t.last(), []
        self.write_batch(t, rows, "A", seq)
        return self.publish(tables, since, {name})

    def compact_if(self, name: str, runs: int = 16) -> int | None:
        """Compact a table that has more than so many batches; None if it has not."""
        return self.compact(name) if len(self.tables()[name].batches) > runs else None

    def count(self, name: str) -> int:
        """Live rows of a table."""
        return self.view(self.tables()[name]).count()

    def problems(self, name: str) -> DataFrame:
        """(key, problem) of what a sound table does not have: live keys that are null or occur twice, and changes of kind "U" to a key before its first insert."""
        t = self.tables()[name]
        key = F.col(t.primary_key)
        view = self.view(t)
        out = view.filter(key.isNull()).select(F.lit(None).cast("string").alias("key"), F.lit("null key").alias("problem"))
        out = out.unionByName(view.groupBy(key.cast("string").alias("key")).count().filter("key IS NOT NULL AND count > 1").select("key", F.lit("duplicate key").alias("problem")))
        log = self.read_log(t)
        if log is not None and any(k == "A" for k, _, _ in t.batches):
            first = log.groupBy(key.cast("string").alias("key")).agg(F.min_by("_op", "_seq").alias("op"))
            out = out.unionByName(first.filter("op = 'D'").select("key", F.lit("deleted before inserted").alias("problem")))
        return out

    def drop_data(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def scan_all(self) -> DataFrame:
        """(table_name, key) of every live row of every table."""
        return snapshot.whole_database({n: (self.view(t), t.primary_key) for n, t in self.tables().items()})
