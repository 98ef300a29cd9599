"""Replay of a change log as a stream.

Records are (seq, txn, type, table, key, value). PUT and DELETE change a key of a table (null: the
replica's own, whose values are text; others hold a JSON object of their columns);
CREATE_TABLE, DROP_TABLE, CREATE_INDEX and DROP_INDEX change the catalog; COMMIT and ABORT end a
transaction.

An operation belongs to the first end of its transaction with a greater seq. It waits until that
end comes and then takes effect in order of (end, seq), or is forgotten if the end is an ABORT.
Ends are kept, so an operation that comes batches after its COMMIT still takes its place, behind
what was committed later; ``lateness`` (in seqs) says how long, and older operations that come
after that stay among the waiting. A transaction's number may be used again after its end; the
ends of one transaction come in order. A micro-batch that comes again (after a restart) finds
itself named in the manifest and does nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.types import spark_type
from ..operators import snapshot
from ..sources.catalog import CatalogError, IndexDef, TableDef
from ..sources.store import Store


def _struct(spec: str) -> T.StructType:
    kinds = {"long": T.LongType(), "string": T.StringType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in spec.split(", "))])


RECORD = _struct("seq long, txn long, type string, table string, key string, value string")
STATE = _struct("table string, key string, value string, commit_seq long, seq long")
CATALOG = _struct("seq long, commit_seq long, type string, table string, key string, value string")
ENDS, CHANGES = ("COMMIT", "ABORT"), ("PUT", "DELETE")
DDL = ("CREATE_TABLE", "DROP_TABLE", "CREATE_INDEX", "DROP_INDEX")


class Replica:
    """Tables that follow a log; ``name`` holds their rows, ``name``_waiting what has not ended yet, ``name``_ends the ends and ``name``_ddl the catalog's changes."""

    def __init__(self, spark: SparkSession, root: str, name: str = "replica", lateness: int | None = None, compact_after: int = 16) -> None:
        self.spark, self.store, self.name, self.lateness, self.compact_after = spark, Store(spark, root), name, lateness, compact_after

    def _tables(self) -> tuple[int, list[TableDef], dict[str, TableDef]]:
        version = self.store.version()
        tables = self.store.tables(version)
        own = [tables.setdefault(n, TableDef(n, schema, key)) for n, schema, key in ((self.name, STATE, "key"), (f"{self.name}_waiting", RECORD, "seq"), (f"{self.name}_ends", RECORD, "seq"), (f"{self.name}_ddl", CATALOG, "seq"))]
        return version, own, tables

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch. Records that repeat a seq count once."""
        version, (state, waiting, ends, ddl), tables = self._tables()
        seq = batch_id + 1
        if any(s >= seq for _, s, _ in ends.batches):
            return
        if "table" not in batch.columns:
            batch = batch.withColumn("table", F.lit(None).cast("string"))
        new = batch.select(*RECORD.names).dropDuplicates(["seq"])
        new = self.store.write_batch(TableDef(f"{self.name}_in", RECORD, "seq"), new, "A", seq).select(*RECORD.names)
        held, past = self.store.view(waiting), self.store.view(ends)
        known = self._horizon(new.filter(F.col("type").isin(*ENDS)).unionByName(past)).dropDuplicates(["seq"])
        open_ops = new.filter(~F.col("type").isin(*ENDS)).unionByName(held).dropDuplicates(["seq"])
        rows = open_ops.unionByName(known.join(open_ops.select("txn").distinct(), "txn", "left_semi").select(*RECORD.names))
        after = Window.partitionBy("txn").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
        end = F.first(F.when(F.col("type").isin(*ENDS), F.struct("type", "seq")), ignorenulls=True).over(after)
        ops = rows.withColumn("end", end).filter(~F.col("type").isin(*ENDS))
        done = ops.filter("end.type = 'COMMIT'").withColumn("commit_seq", F.col("end.seq")).drop("end")
        changes = snapshot.newest(done.filter(F.col("type").isin(*CHANGES)), ["table", "key"], ["commit_seq", "seq"])
        self.store.write_batch(state, changes.withColumn("_op", F.when(F.col("type") == "PUT", "P").otherwise("D")), "U", seq)
        self.store.write_batch(ddl, done.filter(F.col("type").isin(*DDL)), "A", seq)
        open_ = ops.filter("end is null").drop("end")
        if len(waiting.batches) >= self.compact_after:
            waiting.batches = []
            self.store.write_batch(waiting, open_, "A", seq)
        else:  # what has come to wait, and what waits no more
            self.store.write_batch(waiting, open_.join(held.select("seq"), "seq", "left_anti"), "A", seq)
            self.store.write_batch(waiting, held.join(open_.select("seq"), "seq", "left_anti").withColumn("_op", F.lit("D")), "U", seq)
        if len(ends.batches) >= self.compact_after:
            ends.batches = []
            self.store.write_batch(ends, known, "A", seq)
        else:
            self.store.write_batch(ends, new.filter(F.col("type").isin(*ENDS)).join(past.select("seq"), "seq", "left_anti"), "A", seq)
        if len(state.batches) >= self.compact_after:  # tombstones stay, as late operations may be older
            log = self.store.read_log(state)
            state.batches = []
            self.store.write_batch(state, snapshot.newest(log, ["table", "key"], ["commit_seq", "seq"]), "U", seq)
        self.store.publish(tables, version, {t.name for t in (state, waiting, ends, ddl)})
        self.store.drop_data(f"{self.name}_in")

    def _horizon(self, ends: DataFrame) -> DataFrame:
        if self.lateness is None:
            return ends
        newest = ends.agg(F.max("seq").alias("newest"))
        return ends.join(newest, F.col("seq") >= F.col("newest") - self.lateness).drop("newest")

    def follow(self, records: DataFrame, checkpoint: str) -> StreamingQuery:
        """Apply a stream of records until all that is there is applied."""
        return records.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _live(self) -> DataFrame:
        log = self.store.read_log(self._tables()[1][0])
        if log is None:
            return self.spark.createDataFrame([], STATE)
        return snapshot.live(log, ["table", "key"], ["commit_seq", "seq"], "_op")

    def view(self) -> DataFrame:
        """Live keys and values of the replica's own table: of each key, the change committed last."""
        return self._live().filter("table is null").select("key", "value")

    def catalog(self) -> dict[str, tuple[TableDef, tuple[int, int]]]:
        """The tables that the log has created and not dropped, each with the place of its CREATE_TABLE.

        What comes twice changes nothing; a table that exists with other columns is an error. The
        records are metadata, so they are few, and are folded here in order of their commits.
        """
        out: dict[str, tuple[TableDef, tuple[int, int]]] = {}
        log = self.store.read_log(self._tables()[1][3])
        for r in sorted(log.collect(), key=lambda r: (r["commit_seq"], r["seq"])) if log is not None else []:
            place, name = (r["commit_seq"], r["seq"]), r["table"]
            if r["type"] == "CREATE_TABLE":
                d = json.loads(r["value"])
                made = TableDef(name, T.StructType([T.StructField(c, spark_type(kind)) for c, kind in d["columns"].items()]), d["primary_key"])
                if name not in out:
                    out[name] = (made, place)
                elif (out[name][0].schema, out[name][0].primary_key) != (made.schema, made.primary_key):
                    raise CatalogError(f"there is a table {name} with other columns")
            elif r["type"] == "DROP_TABLE":
                out.pop(name, None)
            elif name not in out:
                raise CatalogError(f"there is no table {name}")
            elif r["type"] == "DROP_INDEX":
                out[name][0].indexes.pop(r["key"], None)
            elif r["key"] not in out[name][0].indexes:
                d = json.loads(r["value"])
                out[name][0].add_index(IndexDef(r["key"], d["columns"], d.get("unique", False)))
        return out

    def table(self, name: str) -> DataFrame:
        """The rows of a table that the log created; what was written before its last CREATE_TABLE is gone."""
        tables = self.catalog()
        if name not in tables:
            raise CatalogError(f"there is no table {name}")
        t, (commit_seq, seq) = tables[name]
        later = self._live().filter((F.col("table") == name) & ((F.col("commit_seq") > commit_seq) | ((F.col("commit_seq") == commit_seq) & (F.col("seq") > seq))))
        return later.select(F.from_json("value", T.StructType([T.StructField(f.name, f.dataType) for f in t.schema])).alias("row")).select("row.*")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The log's Parquet files as a stream, in the order they appear."""
    return spark.readStream.schema(RECORD).parquet(path)


def ordered(records: DataFrame) -> DataFrame:
    """A batch of records with each one's place in its transaction."""
    return records.withColumn("place", F.row_number().over(Window.partitionBy("txn").orderBy("seq")))
