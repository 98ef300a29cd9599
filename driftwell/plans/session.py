"""Statements over a store: a thin layer for what Spark SQL lacks on plain Parquet tables.

CREATE and DROP TABLE and INDEX, INSERT, UPDATE, DELETE, BEGIN, COMMIT, ROLLBACK, SET and SHOW are handled
here; every query is Spark SQL over snapshot views, so joins, aggregates and the rest come
with it. Outside a transaction each statement commits by itself; within one, statements see
its own changes over the version it began with, and ROLLBACK forgets them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import identifier, spark_type
from ..operators import dml, indexes
from ..sources.catalog import CatalogError, IndexDef, TableDef
from ..sources.store import ConflictError, Store
from . import grammar, lexer
from .grammar import StatementError

# What SHOW answers; other names are empty.
SETTINGS = {
    "client_encoding": "UTF8",
    "server_encoding": "UTF8",
    "server_version": "15.0",
    "standard_conforming_strings": "on",
    "application_name": "driftwell",
    "search_path": "public",
    "transaction_isolation": "read committed",
    "transaction_read_only": "off",
    "datestyle": "ISO, MDY",
    "integer_datetimes": "on",
}


@dataclass
class Result:
    """A command tag and, for queries, their rows."""

    tag: str
    rows: DataFrame | None = None


def show(spark: SparkSession, name: str) -> DataFrame:
    return spark.range(1).select(F.lit(SETTINGS.get(name, "")).alias(name))


def literal_select(spark: SparkSession, text: str) -> DataFrame:
    """The dialect's SELECT without FROM: its source text (a quoted literal's value) in one column."""
    value = lexer.literal(text) if text[:1] in "'\"" else text
    return spark.range(1).select(F.lit(value).alias("?column?"))


class Session:
    """``text_equality``: conditions are the dialect's plain conjunctions, compared as text with null as ''; otherwise Spark SQL conditions on typed columns.

    A statement that commits by itself and leaves a table with more than ``compact_after``
    batches has it compacted.
    """

    def __init__(self, spark: SparkSession, root: str, text_equality: bool = False, compact_after: int = 64) -> None:
        self.spark, self.store, self.text_equality, self.compact_after = spark, Store(spark, root), text_equality, compact_after
        self._end()

    def _end(self) -> None:
        self.in_transaction, self._tables, self._since, self._touched, self._dropped = False, None, 0, set(), set()

    # statements

    def execute(self, sql: str) -> list[Result]:
        """Run statements in order; the first that fails ends the batch, and those before it stay."""
        return [self.run(s) for s in lexer.split_statements(sql)]

    def run(self, sql: str) -> Result:
        words = [p for p in lexer.pieces(sql) if not p.isspace()]
        head = words[0].upper() if words else ""
        second = words[1].upper() if len(words) > 1 else ""
        if head in ("BEGIN", "COMMIT", "ROLLBACK") and (len(words) == 1 or head == "BEGIN" and second == "TRANSACTION" and len(words) == 2):
            return getattr(self, f"_{head.lower()}")()
        if head == "SET" and "=" in sql:
            return Result("SET")
        if head == "SHOW" and len(words) == 2:
            return Result("SHOW", show(self.spark, identifier(words[1])))
        if head in ("SELECT", "WITH"):
            return self._select(sql, words)
        made = grammar.read(sql)
        return self._mutate(lambda: self._DO[type(made)](self, made))

    def _begin(self) -> Result:
        if self.in_transaction:
            raise StatementError("a transaction is in progress")
        self._open()
        self.in_transaction = True
        return Result("BEGIN")

    def _open(self) -> None:
        self._since = self.store.version()
        self._tables, self._touched, self._dropped = self.store.tables(self._since), set(), set()

    def _commit(self) -> Result:
        if not self.in_transaction:
            raise StatementError("no transaction is in progress")
        try:
            self._publish()
        finally:
            self._end()
        return Result("COMMIT")

    def _publish(self) -> None:
        if self._touched:
            self.store.publish(self._tables, self._since, self._touched)
        for name in self._dropped - set(self._tables):
            self.store.drop_data(name)

    def _rollback(self) -> Result:
        if not self.in_transaction:
            raise StatementError("no transaction is in progress")
        self._end()
        return Result("ROLLBACK")

    def _mutate(self, do: Callable[[], Result]) -> Result:
        """A statement that fails leaves the transaction's earlier statements as they were."""
        if self.in_transaction:
            kept = ({n: TableDef.from_json(t.to_json()) for n, t in self._tables.items()}, set(self._touched), set(self._dropped))
            try:
                return do()
            except Exception:
                self._tables, self._touched, self._dropped = kept
                raise
        self._open()
        try:
            out = do()
            self._publish()
            full = [n for n in self._touched if n in self._tables and len(self._tables[n].batches) > self.compact_after]
        finally:
            self._end()
        for name in full:
            self.compact(name)
        return out

    def compact(self, name: str) -> None:
        """Rewrite a table as one batch and its indexes for it; if another commit changes the table meanwhile, a later one will."""
        try:
            self.store.compact(name)
            for i in sorted(self._table(name).indexes):
                self.reindex(name, i)
        except ConflictError:
            return

    # catalog

    def tables(self) -> dict[str, TableDef]:
        return self._tables if self._tables is not None else self.store.tables()

    def _table(self, name: str) -> TableDef:
        if name not in self.tables():
            raise CatalogError(f"there is no table {name}")
        return self.tables()[name]

    def table(self, name: str) -> DataFrame:
        """A snapshot of a table."""
        return self.store.view(self._table(identifier(name)))

    def _create_table(self, s: grammar.Table) -> Result:
        made = TableDef(s.name, T.StructType([T.StructField(c, spark_type(kind), nullable) for c, kind, nullable in s.columns]), s.primary_key)
        if s.name in self._tables:
            if not s.lenient:
                raise CatalogError(f"there is a table {s.name}")
            return Result("CREATE TABLE")
        self._tables[s.name] = made
        self._touched.add(s.name)
        return Result("CREATE TABLE")

    def _drop(self, s: grammar.Drop) -> Result:
        tag = f"DROP {s.what.upper()}"
        if s.what == "table":
            if s.name in self._tables:
                del self._tables[s.name]
                self._touched.add(s.name)
                self._dropped.add(s.name)
                return Result(tag)
        else:
            for _, t in sorted(self._tables.items()):
                if t.indexes.pop(s.name, None):
                    self._touched.add(t.name)
                    return Result(tag)
        if not s.lenient:
            raise CatalogError(f"there is no {s.what} {s.name}")
        return Result(tag)

    def _create_index(self, s: grammar.Index) -> Result:
        t = self._table(s.table)
        if s.lenient and s.name in t.indexes:
            return Result("CREATE INDEX")
        index = IndexDef(s.name, s.columns, s.unique)
        t.add_index(index)
        if index.unique and not indexes.violations(self.store.view(t), index.columns).isEmpty():
            del t.indexes[s.name]
            raise dml.ConstraintError(f"rows of {t.name} clash in {s.name}")
        self._write_postings(t, index)
        self._touched.add(t.name)
        return Result("CREATE INDEX")

    def _write_postings(self, t: TableDef, index: IndexDef) -> None:
        view = self.store.view(t)
        index.chunks = indexes.chunks_for(view.count())
        self.store.write_postings(t, index, indexes.build(view, index.columns, t.primary_key, index.chunks))

    def _index(self, table: str, name: str) -> tuple[TableDef, IndexDef]:
        t = self._table(identifier(table))
        if identifier(name) not in t.indexes:
            raise CatalogError(f"there is no index {name}")
        return t, t.indexes[identifier(name)]

    def index(self, table: str, name: str) -> DataFrame:
        """The posting lists of an index as of the table's snapshot: what is written, with the keys that later batches touched filed anew."""
        t, i = self._index(table, name)
        view = self.store.view(t)
        if i.path is None:
            return indexes.build(view, i.columns, t.primary_key, i.chunks)
        written, later = self.store.read_postings(t, i), self.store.read_log(t, after=i.built)
        if later is None:
            return written
        touched = later.select(F.col(t.primary_key).alias("pk")).distinct()
        now = indexes.entries(view, i.columns, t.primary_key).join(touched, "pk", "left_semi")
        return indexes.refreshed(written, touched, now, i.chunks)

    def find(self, table: str, name: str, value: object) -> DataFrame:
        """Rows whose indexed columns have this value (a list for several columns).

        Candidates are the keys that the written postings have under the value and the keys
        that later batches touched; each candidate's row is checked, so what is stale does no harm.
        """
        t, i = self._index(table, name)
        key, view = t.primary_key, self.store.view(t)
        want = F.lit(value) if len(i.columns) == 1 else F.to_json(F.array(*(F.lit(str(v)) for v in value)))
        keys, later = None, self.store.read_log(t, after=i.built if i.path else -1)
        if i.path is not None:
            keys = self.store.read_postings(t, i).filter(F.col("value") == want).select(F.explode("pks").alias(key))
        if later is not None:
            touched = later.select(key).distinct()
            keys = touched if keys is None else keys.unionByName(touched)
        if keys is None:
            return view
        return view.filter(indexes.value_of(i.columns) == want).join(keys, key, "left_semi").select(*t.schema.names)

    def reindex(self, table: str, name: str) -> Result:
        """Write an index's postings anew, from the table as it is."""
        if self._tables is None:
            return self._mutate(lambda: self.reindex(table, name))
        t, i = self._index(table, name)
        self._write_postings(t, i)
        self._touched.add(t.name)
        return Result("REINDEX")

    # rows

    def _condition(self, t: TableDef, where: str | None) -> Column:
        if not where:
            return F.lit(True)
        if not self.text_equality:
            return F.expr(where)
        equal = lexer.equalities(where)
        known = {c: v for c, v in equal.items() if c in t.schema.names}
        if any((v or "") != "" for c, v in equal.items() if c not in known):
            return F.lit(False)  # a column that is not there reads as ''
        return dml.matches(self.store.view(t), known, text=True)

    def _insert(self, s: grammar.Insert) -> Result:
        t = self._table(s.table)
        columns = s.columns if s.columns is not None else t.schema.names
        if s.query is not None:
            rows = self._query(s.query)
            if len(rows.columns) != len(columns):
                raise StatementError(f"{len(columns)} columns but {len(rows.columns)} values")
            return self.insert_rows(t.name, rows.toDF(*columns))
        for r in s.rows:
            if len(r) != len(columns):
                raise StatementError(f"{len(columns)} columns but {len(r)} values")
        return self.insert_rows(t.name, self.spark.createDataFrame(s.rows, T.StructType([T.StructField(c, T.StringType()) for c in columns])))

    def insert_rows(self, name: str, rows: DataFrame) -> Result:
        """Insert a DataFrame of any size; values are cast to the columns' types, and those that can't be are an error.

        The rows are computed once, into a batch that is checked before anything names it.
        """
        if self._tables is None:
            return self._mutate(lambda: self.insert_rows(name, rows))
        t = self._table(identifier(name))
        if extra := set(rows.columns) - set(t.schema.names):
            raise dml.ConstraintError(f"{t.name} has no column {', '.join(sorted(extra))}")
        typed = {c: F.expr(f"try_cast(`{c}` AS {t.schema[c].dataType.simpleString()})") for c in rows.columns}
        lost = F.lit(False)
        for c, v in typed.items():
            lost = lost | (F.col(c).isNotNull() & v.isNull())
        new = rows.select(*(v.alias(c) for c, v in typed.items()), lost.alias("_lost"))
        new = new.withColumns({f.name: F.lit(None).cast(f.dataType) for f in t.schema if f.name not in rows.columns})
        others = self.store.view(t)
        written = self.store.write_batch(t, new, "A", t.last() + 1, "_lost")
        try:
            need = [f.name for f in t.schema if not f.nullable]
            facts = written.agg(F.count("*").alias("n"), F.count_if("_lost").alias("lost"), F.count_if(F.greatest(*(F.col(c).isNull() for c in need), F.lit(False))).alias("null")).first()
            if facts["lost"]:
                raise dml.ConstraintError("a value does not have its column's type")
            if facts["null"]:
                raise dml.ConstraintError(f"null in one of {', '.join(need)}")
            self._unique(t, written, others, [("primary key", [t.primary_key]), *((i.name, i.columns) for i in t.indexes.values() if i.unique)])
        except Exception:
            self.store.forget_batch(t)
            raise
        self._touched.add(t.name)
        return Result(f"INSERT 0 {facts['n']}")

    def _unique(self, t: TableDef, new: DataFrame, others: DataFrame, rules: list[tuple[str, list[str]]]) -> None:
        """Whether ``new`` can stand beside ``others``."""
        for what, columns in rules:
            full = new.dropna(subset=columns).select(*columns)
            if not dml.repeated(full, columns).select(*columns).unionByName(dml.duplicates(others, full, columns)).isEmpty():
                raise dml.ConstraintError(f"a value of {what} exists: {t.name}")

    def _update(self, s: grammar.Update) -> Result:
        t = self._table(s.table)
        values: dict[str, Column] = {}
        for column, text in s.sets:
            plain = self.text_equality or lexer.is_literal(text)
            values[column] = F.lit(lexer.literal(text)) if plain else F.expr(text)
        view = self.store.view(t)
        new = dml.update(view.filter(self._condition(t, s.where)), values, key=t.primary_key)
        return self._change(t, view, new, "UPDATE", values)

    def _delete(self, s: grammar.Delete) -> Result:
        t = self._table(s.table)
        view = self.store.view(t)
        return self._change(t, view, view.filter(self._condition(t, s.where)), "DELETE", {})

    def _change(self, t: TableDef, view: DataFrame, rows: DataFrame, verb: str, values: dict) -> Result:
        written = self.store.write_batch(t, rows.withColumn("_op", F.lit("P" if verb == "UPDATE" else "D")), "U", t.last() + 1)
        try:
            need = [f.name for f in t.schema if not f.nullable and f.name in values]
            facts = written.agg(F.count("*").alias("n"), F.count_if(F.greatest(*(F.col(c).isNull() for c in need), F.lit(False), F.lit(False))).alias("null")).first()
            if facts["null"]:
                raise dml.ConstraintError(f"null in one of {', '.join(need)}")
            unique = [(i.name, i.columns) for i in t.indexes.values() if i.unique and set(i.columns) & set(values)]
            if facts["n"] and unique:
                self._unique(t, written, view.join(written.select(t.primary_key), t.primary_key, "left_anti"), unique)
        except Exception:
            self.store.forget_batch(t)
            raise
        if facts["n"]:
            self._touched.add(t.name)
        else:
            self.store.forget_batch(t)
        return Result(f"{verb} {facts['n']}")

    _DO = {grammar.Table: _create_table, grammar.Index: _create_index, grammar.Drop: _drop, grammar.Insert: _insert, grammar.Update: _update, grammar.Delete: _delete}

    def _select(self, sql: str, words: list[str]) -> Result:
        if "FROM" not in (w.upper() for w in words):
            return Result("SELECT 1", literal_select(self.spark, sql.strip()[6:].strip()))
        plain = grammar.plain_select(sql)
        if plain and plain.table not in self.tables() and not self.spark.catalog.tableExists(plain.table):
            raise CatalogError(f"there is no table {plain.table}")
        if self.text_equality and plain and plain.where and plain.table in self.tables():
            t = self._table(plain.table)
            columns = t.schema.names if plain.columns == "*" else [identifier(c) for c in lexer.split_on(plain.columns, ",")]
            if unknown := [c for c in columns if c not in t.schema.names]:
                raise CatalogError(f"{t.name} has no column {unknown[0]}")
            return Result("SELECT", self.store.view(t).filter(self._condition(t, plain.where)).select(*columns))
        out = self._query(sql)
        if plain and not plain.where and plain.table in self.tables() and self._table(plain.table).primary_key in out.columns:
            out = out.orderBy(self._table(plain.table).primary_key)
        return Result("SELECT", out)

    def _query(self, sql: str) -> DataFrame:
        """A query over snapshot views. The views stand only while the query is analysed; a temporary view of the caller's that has such a name comes back after."""
        names = [n for n in lexer.table_names(sql) if n in self.tables()]
        kept = {n: self.spark.table(n) for n in names if any(v.isTemporary for v in self.spark.catalog.listTables(pattern=n))}
        try:
            for n in names:
                self.store.view(self._table(n)).createOrReplaceTempView(n)
            return self.spark.sql(sql)
        finally:
            for n in names:
                if n in kept:
                    kept[n].createOrReplaceTempView(n)
                else:
                    self.spark.catalog.dropTempView(n)
