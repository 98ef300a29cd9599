"""Insert, update and delete as transforms of a table; predicates that are null count as false."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """A row breaks a primary key, a unique index, NOT NULL or a column's type."""


def holds(predicate: Column | None) -> Column:
    return F.lit(True) if predicate is None else F.coalesce(predicate, F.lit(False))


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns that the rows lack become null; columns that the table lacks are an error."""
    if extra := set(rows.columns) - set(table.columns):
        raise ConstraintError(f"no such column: {', '.join(sorted(extra))}")
    return table.unionByName(rows, allowMissingColumns=True)


def duplicates(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the table already has; only the key columns of the table are read."""
    return rows.join(table.select(*keys), keys, "left_semi")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def update(table: DataFrame, values: dict[str, Column], predicate: Column | None = None, key: str | None = None) -> DataFrame:
    if key in values:
        raise ConstraintError("a primary key cannot be updated")
    if missing := set(values) - set(table.columns):
        raise ConstraintError(f"no such column: {', '.join(sorted(missing))}")
    kinds = dict(table.dtypes)
    hit = holds(predicate)
    return table.withColumns({c: F.when(hit, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()})


def delete(table: DataFrame, predicate: Column | None = None) -> DataFrame:
    return table.filter(~holds(predicate))


def delete_keys(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys, on, "left_anti")


def matches(table: DataFrame, equal: dict[str, object], text: bool = False) -> Column:
    """The conjunction of column = value. ``text``: values compare as text and null is the empty string."""
    from ..functions.scalars import as_text

    parts = [as_text(F.col(c)) == F.lit("" if v is None else str(v)) if text else F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in equal.items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)


def affected(table: DataFrame, **predicates: Column) -> DataFrame:
    """One row: how many rows each predicate hits."""
    return table.agg(*(F.count_if(holds(p)).alias(n) for n, p in predicates.items()))
