"""Views of a change log: newest wins, ranges, compaction.

A log row has key columns, ``op`` ("P" puts, "D" deletes), a total order ``seq`` and payload
columns. All functions return lazy DataFrames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key.

    ``row_number() = 1`` becomes a window group limit, so each task forwards one row of a key
    and hot keys do not crowd the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return log.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def live(log: DataFrame, keys: list[str], order: list[str], op: str = "op") -> DataFrame:
    """The newest version of each key that is not deleted."""
    return newest(log, keys, order).filter(F.col(op) != "D")


def overlay(base: DataFrame, changes: DataFrame, keys: list[str], seq: str = "_seq", op: str = "_op") -> DataFrame:
    """``base`` (keys unique in time: a key is put again only after a delete) under later ``changes``.

    Only the changes are reduced to the newest of each key; the base is scanned with its
    pushed filters and meets their keys in one join, which is a broadcast while they are
    few and a shuffle of the keys and the base beyond.
    """
    last = newest(changes, keys, [seq])
    keyed = last.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col(seq).alias("_later"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k_{k}") for k in keys])
    kept = base.join(keyed, same & (F.col(seq) < F.col("_later")), "left_anti")
    return kept.unionByName(last.filter(F.col(op) == "P"))


def key_range(view: DataFrame, key: str, low=None, high=None) -> DataFrame:
    """Rows with low <= key <= high; a bound of None is open; low > high is an error."""
    if low is not None and high is not None and low > high:
        raise ValueError("the lower bound is above the upper bound")
    bounds: list[Column] = ([F.col(key) >= F.lit(low)] if low is not None else []) + ([F.col(key) <= F.lit(high)] if high is not None else [])
    return reduce(lambda d, c: d.filter(c), bounds, view)


def whole_database(tables: dict[str, tuple[DataFrame, str | list[str]]]) -> DataFrame:
    """(table_name, key) of every row of every table, by name; several key columns are joined by commas; None without tables is an error."""

    def key(k: str | list[str]) -> Column:
        return F.col(k).cast("string") if isinstance(k, str) else F.array_join(F.array(*(F.col(c).cast("string") for c in k)), ",", "")

    parts = [d.select(F.lit(n).alias("table_name"), key(k).alias("key")) for n, (d, k) in sorted(tables.items())]
    if not parts:
        raise ValueError("there are no tables")
    return reduce(DataFrame.unionByName, parts)


def compact(log: DataFrame, keys: list[str], order: list[str], op: str = "op", full: bool = True) -> DataFrame:
    """One version of each key; tombstones go only in a full compaction, as partial ones may still hide older versions."""
    return live(log, keys, order, op) if full else newest(log, keys, order)


def ranked(view: DataFrame, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """``view`` with each row's place in ``order``, from 1.

    ``bucket`` must rise with the order and split the rows into groups that a task can sort:
    a row's place is the rows of smaller buckets and its place in its own, so no task sees
    the whole table, only the sizes of its buckets.
    """
    rows = view.withColumn("_b", bucket)
    before = F.sum("n").over(Window.orderBy("_b")) - F.col("n")
    sizes = rows.groupBy("_b").agg(F.count("*").alias("n")).select("_b", before.alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return rows.join(sizes, "_b").withColumn(name, F.col("_before") + inner).drop("_b", "_before")
