"""Analysis, redo, undo and replay of a write-ahead log, as joins, aggregates and windows.

A log has ``lsn`` (a total order), ``txn``, ``k`` (key or page), ``ty`` and ``v``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import snapshot


def transaction_states(log: DataFrame, state: Column, lsn: str = "lsn", txn: str = "txn") -> DataFrame:
    """(txn, state, last_lsn): ``state`` of each transaction's last record. Partial aggregates meet in the shuffle."""
    return log.groupBy(txn).agg(F.max_by(state, F.col(lsn)).alias("state"), F.max(lsn).alias("last_lsn"))


def summary(log: DataFrame, states: DataFrame, committed: str = "C", txn: str = "txn") -> DataFrame:
    """One row: highest transaction, transactions, committed ones."""
    return states.agg(F.max(txn).alias("max_txn"), F.count("*").alias("txns"), F.count_if(F.col("state") == committed).alias("commits"))


def dirty_pages(log: DataFrame, page: str = "k", lsn: str = "lsn") -> DataFrame:
    """The first record that touched each page."""
    return log.groupBy(page).agg(F.min(lsn).alias("rec_lsn"))


def redo(log: DataFrame, page: str = "k", lsn: str = "lsn", after: str = "v") -> DataFrame:
    """Each page's last after-image, whoever wrote it."""
    return log.groupBy(page).agg(F.max_by(after, lsn).alias("after"), F.max(lsn).alias("page_lsn"))


def redo_lists(log: DataFrame, states: DataFrame, aborted: str = "A", lsn: str = "lsn", txn: str = "txn", chunk: int = 1_000_000) -> DataFrame:
    """(txn, part, lsns): the records to redo of each transaction that was not aborted, in order; a part spans ``chunk`` lsns, so a row is bounded."""
    kept = log.join(states.filter(F.col("state") == aborted).select(txn), txn, "left_anti")
    return kept.groupBy(txn, F.floor(F.col(lsn) / chunk).alias("part")).agg(F.sort_array(F.collect_list(lsn)).alias("lsns"))


def before_images(log: DataFrame, page: str = "k", lsn: str = "lsn", after: str = "v") -> DataFrame:
    """Each record with the value that it overwrote."""
    return log.withColumn("before", F.lag(after).over(Window.partitionBy(page).orderBy(lsn)))


def undo(log: DataFrame, states: DataFrame, aborted: list[str], page: str = "k", lsn: str = "lsn", txn: str = "txn") -> DataFrame:
    """For each (txn, page) of an undone transaction, the value before its first write."""
    lost = states.filter(F.col("state").isin(*aborted)).select(txn)
    return before_images(log, page, lsn).join(lost, txn, "left_semi").groupBy(txn, page).agg(F.min_by("before", lsn).alias("restore"))


def replay(log: DataFrame, states: DataFrame, committed: str = "C", key: str = "k", lsn: str = "lsn", txn: str = "txn") -> DataFrame:
    """The newest committed record of each key, ordered by commit and then by lsn."""
    done = states.filter(F.col("state") == committed).select(txn, F.col("last_lsn").alias("commit_lsn"))
    return snapshot.newest(log.join(done, txn), [key], ["commit_lsn", lsn])


def chains(log: DataFrame, lsn: str = "lsn", txn: str = "txn", page: str = "k") -> DataFrame:
    """Each record with the one before it of its transaction and of its page."""
    return log.withColumn("prev_lsn", F.lag(lsn).over(Window.partitionBy(txn).orderBy(lsn))).withColumn("page_lsn", F.lag(lsn).over(Window.partitionBy(page).orderBy(lsn)))


def roll_back_to(ops: DataFrame, savepoint: int, txn: str = "txn", seq: str = "seq") -> DataFrame:
    """The first ``savepoint`` operations of each transaction; later ones are undone."""
    return ops.withColumn("_nth", F.row_number().over(Window.partitionBy(txn).orderBy(seq))).filter(F.col("_nth") <= savepoint).drop("_nth")


def read_own_writes(ops: DataFrame, key: str = "k", seq: str = "seq", write: Column | None = None, value: str = "v") -> DataFrame:
    """Each operation with the value that a read of its key sees then: the last write up to it."""
    write = F.col("f") == "w" if write is None else write
    w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ops.withColumn("seen", F.last(F.when(write, F.col(value)), ignorenulls=True).over(w))
