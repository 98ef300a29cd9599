"""Outcomes of replicated commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("local", "async", "sync", "quorum")


def outcomes(acks: DataFrame, mode: str = "quorum", min_acks: int = 2, txn: str = "txn", ack: str = "ack") -> DataFrame:
    """(txn, replicas, acks, required, ok): local and async ask for none, sync for all, quorum for least(min_acks, replicas)."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    n = F.count("*")
    required = {"sync": n, "quorum": F.least(F.lit(min_acks).cast("long"), n)}.get(mode, F.lit(0).cast("long"))
    got = F.count_if(F.col(ack))
    return acks.groupBy(txn).agg(n.alias("replicas"), got.alias("acks"), required.alias("required")).withColumn("ok", F.col("acks") >= F.col("required"))


def stale_terms(messages: DataFrame, seq: str = "seq", term: str = "term", node: str = "node") -> DataFrame:
    """Messages of a lower term than their node has seen before."""
    from pyspark.sql import Window

    w = Window.partitionBy(node).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("_seen", F.max(term).over(w)).filter(F.col(term) < F.col("_seen")).drop("_seen")
