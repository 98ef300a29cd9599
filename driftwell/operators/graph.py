"""Wait-for graphs: who waits for whom, and who is in a cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """(node) of nodes that can reach themselves over (waiter, holder) edges, in ``longest`` steps at most (None: any number).

    Without a bound, edges that no cycle can hold go first: those whose ends have no way in or
    no way out. What is left is cut into strongly connected components by colours: a node's
    colour is the smallest node that reaches it, and what reaches that node within the colour
    is its component. Tables stay as large as the edges, whatever the components' size; each
    round is cut from its past in the checkpoint folder.
    """
    e = edges.select("waiter", "holder").dropna().distinct()
    if longest is not None:
        reach, walk = e, e
        for _ in range(longest - 1):
            walk = walk.join(e.toDF("holder", "next"), "holder").select("waiter", F.col("next").alias("holder")).distinct()
            reach = reach.unionByName(walk)
        return reach.filter("waiter = holder").select(F.col("waiter").alias("node")).distinct()
    found = e.filter("waiter = holder").select(F.col("waiter").alias("node")).checkpoint()
    e = _trimmed(e.filter("waiter <> holder"))
    while not e.isEmpty():
        colour = _coloured(e)
        ends = e.join(colour.toDF("waiter", "from"), "waiter").join(colour.toDF("holder", "to"), "holder")
        inner = ends.filter("from = to").select("waiter", "holder", F.col("from").alias("colour")).checkpoint()
        own = _component(inner)
        found = found.unionByName(own).distinct().checkpoint()
        rest = inner.select("waiter", "holder").join(own.toDF("waiter"), "waiter", "left_anti").join(own.toDF("holder"), "holder", "left_anti")
        e = _trimmed(rest)
    return found.distinct()


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges without those whose ends have no way in or no way out, round by round."""
    before = -1
    while (n := (e := e.checkpoint()).count()) != before:
        before = n
        e = e.join(e.select(F.col("waiter").alias("holder")).distinct(), "holder", "left_semi").join(e.select(F.col("holder").alias("waiter")).distinct(), "waiter", "left_semi").select("waiter", "holder")
    return e


def _coloured(e: DataFrame) -> DataFrame:
    """(node, colour): the smallest node that reaches each node, itself included."""
    colour = e.select(F.explode(F.array("waiter", "holder")).alias("node")).distinct().withColumn("colour", F.col("node"))
    while True:
        sent = e.join(colour.toDF("waiter", "sent"), "waiter").groupBy(F.col("holder").alias("node")).agg(F.min("sent").alias("sent"))
        step = colour.join(sent, "node", "left").select("node", F.least("colour", "sent").alias("colour"), F.col("colour").alias("was")).checkpoint()
        colour = step.select("node", "colour")
        if step.filter("colour <> was").isEmpty():
            return colour


def _component(inner: DataFrame) -> DataFrame:
    """(node) of the nodes that reach their colour's node over edges of one colour, where others do; that node too."""
    own = inner.filter("holder = colour").select(F.col("colour").alias("node")).distinct().checkpoint()
    new = own
    while not new.isEmpty():
        back = inner.join(new.toDF("holder"), "holder", "left_semi").select(F.col("waiter").alias("node")).distinct()
        new = back.join(own, "node", "left_anti").checkpoint()
        own = own.unionByName(new).checkpoint()
    return own
