"""Latency summaries with floor-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANKS = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def value_range(value: Column) -> Column:
    """The number of a value's range; it rises with the value. Ranges are about 1/4096 of an octave wide, so their number does not grow with the rows."""
    v = value.cast("double")
    top = F.lit(1 << 40)
    return F.when(F.isnan(v), top + 1).when(F.abs(v) == float("inf"), F.signum(v).cast("long") * top).otherwise(F.floor(F.signum(v) * F.log2(1 + F.abs(v)) * 4096).cast("long"))


def summary(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, avg, min, max and p50, p95, p99 of each group.

    A percentile is the value at rank int((n - 1) * p). Values are first counted by range, in
    partial aggregates; the ranges' running counts say which one holds a rank, and only the
    values of those ranges are then ranked. So neither a task nor a row gets a whole group.
    """
    full = rows.filter(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).alias("_v"), value_range(F.col(value)).alias("_r"))
    counts = full.groupBy("_g", "_r").agg(F.count("*").alias("c"), F.sum("_v").alias("total"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    own, so_far = Window.partitionBy("_g"), Window.partitionBy("_g").orderBy("_r")
    counts = counts.withColumn("n", F.sum("c").over(own)).withColumn("before", F.sum("c").over(so_far) - F.col("c"))
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("what"), ((F.col("n") - 1) * F.lit(p)).cast("long").alias("rank")) for k, p in RANKS.items())))
    held = counts.select("_g", "_r", "c", "before", wanted.alias("w")).filter("w.rank >= before and w.rank < before + c").select("_g", "_r", "w.what", (F.col("w.rank") - F.col("before")).alias("rank"))
    # a group has as many rows here as there are percentiles
    few = full.join(held.select(F.col("_g").alias("_hg"), F.col("_r").alias("_hr")).distinct(), F.col("_g").eqNullSafe(F.col("_hg")) & (F.col("_r") == F.col("_hr")), "left_semi")
    ranked = few.groupBy("_g", "_r", "_v").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.partitionBy("_g", "_r").orderBy("_v")))
    hit = ranked.join(held.toDF("_hg", "_hr", "what", "rank"), F.col("_g").eqNullSafe(F.col("_hg")) & (F.col("_r") == F.col("_hr"))).filter("rank < upto and rank >= upto - c")
    picks = hit.groupBy(F.col("_g").alias("_pg")).agg(*(F.min(F.when(F.col("what") == k, F.col("_v"))).alias(k) for k in RANKS))
    sums = counts.groupBy("_g").agg(F.sum("c").alias("n"), (F.sum("total") / F.sum("c")).alias("avg"), F.min("lo").alias("min"), F.max("hi").alias("max"))
    return sums.join(picks, F.col("_g").eqNullSafe(F.col("_pg"))).select(F.col("_g").alias(group), "n", "avg", "min", "max", *RANKS)


def iteration_delta(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Each iteration's change of ``value`` against the one before."""
    return rows.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(group).orderBy(order)))


def report(summaries: DataFrame, path: str) -> None:
    """Write summaries as JSON lines, one for each group."""
    summaries.write.mode("overwrite").json(path)
