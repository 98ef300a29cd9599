"""Transaction lists as JSON lines: ``{"txn": 1, "ops": [["r", "k", null], ["w", "k", "v"]]}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "txn long, ops array<array<string>>"


def read_ops(spark: SparkSession, path: str) -> DataFrame:
    """(txn, seq, f, k, v): every operation; ``seq``, the pair of its transaction and its place there, orders them all."""
    ops = spark.read.schema(SCHEMA).json(path).select("txn", F.posexplode("ops").alias("nth", "op"))
    return ops.select("txn", F.struct("txn", "nth").alias("seq"), F.col("op")[0].alias("f"), F.col("op")[1].alias("k"), F.get("op", F.lit(2)).alias("v")).filter(F.col("f").isin("r", "w"))


def write_results(seen: DataFrame, path: str) -> None:
    """Operations with what reads saw, as JSON lines of the same form."""
    value = F.when(F.col("f") == "r", F.col("seen")).otherwise(F.col("v"))
    done = seen.groupBy("txn").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.array("f", "k", value).alias("op")))), lambda x: x["op"]).alias("ops"))
    done.write.json(path)
