"""Rows of the benchmark's shape, of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Categories by i mod 4, statuses by i mod 2; a quarter of the rows is hot and active.
CATEGORIES = ("hot", "warm", "cool", "cold")
STATUSES = ("active", "inactive")


def seeds(spark: SparkSession, table: str, rows: int) -> DataFrame:
    """(id, category, status, payload) for i from 0 to rows - 1."""
    i = F.col("id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (i % len(values)).cast("int") + 1)
    number = F.lpad(i.cast("string"), 4, "0")
    return spark.range(rows).select(
        F.concat(F.lit(f"{table}_seed_"), F.when(i < 10_000, number).otherwise(i.cast("string"))).alias("id"),
        pick(CATEGORIES).alias("category"),
        pick(STATUSES).alias("status"),
        F.concat(F.lit("payload-"), F.when(i < 10_000, number).otherwise(i.cast("string")), F.lit("-" + "x" * 24)).alias("payload"),
    )
