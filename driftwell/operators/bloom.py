"""Bloom filters as tables of 64-bit words, so that a filter of any size is distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars


def sized(items: int, rate: float = 0.01) -> tuple[Column, Column]:
    """Bits and hash functions of a filter for so many items."""
    bits = scalars.bloom_bits(F.lit(items).cast("long"), rate)
    return bits, scalars.bloom_hashes(bits, F.lit(items).cast("long"))


def build(keys: DataFrame, key: str, bits: Column, hashes: Column) -> DataFrame:
    """(word, mask): the words of the filter of all keys that have a bit set. Tasks send each word once."""
    at = F.explode(scalars.bloom_positions(F.col(key), bits, hashes))
    return keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask"))


def might_hold(words: DataFrame, keys: DataFrame, key: str, bits: Column, hashes: Column) -> DataFrame:
    """(key, maybe) for each different key: whether the filter has all its bits."""
    asked = keys.select(F.col(key).alias("key")).distinct().withColumn("at", F.explode(scalars.bloom_positions(F.col("key"), bits, hashes)))
    asked = asked.withColumn("word", F.floor(F.col("at") / 64))
    hit = asked.join(words, "word", "left").withColumn("on", F.coalesce(F.expr("(shiftrightunsigned(mask, cast(at % 64 as int)) & 1) = 1"), F.lit(False)))
    return hit.groupBy("key").agg(F.bool_and("on").alias("maybe"))
