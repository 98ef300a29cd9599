"""Scalar and aggregate expressions of the engine, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_text(c: Column) -> Column:
    """How text comparison sees a value: null is the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def typed_order(c: Column, kind: str = "bigint") -> list[Column]:
    """Sort keys of a primary key that may hold values as text: what parses as ``kind`` by value, then text by code point.

    ``kind`` is bigint, double or boolean (false before true); space around a value does not count.
    """
    value = F.trim(c.cast("string")).try_cast(kind)
    return [value.isNull(), value, c.cast("string")]


def floor_rank(c: Column, p: float) -> Column:
    """The value at 0-based rank int((n - 1) * p) of a group's values; null without values.

    The group's non-null values are gathered, so groups must be of bounded size; for
    unbounded ones see ``driftwell.operators.latency.summary``.
    """
    values = F.sort_array(F.collect_list(c))
    return F.element_at(values, ((F.size(values) - 1) * F.lit(p)).cast("int") + 1)


def node_id(host_port: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of a lower-case address."""
    return F.substring(F.sha2(F.lower(host_port), 256), 1, 16)


# levels' growth and how it decays, capacity of level 0, entries of a memory table.
GROWTH, DECAY, LEVEL0, MEMTABLE = 10.0, 0.5, 4, 100


def level_count(items: Column) -> Column:
    """Levels of a merge tree of so many items."""
    ratio = items.cast("double") / F.lit(MEMTABLE * GROWTH)
    levels = F.ceil(F.sqrt(F.abs(F.log(ratio) / F.lit(math.log(1 / DECAY)))))
    return F.when(items <= LEVEL0 * MEMTABLE, 1).otherwise(F.greatest(levels, F.lit(1))).cast("int")


def level_capacity(level: Column, top: Column) -> Column:
    """Runs that ``level`` may hold if the deepest is ``top``: level 0's, times growth / decay^(top - i) for each i up to the level."""
    each = F.lit(float(GROWTH)) / F.pow(F.lit(DECAY), top.cast("double"))
    exponent = level * (level + 1) / 2
    return F.when((level == 0) | (top <= 0), LEVEL0).otherwise(F.round(F.lit(float(LEVEL0)) * F.pow(each, level.cast("double")) * F.pow(F.lit(DECAY), exponent.cast("double")))).cast("long")


def bloom_bits(items: Column, rate: float = 0.01) -> Column:
    """Bits of a Bloom filter for so many items and this share of false hits."""
    n = F.greatest(items, F.lit(1)).cast("double")
    return F.ceil(n * F.lit(math.log(rate)) / F.log(F.lit(1.0) / F.pow(F.lit(2.0), F.log(F.lit(2.0))))).cast("long")


def bloom_hashes(bits: Column, items: Column) -> Column:
    """Hash functions of a Bloom filter: the number that makes false hits rarest, 1 at least."""
    n = F.greatest(items, F.lit(1)).cast("double")
    return F.greatest(F.round(bits.cast("double") / n * F.log(F.lit(2.0))), F.lit(1)).cast("int")


# The 64-bit FNV-1a hash starts from this number and multiplies by 2^40 + 435.
FNV_START, FNV_SHIFT, FNV_REST = 0xCBF29CE484222325, 40, 435


def fnv1a(c: Column) -> Column:
    """The 64-bit FNV-1a hash of a text's bytes, as a struct of its lower and upper 32 bits; the empty text for null.

    The halves are kept apart in longs, so no step overflows.
    """
    m = (1 << 32) - 1
    h = F.hex(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))
    size = (F.length(h) / 2).cast("int")
    each = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    codes = F.transform(each, lambda i: F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint"))

    def step(s: Column, b: Column) -> Column:
        low = s["low"].bitwiseXOR(b)
        up = low * FNV_REST
        high = s["high"] * FNV_REST + F.shiftrightunsigned(up, 32) + F.shiftleft(low, FNV_SHIFT - 32)
        return F.struct(up.bitwiseAND(F.lit(m)).alias("low"), high.bitwiseAND(F.lit(m)).alias("high"))

    start = F.struct(F.lit(FNV_START & m).cast("bigint").alias("low"), F.lit(FNV_START >> 32).cast("bigint").alias("high"))
    return F.aggregate(codes, start, step)


def bloom_positions(c: Column, bits: Column, hashes: Column) -> Column:
    """The bits that a value sets: the lower half of its hash plus 0, 1, 2, ... times the upper half."""
    h = fnv1a(c)
    return F.transform(F.sequence(F.lit(0), hashes - 1), lambda i: F.pmod(h["low"] + i * h["high"], bits))


def bloom_budget(items: Column, level: Column, levels: Column, total_bits: Column, weight_sum: Column, growth: float = GROWTH, decay: float = DECAY) -> Column:
    """Bits of a level's filter when levels share ``total_bits`` by weight; ``weight_sum`` is the sum of ``bloom_weight`` over levels."""
    return F.when(weight_sum > 0, F.round(bloom_weight(items, level, levels, growth, decay) / weight_sum * total_bits)).otherwise(0).cast("long")


def bloom_weight(items: Column, level: Column, levels: Column, growth: float = GROWTH, decay: float = DECAY) -> Column:
    """What a level's items weigh: the deeper the level, the more bits an item is worth."""
    up = (levels - 1 - level).cast("double")
    return items.cast("double") * F.pow(F.lit(decay), up * (up + 1) / 2) / F.pow(F.lit(growth), up)


def bloom_rate(level: Column, levels: Column, growth: float = GROWTH, decay: float = DECAY) -> Column:
    """The share of false hits that suits a level: 1 for the deepest, 0.0001 at least."""
    up = (levels - 1 - level).cast("double")
    rate = F.pow(F.lit(decay), up * (up - 1) / 2) / F.pow(F.lit(growth), up)
    return F.when(up <= 0, 1.0).otherwise(F.least(F.greatest(rate, F.lit(0.0001)), F.lit(1.0)))
