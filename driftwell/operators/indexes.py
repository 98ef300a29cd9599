"""Secondary indexes as posting lists: each indexed value with the primary keys that have it.

Values with very many keys are cut into chunks (``part``), so that a posting list is never
one unbounded row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNKS = 64
#: Keys of a chunk, about, where the number of chunks follows the table.
CHUNK_KEYS = 1_000_000


def value_of(columns: list[str]) -> Column:
    """What an index files a row under: several columns make a JSON array, one is itself."""
    return F.col(columns[0]) if len(columns) == 1 else F.to_json(F.array(*(F.col(c).cast("string") for c in columns)))


def chunks_for(rows: int) -> int:
    """Chunks that keep a posting list's rows bounded whichever value they all have."""
    return max(1, -(-rows // CHUNK_KEYS))


def _part(chunks: int) -> Column:
    return F.pmod(F.xxhash64("pk"), F.lit(chunks)).cast("int")


def _lists(rows: DataFrame) -> DataFrame:
    return rows.groupBy("value", "part").agg(F.sort_array(F.collect_set("pk")).alias("pks"))


def entries(table: DataFrame, columns: list[str], pk: str) -> DataFrame:
    """(value, pk) of rows that have all indexed columns."""
    full = table
    for c in columns:
        full = full.filter(F.col(c).isNotNull())
    return full.select(value_of(columns).alias("value"), F.col(pk).alias("pk"))


def build(table: DataFrame, columns: list[str], pk: str, chunks: int = 1) -> DataFrame:
    """(value, part, pks): sorted distinct keys of each value, in ``chunks`` parts by a hash of the key."""
    return _lists(entries(table, columns, pk).withColumn("part", _part(chunks)))


def postings(index: DataFrame) -> DataFrame:
    """(value, part, pk): a row for each key of each list."""
    return index.select("value", "part", F.explode("pks").alias("pk"))


def add(index: DataFrame, new: DataFrame, chunks: int = 1) -> DataFrame:
    """Postings after (value, pk) rows were added; ``chunks`` as the index was built with."""
    return _lists(postings(index).unionByName(new.select("value", _part(chunks).alias("part"), "pk")))


def remove(index: DataFrame, gone: DataFrame) -> DataFrame:
    """Postings without (value, pk) rows; values left without keys go."""
    return _lists(postings(index).join(gone.select("value", "pk"), ["value", "pk"], "left_anti"))


def refreshed(index: DataFrame, touched: DataFrame, now: DataFrame, chunks: int) -> DataFrame:
    """Postings after rows with the keys ``touched`` (pk) changed; ``now`` are their (value, pk) entries, if any."""
    rest = postings(index).join(touched.select("pk").distinct(), "pk", "left_anti")
    return _lists(rest.select("value", "part", "pk").unionByName(now.select("value", _part(chunks).alias("part"), "pk")))


def compact(index: DataFrame, chunks: int) -> DataFrame:
    """The same postings in another number of chunks; lists without keys go."""
    return _lists(postings(index).select("value", _part(chunks).alias("part"), "pk"))


def clear(index: DataFrame) -> DataFrame:
    """No postings, in the index's columns."""
    return index.limit(0)


def encoded(index: DataFrame) -> DataFrame:
    """(value, part, entry): each list as bytes: how many keys, then the length and the bytes of each key as text; numbers are 4 bytes, the highest first."""
    number = lambda n: F.lpad(F.hex(n.cast("long")), 8, "0")
    text = F.transform("pks", lambda k: k.cast("string"))
    keys = F.array_join(F.transform(text, lambda k: F.concat(number(F.octet_length(k)), F.hex(k.cast("binary")))), "")
    return index.select("value", "part", F.unhex(F.concat(number(F.size("pks")), keys)).alias("entry"))


def decoded(entries: DataFrame) -> DataFrame:
    """(value, part, pks) of ``encoded`` rows, the keys as text; bytes that end within a key are an error.

    A step of an aggregate copies all that it has gathered, and a row gives its bytes out as a copy. So the
    entry is bound to a variable once, and a first pass finds where each block of keys begins, a second
    reads the blocks; of n keys, a block has the cube root, so that copies grow with n^(4/3) at most.
    """

    def read(e: Column) -> Column:
        number = lambda at: F.conv(F.hex(F.substring(e, at, F.lit(4))), 16, 10).cast("int")
        n = F.least(number(F.lit(1)), F.floor(F.octet_length(e) / 4).cast("int"))  # more keys than that have no room
        size = F.ceil(F.cbrt(n)).cast("int")
        each = lambda begin: F.sequence(F.lit(1), F.least(size, n - begin))
        begins = F.when(n > 0, F.sequence(F.lit(0), n - 1, size)).otherwise(F.array().cast("array<int>"))

        def skip(s: Column, begin: Column) -> Column:
            return F.struct(F.aggregate(each(begin), s["at"], lambda at, _: at + 4 + number(at)).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts"))

        def key(s: Column, _: Column) -> Column:
            length = number(s["at"])
            return F.struct((s["at"] + 4 + length).alias("at"), F.concat(s["keys"], F.array(F.substring(e, s["at"] + 4, length).cast("string"))).alias("keys"))

        def whole(s: Column) -> Column:
            return F.when(s["at"] == F.octet_length(e) + 1, s["starts"]).otherwise(F.raise_error(F.lit("an entry ends within a key")))

        starts = F.aggregate(begins, F.struct(F.lit(5).alias("at"), F.array().cast("array<int>").alias("starts")), skip, whole)
        none = F.array().cast("array<string>").alias("keys")
        return F.flatten(F.transform(starts, lambda at, k: F.aggregate(each(k * size), F.struct(at.alias("at"), none), key, lambda s: s["keys"])))

    return entries.select("value", "part", F.transform(F.array("entry"), read)[0].alias("pks"))


def lookup(index: DataFrame, value) -> DataFrame:
    """Primary keys with this value."""
    return index.filter(F.col("value") == F.lit(value)).select(F.explode("pks").alias("pk"))


def lookup_range(index: DataFrame, low, high) -> DataFrame:
    """Primary keys with values from low to high."""
    return index.filter(F.col("value").between(low, high)).select("value", F.explode("pks").alias("pk"))


def fetch(index: DataFrame, table: DataFrame, pk: str, value) -> DataFrame:
    """Rows of the table that the index has under this value."""
    return table.join(lookup(index, value).withColumnRenamed("pk", pk), pk, "left_semi")


def stats(index: DataFrame) -> DataFrame:
    """Values, postings, and the longest list."""
    n = index.groupBy("value").agg(F.sum(F.size("pks")).alias("n"))
    return n.agg(F.count("*").alias("distinct_values"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings"), F.coalesce(F.max("n"), F.lit(0)).alias("longest"))


def validate(index: DataFrame, table: DataFrame, columns: list[str], pk: str) -> DataFrame:
    """(value, pk, problem) of postings that the table does not have and rows that the index lacks."""
    have = index.select("value", F.explode("pks").alias("pk")).withColumn("i", F.lit(True))
    want = entries(table, columns, pk).withColumn("t", F.lit(True))
    return have.join(want, ["value", "pk"], "full").filter("i IS NULL OR t IS NULL").select("value", "pk", F.when(F.col("i").isNull(), "missing").otherwise("stale").alias("problem"))


def violations(table: DataFrame, columns: list[str]) -> DataFrame:
    """Values that a unique index would not allow, with how often they occur; rows with nulls never clash."""
    full = table
    for c in columns:
        full = full.filter(F.col(c).isNotNull())
    return full.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")
