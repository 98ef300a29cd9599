"""Exact deduplication with a cuckoo-filter index.

Equal texts share the SHA-256 of the text in which each run of ASCII white space is one
space. Digests go through a cuckoo index twice: once in each scan task, which leaves about
one row for each digest of the task (so that a text with a third of all rows crosses the
shuffle a few times for each task), and once in the task that owns the digest. An index of a
scan task is given out and begun anew at ``FLUSH`` digests; the tasks that own digests are so
many that each gets about ``OWNED`` rows at most. The classes then meet their documents on (digest, salt); the salt comes from doc_id, so a hot text is
spread over ``SALTS`` join keys.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._stage import lean, release, staged

SPACES = r"[\x20\x09-\x0D]+"
SALTS = 64
SLOTS = 4
#: Live digests at which a scan task's index is given out; rows of a task that owns digests.
FLUSH, OWNED = 200_000, 1_000_000


class CuckooIndex:
    """A cuckoo filter whose slots also hold the full keys.

    The filter answers from 16-bit fingerprints; a hit counts only after the key in the
    same slot proves equal. ``add`` merges (smallest id, rows, salts) into a live key or
    inserts it, ``delete`` takes rows away and frees the slot of a key that has none left.
    When an insert finds no free slot within ``kicks`` moves, the table doubles and is
    filled again from the stored keys.

    >>> i = CuckooIndex(); i.add(b"a" * 32, 7, 1, 1); i.add(b"a" * 32, 3, 1, 2)
    >>> i.get(b"a" * 32)
    (3, 2, 3)
    >>> i.delete(b"a" * 32, 2); i.get(b"a" * 32) is None
    True
    """

    def __init__(self, buckets: int = 64, kicks: int = 200) -> None:
        self.kicks, self.live = kicks, 0
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.buckets = buckets
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.keys: list[bytes | None] = [None] * (SLOTS * buckets)
        self.rows: list[tuple | None] = [None] * (SLOTS * buckets)

    def _where(self, key: bytes) -> tuple[int, int, int]:
        h = int.from_bytes(key[:8], "little")
        p = (h >> 48) or 1
        i = h & (self.buckets - 1)
        return p, i, self._other(i, p)

    def _other(self, i: int, p: int) -> int:
        return (i ^ (p * 0x5BD1E995)) & (self.buckets - 1)

    def _find(self, key: bytes) -> int:
        p, i, j = self._where(key)
        for b in (i, j):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.prints[s] == p and self.keys[s] == key:
                    return s
        return -1

    def get(self, key: bytes) -> tuple | None:
        return self.rows[s] if (s := self._find(key)) >= 0 else None

    def add(self, key: bytes, first: int | None, n: int, salts: int) -> None:
        if (s := self._find(key)) >= 0:
            f, m, t = self.rows[s]
            self.rows[s] = (first if f is None else f if first is None else min(f, first), m + n, t | salts)
            return
        self.live += 1
        self._insert(key, (first, n, salts))

    def _insert(self, key: bytes, row: tuple) -> None:
        p, i, j = self._where(key)
        at = i
        for kick in range(self.kicks):
            for b in (i, j) if kick == 0 else (at,):
                for s in range(b * SLOTS, b * SLOTS + SLOTS):
                    if not self.prints[s]:
                        self.prints[s], self.keys[s], self.rows[s] = p, key, row
                        return
            s = at * SLOTS + (kick * 7 + p) % SLOTS
            (p, self.prints[s]), (key, self.keys[s]), (row, self.rows[s]) = (self.prints[s], p), (self.keys[s], key), (self.rows[s], row)
            at = self._other(at, p)
        kept = [*self.items(), (key, row)]
        self._empty(2 * self.buckets)
        for k, r in kept:
            self._insert(k, r)

    def delete(self, key: bytes, n: int = 1) -> None:
        if (s := self._find(key)) < 0:
            return
        f, m, t = self.rows[s]
        if m > n:
            self.rows[s] = (f, m - n, t)
        else:
            self.prints[s], self.keys[s], self.rows[s] = 0, None, None
            self.live -= 1

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        return ((k, r) for k, r in zip(self.keys, self.rows, strict=True) if k is not None)


def text_digest(text: Column) -> Column:
    """Hex SHA-256 of the normalised text; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ").cast("binary"), 256)


def _ids(s: pd.Series) -> list:
    return [None if x is None or x != x else int(x) for x in s.astype(object)]


def _indices(frames: Iterator[pd.DataFrame], flush: int | None = None) -> Iterator[CuckooIndex]:
    """One index of all rows, or several of which each has ``flush`` digests at most."""
    index = CuckooIndex()
    for f in frames:
        for k, i, n, t in zip(f["digest"], _ids(f["first"]), f["n"], f["salts"], strict=True):
            index.add(bytes(k), i, int(n), int(t) & (2**SALTS - 1))
            if flush and index.live >= flush:
                yield index
                index = CuckooIndex()
    yield index


def _signed(t: int) -> int:
    return t - 2**SALTS if t >= 2 ** (SALTS - 1) else t


def _partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for index in _indices(frames, FLUSH):
        rows = [(k, f, n, _signed(t)) for k, (f, n, t) in index.items()]
        for at in range(0, len(rows), 20_000):
            yield _table(rows[at : at + 20_000], ["digest", "first", "n", "salts"])


def _final(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = []
    for k, (f, n, t) in next(_indices(frames)).items():
        rows += ((k, s, f, n) for s in range(SALTS) if t >> s & 1)
        if len(rows) >= 20_000:
            yield _table(rows, ["digest", "salt", "keep_id", "group_size"])
            rows = []
    yield _table(rows, ["digest", "salt", "keep_id", "group_size"])


def _table(rows: list, names: list[str]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=names)
    for c in ("first", "keep_id"):
        if c in f:
            f[c] = f[c].astype("Int64")
    return f


def classes(digests: DataFrame) -> DataFrame:
    """(digest binary, doc_id, salt), a written table -> a row for each digest and each salt that occurs with it: keep_id, group_size."""
    n = digests.count()
    tasks = max(1, min(int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 20_000)), -(-n // OWNED))
    mapped = digests.select("digest", F.col("doc_id").alias("first"), F.lit(1).cast("long").alias("n"), F.expr("shiftleft(1L, salt)").alias("salts"))
    partial = mapped.mapInPandas(lean(_partial), "digest binary, first long, n long, salts long")
    return partial.repartition(tasks, "digest").mapInPandas(lean(_final), "digest binary, salt int, keep_id long, group_size long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, and empty texts equal each other. The row with the
    smallest doc_id stays; null ids come last, and of rows that repeat an id and a text
    one stays. An empty table gives an empty result; other columns are not read.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(text_digest(F.col("text"))).alias("digest"))
    d = staged(d.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "digests")
    own = d.join(classes(d), ["digest", "salt"])
    nth = F.row_number().over(Window.partitionBy("digest", "salt", "doc_id").orderBy(F.lit(1)))
    return own.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (nth == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns; of rows that repeat id and text, ``first_of``."""
    keep = staged(exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("_dw_id"), F.col("text_sha256").alias("_dw_digest")), "kept")
    twice = staged(keep_repeats(docs), "repeats")
    same = docs.withColumn("_dw_d", text_digest(docs["text"]))
    out = same.join(keep, same["doc_id"].cast("long").eqNullSafe(keep["_dw_id"]) & (same["_dw_d"] == keep["_dw_digest"]), "left_semi")
    if twice.isEmpty():
        release(twice)
        return out.select(*docs.columns)
    return first_of(out, ["doc_id", "_dw_d"], docs.columns)


def first_of(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of one row for each of ``keys``: the one with the smallest hash of all its columns, so reruns agree."""
    order = F.to_json(F.struct(*(F.col(c) for c in columns)))
    w = Window.partitionBy(*keys).orderBy(F.xxhash64(order), order)
    return rows.withColumn("_dw_nth", F.row_number().over(w)).filter("_dw_nth = 1").select(*columns)


def keep_repeats(docs: DataFrame) -> DataFrame:
    """Ids that occur in more than one row."""
    return docs.groupBy("doc_id").count().filter("count > 1")


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
     g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
