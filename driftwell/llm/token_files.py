"""Token ids in Parquet list columns, in ascending document order.

Each row holds a document's ids (``list<int32>``), their number and the ids before it in
its part. Ids are dictionary-encoded by default (16-bit indices, which compress well) or
delta-encoded; row groups and pages have set sizes, and the footer carries page indexes,
so a reader that wants a few documents, or only lengths, skips the pages of all others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._stage import fresh_path, lean, staged
from ._tokens import encoder, vocabulary

END_ID = 1
ROWS = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
IDS = "ids.list.element"
PART_BYTES = 32 << 20  # of text that a part holds, about
BROADCAST_PARTS = 2_000_000


def encode_documents(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text), in parts sorted by doc_id -> rows of a token file. Null and empty texts are the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, before = encoder(path, spaced=False), TaskContext.get().partitionId(), 0
        for b, ids, at in (x for batch in batches for x in code.slices(batch)):
            ids = np.insert(ids.astype(np.int32), at[1:], end_id)
            at = at + np.arange(len(at))
            n = np.diff(at)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(before + at[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], ["doc_id", "part", "local_start", "n_tokens", "ids"])
            before += int(at[-1])

    return docs.mapInArrow(lean(run), ROWS)


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = END_ID, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2_000) -> None:
    """Write the token files of ``docs`` (doc_id, text) to the folder ``out``, in ascending order of doc_id.

    Part k holds smaller ids than part k + 1 and is sorted; null ids come first, rows that
    repeat an id stay next to each other in the order of their texts' hashes. The number of
    parts follows the bytes of the texts. Other columns than doc_id and text are not read.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // 100_000)), -(-size // PART_BYTES))
    dealt = narrow.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    encode_documents(dealt, path, end_id).write.options(**{
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0",
        f"parquet.enable.dictionary#{IDS}": str(encoding == "dictionary").lower(),
        "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows,
    }).parquet(out)


def read_metadata(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, part, local_start, n_tokens; the pages of ids are not read."""
    return spark.read.schema(ROWS).parquet(out).select("doc_id", "part", "local_start", "n_tokens")


def read_tokens(spark: SparkSession, out: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids of the documents from ``low`` to ``high``; the bounds reach the scan's page indexes.

    ``start`` counts the ids of all documents before. The sums by part that it needs are
    one row for each file; they are broadcast up to ``BROADCAST_PARTS`` of them.
    """
    sums = staged(read_metadata(spark, out).groupBy("part").agg(F.sum("n_tokens").alias("n")), "parts")
    bases = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rows = spark.read.schema(ROWS).parquet(out)
    for c in ([F.col("doc_id") >= low] if low is not None else []) + ([F.col("doc_id") <= high] if high is not None else []):
        rows = rows.filter(c)
    if sums.count() <= BROADCAST_PARTS:  # else the ids themselves would cross a shuffle
        bases = F.broadcast(bases)
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned CRC-32 of the ids, each as 4 little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            raw, at = memoryview(ids.values.to_numpy().astype("<i4", copy=False)).cast("B"), ids.offsets.to_numpy()
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            n = np.diff(at).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    """An empty table gives no rows; other columns than doc_id and text are not read."""
    out = fresh_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, vocabulary("word_bpe_49k.json"))
    return checksums(read_tokens(spark, out))
