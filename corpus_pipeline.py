"""From raw documents to packed training sequences, stage by stage.

Each stage works on all that the one before kept, and its decisions take effect: rejected
documents and copies are gone, mixed documents come as often as the mix takes them, and the
last stage lays out every token. Between stages the documents are written and read again,
so no stage hangs on another's executors.

Null and empty texts are documents like others: they are scored by the statistics of no
characters, empty ones are copies of each other, have no near duplicates but each other, are
never mixed in (they have no words). Null ids belong to their texts. Rows that repeat id and
text count once from exact dedup on; rows that repeat an id with other texts are documents of
their own. Without labels no document is rejected. An empty table gives an empty result. Other
columns than those of documents stay with their rows up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwell.llm import bagminhash, exact_dedup, mixing, packing, quality_qda
from driftwell.llm._stage import shipped, staged
from driftwell.llm._tokens import vocabulary


@shipped
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_qda.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@shipped
def once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the one with the smallest doc_id."""
    return exact_dedup.drop_copies(docs)


@shipped
def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest doc_id."""
    return bagminhash.drop_near_copies(docs)


@shipped
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed_documents(docs)


@shipped
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 tokens."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", good), ("exact dedup", once), ("near dedup", apart), ("mix", mixed), ("pack", packed)]

#: Learnt scores, hashed orders and token ids are beyond SQL; tests hold run() against plain versions of the stages.
ORACLE_SQL = None


@shipped
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
