import os
import subprocess
import sys

import corpus_pipeline as c
from pyspark.sql import functions as F

from driftwell.llm import quality_qda
from tests.llm.test_near import brute

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_do_what_plain_versions_do(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["quality", "exact dedup", "near dedup", "mix", "pack"] and c.ORACLE_SQL is None
    scores = quality_qda.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = c.staged(c.good(spark, docs, SF), "t")
    assert ids(good) == ids(scores.filter("predicted = 1")) and good.columns == docs.columns
    once = c.staged(c.once(spark, good, SF), "t")
    first = {}
    for r in good.collect():
        key = " ".join(r["text"].split())
        first[key] = min(r["doc_id"], first.get(key, r["doc_id"]))
    assert ids(once) == sorted(first.values()) and once.columns == docs.columns
    apart = c.staged(c.apart(spark, once, SF), "t")
    want = brute([(r["doc_id"], r["text"]) for r in once.collect()])
    assert ids(apart) == sorted(set(want.values())) and apart.columns == docs.columns
    mixed = c.staged(c.mixed(spark, apart, SF), "t")
    text = {r["doc_id"]: r["text"] for r in apart.collect()}
    rows = mixed.collect()
    assert mixed.columns == docs.columns and all(text[r["doc_id"]].startswith(r["text"]) and r["n_chars"] <= len(text[r["doc_id"]]) for r in rows)
    total = sum(len(t.split()) for t in text.values())
    assert abs(sum(len(r["text"].split()) for r in rows) - 1.5 * total) <= 20
    packed = c.packed(spark, mixed, SF)
    assert packed.filter("piece = 0").count() == len(rows)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).filter("n > 1024 OR n <> end").isEmpty()


def test_run_and_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit("x")).withColumn("salt", F.lit(1))
    odd = spark.createDataFrame([(None, None, None, None, None, "x", 1), (10**9, "", "en", None, 0, "y", 2), (10**9, "", "en", None, 0, "y", 2), (10**9 + 1, "word " * 30_000, "en", "src0", 5, "y", 2)], docs.schema)
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert c.run(spark, str(tmp_path)).count() > 200
    docs.limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/e/labels.parquet")
    assert c.run(spark, f"{tmp_path}/e").count() == 0


def test_workers_get_the_package(tmp_path):
    """From a folder and with a path that do not lead Python workers to the package."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e; from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); print('ROWS', e.queries()['op1_chat_format'](s, {SF!r}).count())"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert "ROWS" in said.stdout, said.stderr[-2000:]
