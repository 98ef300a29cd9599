import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from driftwell.plans import queries as core

SF = "/root/testdata/sf0.001"


def rows(frame):
    """Rows as sorted tuples; numbers by value, so that nullable integers compare alike."""
    out = []
    for r in frame[sorted(frame.columns)].itertuples(index=False):
        out.append(tuple("null" if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in (x.item() if hasattr(x, "item") else x for x in r)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query_equals_its_sql(spark, duck, name):
    ours, theirs = core.queries()[name](spark, SF).toPandas(), duck.sql(core.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)


@pytest.mark.parametrize("changed", ["* REPLACE (CASE WHEN o_orderkey = 7 THEN 'P' ELSE o_orderstatus END AS o_orderstatus) FROM o", "* FROM o WHERE o_orderkey <> 7", "* REPLACE (o_orderkey - 5 AS o_orderkey) FROM o WHERE o_orderstatus <> 'P'", "* FROM o WHERE false"])
def test_conflicts_whatever_the_orders(spark, tmp_path, changed):
    """Order 7 pending, or not there; keys below zero and nothing pending; no orders."""
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW o AS SELECT * FROM '{SF}/orders.parquet'")
        c.execute(f"COPY (SELECT {changed}) TO '{tmp_path}/orders.parquet'")
        c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
        assert rows(core.queries()["q58_conflicts"](spark, str(tmp_path)).toPandas()) == rows(c.sql(core.oracle_sql()["q58_conflicts"]).df())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
    assert math.isfinite(len(entry.queries()))


def test_filters_and_columns_reach_the_scan(spark):
    plan = core.queries()["q06_and_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_orderdate" not in plan


def test_works_without_the_training_data_folders(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/driftwell", tmp_path / "driftwell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(core.queries())), "False"], said.stderr
