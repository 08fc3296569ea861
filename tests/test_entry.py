import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as driver
from noteloom.plans import queries as core

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query_equals_oracle(spark, duck, name):
    df = core.queries()[name](spark, SF)
    cur = duck.execute(core.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=str)
    assert got == sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=str)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_core_stands_without_the_training_subpackage():
    """Nothing outside the subpackage imports it, and the driver module works where it is missing."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('noteloom.llm'):\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as d\n"
        "assert d.queries() and d.oracle_sql() and not [q for q in d.queries() if q.startswith('op') or q == 'pipeline']\n"
        "import noteloom.plans.registry, noteloom.sources.vault, noteloom.streaming.sync, noteloom.streaming.presence, noteloom.streaming.folds, noteloom.sources.vectors\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_plans_push_down_and_prune(spark):
    """Scans read the columns a query needs, and filters reach them."""
    plan = core.token_estimate(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = core.log_resume(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(event_id,150)" in plan
