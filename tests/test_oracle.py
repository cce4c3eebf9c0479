"""Every registered query of the catalog against its SQL twin, and its plan; and the entry without the llm folder."""

import shutil
import subprocess
import sys

import oracle
import pytest
from conftest import ROOT

import __spark_entry__ as entry
from tallyframe.catalog import cleaning, exploration, modelling, profiles

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
CATALOG = {**cleaning.QUERIES, **profiles.QUERIES, **exploration.QUERIES, **modelling.QUERIES}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in CATALOG}

# A result of any of these would not be spread over the cluster, or would leave the JVM.
UNWANTED = ["CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow", "MapPartitions"]


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert oracle.compare(con, df, SQL[name]) is None
    plan = df._jdf.queryExecution().toString()
    assert not [word for word in UNWANTED if word in plan]


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(QUERIES)


@pytest.mark.parametrize("also_without", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_llm_folder(tmp_path, also_without):
    ignored = shutil.ignore_patterns("llm", ".git", "__pycache__", *also_without)
    shutil.copytree(ROOT, tmp_path / "repo", ignore=ignored)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, check=True)
    assert done.stdout.split() == sorted(CATALOG)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
