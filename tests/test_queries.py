"""Every query against its SQL, on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import pytest
from oracle import connect, of_spark, of_sql

from linkloom.plans import registry

SF = "/root/testdata/sf0.001"
registry.load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert of_spark(registry.QUERIES[name](spark, SF)) == of_sql(con, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_are_named_before_a_session_is_there():
    code = "import __spark_entry__ as e; from pyspark import SparkContext; assert SparkContext._active_spark_context is None; print(len(e.queries()), len(e.oracle_sql()))"
    found = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr
    assert min(map(int, found.stdout.split())) > 300
