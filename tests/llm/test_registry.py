"""The registered queries: one for each operator, and those with SQL against it."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import connect, of_spark, of_sql  # noqa: E402

from linkloom.llm.registry import ORACLE_SQL, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, len(QUERIES) + 1))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert of_spark(QUERIES[name](spark, SF)) == of_sql(connect(SF), ORACLE_SQL[name])
