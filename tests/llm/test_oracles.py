"""Queries of the operators against their SQL, on the small tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
import oracle  # noqa: E402
from codequarry.llm.queries import ORACLE, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, small, name):
    if name in ORACLE:
        assert oracle.difference(spark, small, QUERIES[name], ORACLE[name]) is None
    else:
        assert QUERIES[name](spark, small).count() >= 0


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)]
