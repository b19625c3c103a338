"""Every query against its SQL, on the small tables."""

import os

import oracle
import pytest
from codequarry.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    if name in ORACLE:
        assert oracle.difference(spark, SF, QUERIES[name], ORACLE[name], connection) is None
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_entry_and_optional_parts(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["path", "freshness", "trust_score", "trust_level"]
    assert set(ORACLE) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_optional_parts(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/codequarry", tmp_path / "codequarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'freshness_report' in e.queries() and not any(k.startswith('op1') for k in e.queries()); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env).returncode == 0
