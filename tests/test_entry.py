import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"

import __spark_entry__ as registered  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LIBRARY = sorted(n for n in registered.queries() if not (n.startswith("op") and n[2].isdigit()) and n != "pipeline")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, (bool, str)):
        return value
    return round(float(value), 6) + 0.0 if isinstance(value, (int, float)) or hasattr(value, "__float__") else str(value)


@pytest.mark.parametrize("name", LIBRARY)
def test_query_matches_sql(spark, oracle, name):
    found = registered.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    mine = sorted((repr([plain(r[c]) for c in columns]) for r in found.collect()))
    sql = registered.oracle_sql().get(name)
    if sql is None:
        assert mine
        return
    want = oracle.sql(sql)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert mine == sorted(repr([plain(row[i]) for i in at]) for row in want.fetchall())


def test_entry(spark):
    assert registered.entry(spark).count() > 0


def test_library_stands_without_training_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse", ".pytest_cache"))
    path = os.pathsep.join([str(copy), *(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != ROOT)])

    def run(*command):
        done = subprocess.run([sys.executable, *command], cwd=copy, env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True)
        assert done.returncode == 0, done.stdout + done.stderr
        return done.stdout

    code = "import __spark_entry__ as e, json; print(json.dumps(sorted(e.queries())))"
    assert json.loads(run("-c", code)) == LIBRARY
    pytest_run = ["-m", "pytest", "-q", "-x", "-p", "no:cacheprovider"]
    run(*pytest_run, "--collect-only", "tests")
    run(*pytest_run, "tests/test_functions.py", "tests/test_actions.py")
