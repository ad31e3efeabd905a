import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from larkspur import catalogue

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("gone", [["llm"], ["llm", "corpus_pipeline.py"]])
def test_works_without_the_training_data_operators(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *gone))
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) == set(e.queries()), e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120)
    # the rest's tests are collected, and those that need no Spark session of their own kind pass
    subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "tests"], cwd=tmp_path / "r", check=True, timeout=300, stdout=subprocess.DEVNULL)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_plans.py", "-k", "rejected"], cwd=tmp_path / "r", check=True, timeout=300, stdout=subprocess.DEVNULL)


def test_every_statement_has_an_oracle():
    assert set(catalogue.oracle_sql()) == set(catalogue.queries()) <= set(__spark_entry__.queries())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["c_custkey", "c_acctbal"] and 0 < df.count() <= 20


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in catalogue.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


def _plain(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_statement_against_its_oracle(spark, db, name):
    got = catalogue.queries()[name](spark, DIR)
    want = db.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert got.columns == columns
    assert _plain(tuple(r) for r in got.collect()) == _plain(want.fetchall())
