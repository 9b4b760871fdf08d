"""Every query with SQL gives the SQL's rows on the smallest data; every query runs on empty tables."""

import importlib.util
import os

import pytest

import __spark_entry__ as entry
from tests.compare import duck, run_pair

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, name):
    assert run_pair(spark, con, entry.queries()[name], entry.oracle_sql()[name], FOLDER) == ""


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    """The tables without rows."""
    folder = str(tmp_path_factory.mktemp("nothing"))
    for f in os.listdir(FOLDER):
        spark.read.parquet(f"{FOLDER}/{f}").limit(0).write.parquet(f"{folder}/{f}")
    return folder


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_empty_tables(spark, nothing, name):
    entry.queries()[name](spark, nothing).collect()


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_stands_alone():
    assert importlib.util.find_spec("docweave.plans.training") is not None
    for base, _, files in os.walk(os.path.join(os.path.dirname(entry.__file__), "docweave")):
        if os.sep + "llm" not in base:
            for f in files:
                if f.endswith(".py"):
                    assert "docweave.llm" not in open(os.path.join(base, f), encoding="utf-8").read()
