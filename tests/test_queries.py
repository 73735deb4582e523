"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entries

duckdb = pytest.importorskip("duckdb")
from verify import compare  # noqa: E402

SF_DIR = entries.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.splitext(os.path.basename(path))[0]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", entries.queries())
def test_query(spark, con, name):
    verdict, _ = compare(spark, con, SF_DIR, name, entries.queries()[name], entries.oracle_sql().get(name))
    assert verdict.startswith(("ok", "rows-only")), verdict


def test_entry(spark):
    assert entries.entry(spark).count() > 0
    assert set(entries.oracle_sql()) <= set(entries.queries())
