"""Every registered query against its SQL twin on the smallest supplied tables."""

import importlib.util
import os
from pathlib import Path

import pytest

from lociframe.plans import registry

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables not present")

spec = importlib.util.spec_from_file_location("compare", Path(__file__).parents[1] / "tools" / "compare_with_duckdb.py")
compare = importlib.util.module_from_spec(spec)
spec.loader.exec_module(compare)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in compare.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert compare.rows_of(df.columns, got) == compare.rows_of(columns, cursor.fetchall())


def test_entry(spark):
    import __spark_entry__
    assert __spark_entry__.entry(spark).count() > 0
