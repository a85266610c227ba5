"""Every registered table query gives the rows of its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from stallkeeper.plans import table_queries

from .conftest import DATA


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(table_queries.queries()))
def test_query(spark, duck, name):
    got = table_queries.queries()[name](spark, DATA)
    duck.execute(table_queries.oracle_sql()[name])
    columns = [d[0] for d in duck.description]
    want = duck.fetchall()
    assert sorted(columns) == sorted(got.columns)
    rows = [tuple(map(plain, r)) for r in got.select(*[f"`{c}`" for c in columns]).collect()]
    assert sorted(rows, key=str) == sorted([tuple(map(plain, r)) for r in want], key=str)
