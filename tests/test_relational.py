"""Each relational query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quern.plans import more  # noqa: F401
from quern.plans.relational import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(frame):
    return sorted((tuple(str(x) for x in r) for r in frame), key=str)


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]}) as q").fetchall()
    assert rows(df.select(columns).collect()) == rows(want)


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["filter_project"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "In(l_returnflag, [A,R])" in plan and "l_comment" not in plan and "l_partkey" not in plan
