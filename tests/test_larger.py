"""Relational queries against their SQL on rows that the smallest tables don't have."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from quern.plans import more  # noqa: F401
from quern.plans.relational import ORACLE_SQL, QUERIES


def same(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, data in tables.items():
        pq.write_table(data, folder / f"{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, str(folder))
    want = con.sql(f"select {', '.join(df.columns)} from ({ORACLE_SQL[name]}) as q").fetchall()
    assert sorted((tuple(str(x) for x in r) for r in df.collect()), key=str) == sorted((tuple(str(x) for x in r) for r in want), key=str)
    return df


def test_more_arrays_on_ties_nulls_and_empties(spark, tmp_path):
    vectors = [[0.35, 0.3], [0.35, 0.4], [-0.65, -0.6], [k / 20 for k in range(-20, 21)], [], None, [None, 0.5], [0.5, None], [None], [-0.0, 0.0]]
    n = len(vectors)
    data = pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([1] * n, pa.int32())})
    same(spark, tmp_path, "more_arrays", embeddings=data)


def test_lateral_join_pairs_by_key_only(spark, tmp_path):
    balance = [10.0, 10.0, 20.0, None, float("nan"), -0.0, 0.0, 5.0, 900.0, 5.0]
    key = [1, 1, 1, 2, 3, 4, 4, None, 5, 6]
    customer = pa.table({"c_custkey": pa.array(key, pa.int64()), "c_acctbal": pa.array(balance, pa.float64())})
    orders = pa.table({"o_custkey": pa.array([1, 1, 1, 2, 3, 4, 4, None, 5, 77], pa.int64()), "o_totalprice": pa.array([5.0, 15.0, 25.0, 1.0, 2.0, 0.0, 7.0, 9.0, 1.0, 8.0], pa.float64())})
    df = same(spark, tmp_path, "lateral_join", customer=customer, orders=orders)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
