"""Formats, partitions and buckets come back as they were written."""

import datetime

import pytest

from quern.sources import files

ROWS = [(1, "a, \"b\"\nc", 1.5, True, datetime.datetime(2024, 1, 2, 3, 4, 5, 600)), (2, None, None, None, None), (3, "", -0.5, False, datetime.datetime(1999, 12, 31))]
DDL = "id long, name string, x double, ok boolean, ts timestamp_ntz"


@pytest.mark.parametrize("kind", files.FORMATS)
def test_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame(ROWS, DDL)
    files.write(df, f"{tmp_path}/t", kind)
    back = files.read(spark, f"{tmp_path}/t", kind, df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(ROWS)
    files.write(df.limit(0), f"{tmp_path}/t", kind, mode="overwrite")
    assert files.read(spark, f"{tmp_path}/t", kind, df.schema).count() == 0
    with pytest.raises(Exception, match="already exists"):
        files.write(df, f"{tmp_path}/t", kind)


def test_partitions_are_pruned(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id % 5 as part")
    files.write(df, f"{tmp_path}/t", partition_by=("part",))
    found = files.read(spark, f"{tmp_path}/t").filter("part = 3")
    assert found.count() == 20 and "PartitionFilters: [isnotnull(part" in found._jdf.queryExecution().executedPlan().toString()
    assert len(list((tmp_path / "t" / "part=3").glob("*.parquet"))) == 1


def test_buckets_spare_the_shuffle(spark):
    for name in ("bucketed_a", "bucketed_b"):
        files.save_table(spark.range(1000).selectExpr("id", "id * 2 as x"), name, ("id",), 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = spark.table("bucketed_a").join(spark.table("bucketed_b"), "id")
        assert joined.count() == 1000 and "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("bucketed_a", "bucketed_b"):
            spark.sql(f"drop table {name}")


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="none of"):
        files.read(spark, "x", "xml")
