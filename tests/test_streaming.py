"""A stream gives what the table gives."""

import pytest

from quern.streaming.windows import session_counts, sliding_counts, tumbling_counts, without_repeats

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_stream_is_table(spark, tmp_path):
    events = spark.read.parquet(EVENTS)
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = tumbling_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(map(str, spark.table("counts").collect()))
    assert got == sorted(map(str, tumbling_counts(events).collect()))


def test_late_events_are_dropped(spark, tmp_path):
    rows = spark.sql("select timestamp_ntz '2024-01-01 10:00:00' as ts, 'a' as event_type, 1.0D as value")
    late = spark.sql("select timestamp_ntz '2024-01-01 01:00:00' as ts, 'a' as event_type, 1.0D as value")
    later = spark.sql("select timestamp_ntz '2024-01-01 20:00:00' as ts, 'a' as event_type, 1.0D as value")
    path = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(path)
    stream = tumbling_counts(spark.readStream.schema(rows.schema).parquet(path))
    out, at = str(tmp_path / "out"), str(tmp_path / "at")
    run = lambda: stream.writeStream.format("parquet").option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    run()
    late.coalesce(1).write.mode("append").parquet(path)
    run()
    later.coalesce(1).write.mode("append").parquet(path)
    run()
    found = spark.read.parquet(out).select("start").collect()
    assert [r["start"].hour for r in found] == [10]


@pytest.mark.parametrize("plan", [sliding_counts, session_counts, without_repeats])
def test_other_streams_are_tables(spark, tmp_path, plan):
    events = spark.read.parquet(EVENTS)
    events.unionByName(events.limit(0)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    name = plan.__name__
    mode = "append" if plan is without_repeats else "complete"
    plan(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, plan(events).collect()))


def test_repeats_over_batches(spark, tmp_path):
    """A repeat that comes in a later batch, within the watermark, is dropped, too."""
    rows = spark.sql("select 1L as event_id, timestamp_ntz '2024-01-01 10:00:00' as ts, 'a' as event_type, 1.0D as value")
    path, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(path)
        without_repeats(spark.readStream.schema(rows.schema).parquet(path)).writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).start(out).awaitTermination()
    assert spark.read.parquet(out).count() == 1
