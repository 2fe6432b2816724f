"""Records of a transaction are delivered once, whatever fails in between."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from callroute.session import scratch_path
from callroute.sources.sink import KeyedSink, record_ids
from callroute.streaming import stream as sm
from test_stream import COLUMNS, command, event

T0 = datetime(2024, 1, 1)


class Failing(KeyedSink):
    """A target that loses its writer after some of the records, as often as told."""

    fail = 0

    def deliver(self, records):
        if self.fail:
            self.fail -= 1
            super().deliver(records.orderBy("value").limit(7))
            raise OSError("lost")
        super().deliver(records)


@pytest.fixture
def sink(spark):
    base = scratch_path(spark, "sink")
    return Failing(spark, f"{base}/markers", f"{base}/topic")


def records(spark, n):
    rows = [("t", f"k{i % 3}", f"v{i:03d}", f"m-{i}", T0 + timedelta(seconds=i), i) for i in range(n)]
    return spark.createDataFrame(rows, "topic string, key string, value string, record_id string, ts timestamp_ntz, seq long")


def test_failed_attempts_deliver_each_record_once(spark, sink):
    sink.fail = 2
    for _ in range(2):
        with pytest.raises(OSError, match="lost"):
            sink.publish(records(spark, 30), "a-0-0")
    assert sink.publish(records(spark, 30), "a-0-0")
    assert not sink.publish(records(spark, 30), "a-0-0")
    there = spark.read.parquet(sink.target)
    assert sorted(r.value for r in there.collect()) == [f"v{i:03d}" for i in range(30)]
    assert record_ids(there).distinct().count() == 30
    assert there.columns == ["topic", "key", "value", "headers"]


def test_records_of_a_key_stay_in_order(spark, sink):
    sink.publish(records(spark, 60), "a-0-0")
    at = spark.read.parquet(sink.target).select("key", "value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).orderBy("at").collect()
    for k in ("k0", "k1", "k2"):
        mine = [r for r in at if r.key == k]
        assert len({r.file for r in mine}) == 1 and [r.value for r in mine] == sorted(r.value for r in mine)


def test_router_publishes_through_it(spark, sink):
    paths = sm.new_paths(spark, "test-sink")
    sink.fail = 1
    sinks = sm.Sinks(events=sink)
    rows = [event(1, 0, "c1", "StasisStart", "k"), *(event(i, i, "c1") for i in range(2, 14)), command(20, 1)]
    batch = spark.createDataFrame(rows, COLUMNS)
    with pytest.raises(OSError, match="lost"):
        sm.process_batch(batch, 0, paths, sinks=sinks)
    for _ in range(2):
        assert sm.process_batch(batch, 0, paths, sinks=sinks)
    there = spark.read.parquet(sink.target)
    assert there.count() == 13 and record_ids(there).distinct().count() == 13
    assert {r.key for r in there.select("key").distinct().collect()} == {"k"}
    assert sorted(r.value for r in there.collect()) == sorted(r.value for r in sm.read_output(spark, paths.events_out).collect())
