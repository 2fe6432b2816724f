"""Message identity: offsets repeat across Kafka partitions and must not mix calls."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from callroute.operators import commands as cm
from callroute.plans.jobs import route_events
from callroute.session import scratch_path
from callroute.sources import io
from callroute.sources.io import _from_kafka
from callroute.sources.lines import Files, LinesStreamReader


def test_overlapping_offsets_keep_calls_apart(spark):
    event = '{{"type":"StasisStart","channel":{{"id":"{0}","channelvars":{{"CALL_CONTEXT":"ctx{0}"}}}},"application":"a"}}'
    rows = [(event.format(c).encode(), p, 0, datetime(2024, 1, 1)) for p, c in enumerate("AB")]
    kafka = spark.createDataFrame(rows, "value binary, partition int, offset long, timestamp timestamp")
    events = _from_kafka(kafka, with_request_id=False)
    assert events.select("seq").distinct().count() == 2
    commands = spark.createDataFrame([], "seq bigint, ts timestamp_ntz, request_id bigint, raw string")
    out = route_events(events, commands).select("key", "resource_id").collect()
    assert sorted((r.key, r.resource_id) for r in out) == [("ctxA", "A"), ("ctxB", "B")]
    both = _from_kafka(kafka, with_request_id=True)
    assert both.where("request_id = seq").count() == 2


def test_result_without_status_is_a_failure_with_its_duration(spark):
    requests = spark.createDataFrame([(1,), (2,), (3,)], "request_id bigint")
    results = spark.createDataFrame([(1, 404, None, 5.0), (2, None, None, 7.0)], "request_id bigint, status int, result_body string, duration_ms double")
    out = {r.request_id: (r.status_code, r.is_error, r.duration_ms) for r in cm.correlate_results(requests, results).collect()}
    assert out == {1: (404, False, 5.0), 2: (500, True, 7.0), 3: (500, True, None)}


def lines_in(folder, name, lines, end="\n", mode="wb"):
    import os

    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", mode) as f:
        f.write("".join(x + end for x in lines).encode())


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_line_positions_do_not_depend_on_splits(spark):
    folder = scratch_path(spark, "lines")
    messages = [f'{{"type":"Dial","n":{i},"t":"{"é" * (i % 40)}"}}' for i in range(60)]
    lines_in(folder, "log-01", messages[:40])
    lines_in(folder, "log-02", ["", "  ", *messages[40:59]], end="\r\n")
    lines_in(folder, "log-03", [messages[59]], end="")
    lines_in(folder, "_ignored", ["x"])
    whole = rows(io.read_events(spark, folder, fmt="text"))
    assert [r[2] for r in whole] == messages
    assert whole[0][0] == 0 and whole[40][0] == (1 << 40) + 6 and whole[59][0] == 2 << 40
    for split in (23, 500):
        assert rows(io.read_events(spark, folder, fmt="text", splitBytes=split)) == whole
    commands = rows(io.read_commands(spark, folder, fmt="text", splitBytes=300))
    assert [(c[0], c[1], c[3]) for c in commands] == whole and all(c[0] == c[2] for c in commands)
    assert rows(io.read_events(spark, f"{folder}/log-02", fmt="text"))[0][2] == messages[40]
    assert io.read_events(spark, scratch_path(spark, "no-lines"), fmt="text").count() == 0


def test_ranges_of_any_size_hold_every_line_once(tmp_path):
    text = b"a\n\nbcd\n" + "\u00e9".encode() * 5 + b"\nlast"
    (tmp_path / "f").write_bytes(text)
    files = Files(str(tmp_path))
    info = files.listed()[0]
    whole = list(files.lines(files.ranges(info, 0, 0, info.size, 1 << 20)[0]))
    assert whole == [(0, b"a"), (2, b""), (3, b"bcd"), (7, "\u00e9".encode() * 5), (18, b"last")]
    for split in range(1, 20):
        assert [x for r in files.ranges(info, 0, 0, info.size, split) for x in files.lines(r)] == whole
    assert files.whole_lines(info) == 18


def test_lines_as_a_stream_are_those_of_the_batch(spark):
    base = scratch_path(spark, "lines")
    folder = f"{base}/in"

    def take(source):
        source.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out", format="parquet").awaitTermination()
        return spark.read.schema("seq long, ts timestamp_ntz, request_id long, raw string").parquet(f"{base}/out")

    source = lambda: io.stream_commands(spark, folder, fmt="text", splitBytes=200, ts_path="/at")
    message = lambda i: f'{{"n":{i},"at":"2024-01-01T00:00:{i:02d}Z"}}'
    lines_in(folder, "a", [message(i) for i in range(5)])
    lines_in(folder, "b", [message(5), message(6)[:9]], end="")
    lines_in(folder, "b", [message(5)])
    lines_in(folder, "b", [message(6)[:9]], end="", mode="ab")
    assert take(source()).count() == 6  # the line that is not whole waits
    lines_in(folder, "b", [message(6)[9:]], mode="ab")
    lines_in(folder, "c", [message(i) for i in range(7, 30)])
    got = rows(take(source()))
    assert got == rows(io.read_commands(spark, folder, fmt="text", ts_path="/at"))
    assert [r[1] for r in got] == [datetime(2024, 1, 1, 0, 0, i) for i in range(30)]
    assert take(source()).count() == 30


def test_a_file_out_of_order_is_refused(spark):
    folder = scratch_path(spark, "lines")
    lines_in(folder, "b", ["1"])
    reader = LinesStreamReader(folder, 100)
    offset = reader.latestOffset()
    lines_in(folder, "a", ["2"])
    with pytest.raises(ValueError, match="no longer numbered"):
        reader.partitions(offset, reader.latestOffset())
    assert Files(f"{folder}/none").listed() == []


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    """A table of one file with one row group is turned into messages by many tasks; the rows stay the same."""
    from callroute.sources import fixtures as fx

    n = 3 * fx.TASK_ROWS
    spark.range(n).selectExpr(
        "id as event_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "id % 9 as user_id", "'view' as event_type", "1.0D as value"
    ).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    base = fx.ari_event_base(spark, str(tmp_path))
    sizes = base.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == n and max(sizes) < 2 * fx.TASK_ROWS
    assert base.select("seq").distinct().count() == n
