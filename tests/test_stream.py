"""The router's micro-batches: late and future-dated rows, quarantine, waiting requests, the control cut, replay."""

import json
from datetime import datetime, timedelta

import pytest

from callroute.operators import events as ev
from callroute.operators import metrics as mt
from callroute.sources import io
from callroute.streaming import stream as sm
from callroute.streaming.keyed_state import KeyedState

T0 = datetime(2024, 1, 1)
COLUMNS = "seq long, ts timestamp_ntz, request_id long, raw string, src int, status int, result_body string, duration_ms double"


def event(seq, minutes, channel, kind="ChannelStateChange", context=None):
    body = {"type": kind, "channel": {"id": channel}}
    if context:
        body["channel"]["channelvars"] = {"CALL_CONTEXT": context}
    return (seq, T0 + timedelta(minutes=minutes), None, json.dumps(body), 1, None, None, None)


def command(seq, minutes, url="/channels/c1/answer"):
    raw = json.dumps({"callContext": "ctx", "ariCommand": {"method": "POST", "url": url}})
    return (seq, T0 + timedelta(minutes=minutes), seq, raw, 0, None, None, None)


def result(request_id, minutes, status=200, body=None):
    return (request_id, T0 + timedelta(minutes=minutes), request_id, None, 2, status, body, 1.0)


def run(spark, *batches, **options):
    paths = sm.new_paths(spark, "test-stream")
    for i, rows in enumerate(batches):
        sm.process_batch(spark.createDataFrame(rows, COLUMNS), i, paths, **options)
    return paths


def events_of(spark, paths):
    return {r.seq: (r.key, r.late) for r in sm.read_output(spark, paths.events_out).collect()}


def test_future_dated_row_wipes_nothing(spark):
    paths = run(
        spark,
        [event(1, 0, "c1", "StasisStart", "ctx-1")],
        [event(2, 2 * 24 * 60, "c2", "StasisStart", "ctx-2")],
        [event(3, 5, "c1")],
    )
    assert events_of(spark, paths) == {1: ("ctx-1", False), 2: ("ctx-2", False), 3: ("ctx-1", False)}


def test_late_events_are_routed_and_flagged(spark):
    paths = run(
        spark,
        [event(1, 10, "c1", "StasisStart", "ctx-1")],
        [event(2, 5, "c1"), event(3, 6, "c1", "StasisStart"), event(4, 12, "c1")],
    )
    out = events_of(spark, paths)
    assert out[2] == ("ctx-1", True) and out[3] == ("ctx-1", True) and out[4] == ("ctx-1", False)


def arrive(spark, paths, rows, **options):
    """Rows (and time stamps, as ticks) as new files of a router that takes them all in."""
    frame = spark.createDataFrame([r for r in rows if isinstance(r, tuple)], COLUMNS).persist()
    kinds = {"events": ("src = 1", ["seq", "ts", "raw"]), "commands": ("src = 0", ["seq", "ts", "request_id", "raw"]), "results": ("src = 2", io.RESULT_COLUMNS)}
    for name, (which, columns) in kinds.items():
        frame.where(which).select(*columns).coalesce(1).write.mode("append").parquet(f"{paths.root}/in/{name}")
    spark.createDataFrame([(r,) for r in rows if not isinstance(r, tuple)], "ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{paths.root}/in/ticks")
    return start(spark, paths, **options)


def start(spark, paths, **options):
    source = f"{paths.root}/in"
    ticks = spark.readStream.schema("ts timestamp_ntz").parquet(f"{source}/ticks")
    router = sm.start_router(
        spark, io.stream_events(spark, f"{source}/events"), io.stream_commands(spark, f"{source}/commands"), paths,
        io.stream_results(spark, f"{source}/results"), ticks, **options,
    )
    router.awaitTermination()
    return router


def quarantine(spark, paths):
    return sorted((r.processor, r.reason, r.seq) for r in sm.read_output(spark, paths.quarantine_out).collect())


def answers(spark, paths):
    return sorted((r.request_id, r.status_code) for r in sm.read_output(spark, paths.responses_out).collect())


def test_nothing_is_lost_without_a_reason(spark):
    paths = sm.new_paths(spark, "test-stream")
    bad = (5, T0, None, "no json", 1, None, None, None)
    arrive(spark, paths, [bad, event(6, 1, "nobody"), command(7, 1), (8, T0, 8, "[]", 0, None, None, None), result(7, 1, body="oops"), result(70, 1), result(8, 2)])
    arrive(spark, paths, [T0 + timedelta(days=1)])
    assert quarantine(spark, paths) == [
        ("commandResponse", "bad_response_body", 7), ("commandResponse", "malformed", 8),
        ("commandResponse", "unclaimed_result", 8), ("commandResponse", "unclaimed_result", 70),
        ("event", "malformed", 5), ("event", "no_context", 6),
    ]


def test_requests_wait_for_results(spark):
    paths = sm.new_paths(spark, "test-stream")
    options = {"result_timeout": "10 minutes", "lateness": "5 minutes"}
    arrive(spark, paths, [command(1, 0), command(2, 0), result(3, 0, 204)], **options)
    assert answers(spark, paths) == []
    arrive(spark, paths, [result(1, 1), command(3, 1), command(4, 59), event(9, 60, "x"), result(1, 2, 404)], **options)
    assert answers(spark, paths) == [(1, 200), (3, 204)]
    assert {r.request_id for r in sm.read_output(spark, paths.requests_out).collect()} == {1, 2, 3, 4}
    # no new command, no new result: the clock alone fails what waits too long
    arrive(spark, paths, [T0 + timedelta(minutes=30)], **options)
    assert answers(spark, paths) == [(1, 200), (2, 500), (3, 204)]
    arrive(spark, paths, [result(1, 8)], **options)
    arrive(spark, paths, [T0 + timedelta(minutes=90)], **options)
    assert answers(spark, paths) == [(1, 200), (2, 500), (3, 204), (4, 500)]
    assert quarantine(spark, paths)[0] == ("commandResponse", "repeated_result", 1)
    router = arrive(spark, paths, [command(5, 1), command(6, 89), result(7, 3), result(4, 4)], **options)
    assert router.late_rows() == 3 and router.watermark() == T0 + timedelta(minutes=85)
    inputs = [spark.read.parquet(f"{paths.root}/in/{name}") for name in ("commands", "results")]
    for _ in range(2):
        sm.quarantine_late(spark, paths, *inputs, router.watermark(), **options)
        late = sorted((r.reason, r.seq, r.ts) for r in sm.read_output(spark, paths.quarantine_out).collect() if r.reason.startswith("late"))
        # the third result of request 1 came after the watermark had reached 25 minutes
        at = [("late_command", 5, 1), ("late_result", 1, 8), ("late_result", 4, 4), ("late_result", 7, 3)]
        assert late == [(reason, seq, T0 + timedelta(minutes=m)) for reason, seq, m in at]


def test_no_late_messages_before_the_first_batch(spark):
    inputs = spark.createDataFrame([command(1, 0)], COLUMNS), spark.createDataFrame([result(1, 1)], COLUMNS)
    assert sm.late_messages(spark, sm.new_paths(spark, "none"), *inputs, T0 + timedelta(minutes=1)).count() == 0
    found = sm.late_messages(spark, sm.new_paths(spark, "none"), *inputs, T0 + timedelta(days=1)).collect()
    assert sorted((r.reason, r.seq) for r in found) == [("late_command", 1), ("late_result", 1)]


def test_stop_and_restart_route_what_one_run_routes(spark):
    rows = [event(1, 0, "c1", "StasisStart", "k"), event(2, 5, "c1"), event(3, 2, "c1", "ApplicationReplaced"), event(4, 1, "c1"), event(5, 9, "c1"), command(6, 4, "/channels/c2/play/p1"), event(7, 7, "p1", "PlaybackStarted"), event(8, 8, "c1", "ApplicationReplaced"), event(10, 10, "c9"), event(11, 11, "c1")]
    rows = [(*r[:3], r[3].replace('"channel": {"id": "p1"}', '"playback": {"id": "p1"}'), *r[4:]) for r in rows]
    plain, stopped = sm.new_paths(spark, "test-plain"), sm.new_paths(spark, "test-stop")
    arrive(spark, plain, rows)
    assert arrive(spark, stopped, rows, stop_at_control=True) and sm.stopped_at(spark, stopped) == (sm._micros(T0 + timedelta(minutes=2)), 3)
    assert set(events_of(spark, stopped)) == {1, 4}
    start(spark, stopped, stop_at_control=True)
    assert set(events_of(spark, stopped)) == {1, 2, 4, 7} and sm.stopped_at(spark, stopped)[1] == 8
    start(spark, stopped, stop_at_control=True)
    assert sm.stopped_at(spark, stopped) is None and sm.control_seen(spark, stopped)
    arrive(spark, stopped, [event(12, 12, "c1")], stop_at_control=True)
    arrive(spark, plain, [event(12, 12, "c1")])
    assert events_of(spark, stopped) == events_of(spark, plain) and set(events_of(spark, plain)) == {1, 2, 4, 5, 7, 11, 12}
    assert quarantine(spark, stopped) == quarantine(spark, plain)
    total = lambda p: sorted((r.type, r.n) for r in sm.tap_counts(spark, p).collect())
    assert total(stopped) == total(plain)


def test_cut_at_the_first_control_message(spark):
    rows = [event(1, 0, "c1", "StasisStart", "k"), event(2, 5, "c1"), event(3, 2, "c1", "ApplicationReplaced"), event(4, 1, "c1"), event(5, 9, "c1")]
    rows.sort(key=lambda r: r[1])
    for cuts in ([5], [2, 5], [1, 3, 5]):
        batches = [rows[a:b] for a, b in zip([0, *cuts], cuts)]
        paths = run(spark, *batches, stop_at_control=True)
        assert set(events_of(spark, paths)) == {1, 4}
        assert sm.control_seen(spark, paths)


def test_replayed_batch_writes_the_same(spark):
    first, second = [event(1, 0, "c1", "StasisStart"), command(2, 0)], [event(3, 5, "c1"), command(4, 6, "/unknown")]
    paths = run(spark, first, second)
    read = lambda: [sorted(map(str, sm.read_output(spark, p).collect())) for p in (paths.events_out, paths.requests_out, paths.quarantine_out, paths.state + "/batch=0")]
    before = read()
    sm.process_batch(spark.createDataFrame(second, COLUMNS), 1, paths)
    assert read() == before
    # the batch failed before its version was stored: it is written again
    state = KeyedState(spark, paths.state)
    state.versions.delete(state.latest().name)
    sm.process_batch(spark.createDataFrame(second, COLUMNS), 1, paths)
    assert read() == before and state.latest().batch == 1


def test_clock_is_monotone_and_bounded():
    t = lambda m: T0 + timedelta(minutes=m)
    assert sm.next_clock(None, t(5)) == t(5) and sm.next_clock(t(5), None) == t(5) and sm.next_clock(None, None) is None
    assert sm.next_clock(t(5), t(1)) == t(5) and sm.next_clock(t(5), t(600), "1 hour") == t(65)


def test_survey_is_what_separate_aggregates_give(spark):
    rows = [event(1, 0, "c1", "StasisStart"), event(2, 9, "c1", "ApplicationReplaced"), event(3, 4, "c1", "ApplicationReplaced"), event(4, 5, "c1", "NoSuchType"), (5, T0, None, "no json", 1, None, None, None), command(6, 7)]
    batch = spark.createDataFrame(rows, COLUMNS)
    events = ev.prepare_events(batch.where("src = 1").select("seq", "ts", "raw"))
    seen = sm.survey(events, batch.where("src = 0"))
    assert (seen.control.ts, seen.control.seq) == (T0 + timedelta(minutes=4), 3)
    assert seen.middle == sm._micros(T0 + timedelta(minutes=4))
    plain = lambda df: sorted(map(tuple, df.select("type", "resource_type", "n").collect()))
    assert plain(mt.counts_by_type(spark, seen.counts.asDict())) == plain(mt.event_counts(events))
    none = sm.survey(events.where("false"), batch.where("false"))
    assert none.middle is None and none.control is None and set(none.counts.asDict().values()) == {0}


def test_batches_are_measured(spark):
    paths = run(spark, [event(1, 0, "c1", "StasisStart", "ctx-1"), event(2, 1, "c1"), event(3, 2, "c9"), event(4, 3, "c8", "StasisStart")], [event(5, 4, "c1")])
    first, second = sm.measurements(spark, paths).orderBy("batch").collect()
    assert (first.lookups, first.misses, first.created, first.written, first.rows_read, first.error) == (3, 2, 1, 2, 0, None)
    assert (second.lookups, second.misses, second.created, second.written) == (1, 0, 0, 0) and second.rows_read >= 1
    assert first.duration_ms > 0 and mt.write_durations(sm.measurements(spark, paths)).first()["count"] == 2
    bad = spark.createDataFrame([event(6, 5, "c1")], COLUMNS).drop("raw")
    with pytest.raises(Exception, match="raw"):
        sm.process_batch(bad, 2, paths)
    assert [r.batch for r in sm.measurements(spark, paths).where("error is not null").collect()] == [2]
    assert sm.measurements(spark, sm.new_paths(spark, "none")).count() == 0


def test_replay_of_few_rows_takes_few_partitions(spark):
    cores, configured = spark.sparkContext.defaultParallelism, spark.conf.get(sm.PARTITIONS)
    try:
        spark.conf.set(sm.PARTITIONS, "200")
        assert sm.replay_partitions(spark, 1_000) == cores
        assert sm.replay_partitions(spark, 50 * sm.PARTITION_ROWS) == 50
        assert sm.replay_partitions(spark, 10_000 * sm.PARTITION_ROWS) == 200
    finally:
        spark.conf.set(sm.PARTITIONS, configured)


def test_a_replay_makes_its_messages_once(spark, monkeypatch):
    """All arrivals take their rows from one written table: a text made anew for each would differ."""
    from datetime import datetime, timedelta
    from types import SimpleNamespace

    from callroute.streaming import stream as sm

    monkeypatch.setattr(sm, "start_router", lambda *a, **k: SimpleNamespace(awaitTermination=lambda: None))
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i)) for i in range(12)]
    events = spark.createDataFrame(rows, "seq long, ts timestamp_ntz").selectExpr("seq", "ts", "uuid() as raw")
    commands = events.selectExpr("seq", "ts", "seq as request_id", "uuid() as raw")
    paths = sm.new_paths(spark, "once")
    sm.feed_in_chunks(spark, events, commands, paths, None)
    for name in ("events", "commands"):
        read = lambda folder, name=name: sorted((r.seq, r.raw) for r in spark.read.parquet(f"{paths.root}/{folder}/{name}").collect())
        assert read("in") == read("tables") and len(read("in")) == 12
