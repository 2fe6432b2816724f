"""text_at corner cases, event classification and counting (hand-written rows)."""

import pytest
from pyspark.sql import functions as F

from callroute.functions.jsonx import parse_messages, text_at
from callroute.operators import events as ev
from callroute.operators import metrics as mt
from callroute.sources.dims import MESSAGE_TYPES

TEXT_AT_CASES = [
    ('{"a":{"b":"x"}}', "x"),
    ('{"a":{"b":7}}', "7"),
    ('{"a":{"b":true}}', "true"),
    ('{"a":{"b":1.5}}', "1.5"),
    ('{"a":{"b":null}}', None),
    ('{"a":{"b":{"c":1}}}', None),
    ('{"a":{"b":[1,2]}}', None),
    ('{"a":{}}', None),
    ('{"a":{"b":""}}', None),
    ('{"a":{"b":"  "}}', None),
    ('{"a":{"b":"\\t"}}', None),
    ('{"a":{"b":" y "}}', " y "),
    ('{"a":{"b":"{not json"}}', "{not json"),
    ("not json at all", None),
    ("", None),
]


def test_text_at_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXT_AT_CASES)], "seq long, raw string")
    got = dict(
        parse_messages(df).select("seq", text_at(F.col("msg"), "/a/b").alias("v")).collect()
    )
    for i, (_, want) in enumerate(TEXT_AT_CASES):
        assert got[i] == want, TEXT_AT_CASES[i]


def _events(spark, rows):
    return spark.createDataFrame(
        [(i, None, r) for i, r in enumerate(rows)], "seq long, ts timestamp_ntz, raw string"
    )


def test_every_wire_type_classified(spark):
    rows = [f'{{"type":"{wire}","channel":{{"id":"c1"}}}}' for _, wire, _, _ in MESSAGE_TYPES]
    out = ev.classify_events(_events(spark, rows)).orderBy("seq").collect()
    assert [r["type"] for r in out] == [t for t, _, _, _ in MESSAGE_TYPES]
    assert [r["resource_type"] for r in out] == [rt for _, _, rt, _ in MESSAGE_TYPES]


def test_resource_ids_and_reasons(spark):
    rows = [
        '{"type":"StasisStart","channel":{"id":"c1","channelvars":{"CALL_CONTEXT":"ctx"}}}',
        '{"type":"StasisStart","channel":{"id":"c2","channelvars":{"CALL_CONTEXT":"  "}}}',
        '{"type":"ChannelTransfer","referred_by":{"source_channel":{"id":"c3"}}}',
        '{"type":"RecordingFinished","recording":{"name":"r1"}}',
        '{"type":"Dial","peer":{"id":"c4"}}',
        '{"type":"ChannelDestroyed","channel":{"id":" "}}',
        '{"type":"AriResponse"}',
        '{"type":"Nope"}',
        '{"channel":{"id":"c5"}}',
        '{"type":"StasisStart", oops',
        '{"type":"ApplicationReplaced","application":"a"}',
        '{"type":null}',
    ]
    out = ev.with_drop_reason(ev.prepare_events(_events(spark, rows))).orderBy("seq").collect()
    assert [r["resource_id"] for r in out] == ["c1", "c2", "c3", "r1", "c4", None, None, None, None, None, None, None]
    assert [r["channel_var"] for r in out][:2] == ["ctx", None]
    assert [r["policy"] for r in out][:3] == ["CREATE_IF_MISSING", "CREATE_IF_MISSING", "LOOKUP_ONLY"]
    assert [r["reason"] for r in out] == [
        None, None, None, None, None, "no_resource_id", "not_routable", "unknown_type", "no_type",
        "malformed", None, "unknown_type",
    ]
    _data, control = ev.split_control(ev.classify_events(_events(spark, rows)))
    assert [r.seq for r in control.collect()] == [10]


def test_event_counts_zero_filled_on_empty_input(spark):
    empty = _events(spark, []).limit(0)
    out = mt.event_counts(ev.prepare_events(empty)).collect()
    assert len(out) == 33 and all(r.n == 0 for r in out)
    dial = [r for r in out if r.type == "DIAL"][0]
    assert dial.resource_type == "NONE"


def test_event_counts_count_broken_messages_as_unknown(spark):
    rows = ["oops", '{"channel":{}}', '{"type":"Dial","peer":{"id":"p"}}']
    out = {r.type: r.n for r in mt.event_counts(ev.prepare_events(_events(spark, rows))).collect()}
    assert out["UNKNOWN"] == 2 and out["DIAL"] == 1


@pytest.mark.parametrize("commands_topic", ["commandsTopic"])
def test_event_envelope_writes_nulls(spark, commands_topic):
    rows = ['{"type":"StasisStart","channel":{"id":"c1"}}', '{"type":"Dial","peer":{"id":"c1"}}']
    df = ev.prepare_events(_events(spark, rows)).withColumn("call_context", F.lit("CTX"))
    out = ev.event_envelopes(df, commands_topic).orderBy("seq").collect()
    import json

    first = json.loads(out[0].value)
    assert first["type"] == "STASIS_START" and first["callContext"] == "CTX"
    assert first["resources"] == [{"type": "CHANNEL", "id": "c1"}]
    assert "commandId" in first and first["commandId"] is None and first["commandRequest"] is None
    assert json.loads(out[1].value)["resources"] == []


def test_a_message_is_read_in_one_walk(spark):
    """One read of all fields, made in a compiled projection; no filter repeats a read."""
    raws = [
        '{"type":"StasisStart","channel":{"id":7,"channelvars":{"CALL_CONTEXT":"c"}}}',
        '{"type":"StasisStart","channel":"no object"}',
        '{"type":null}', '{"type":{"a":1}}', '{"type":"Dial","peer":{"id":["x"]}}', '{"type":"Dial","peer":{"id":"[x]"}}',
        '{"type":" "}', '{"other":1}', '[1]', 'no json', '{"type":"Dial","type":"StasisEnd","channel":{"id":"a"},"peer":{"id":"b"}}',
    ]
    df = spark.createDataFrame(list(enumerate(raws)), "seq long, raw string")
    prepared = ev.prepare_events(df)
    got = {r.seq: (r.has_type, r.type, r.resource_id, r.channel_var) for r in prepared.collect()}
    assert got == {
        0: (True, "STASIS_START", "7", "c"), 1: (True, "STASIS_START", None, None), 2: (True, "UNKNOWN", None, None),
        3: (True, "UNKNOWN", None, None), 4: (True, "DIAL", None, None), 5: (True, "DIAL", "[x]", None),
        6: (True, "UNKNOWN", None, None), 7: (False, "UNKNOWN", None, None), 8: (False, "UNKNOWN", None, None),
        9: (False, "UNKNOWN", None, None), 10: (True, "STASIS_END", "a", None),
    }
    plan = ev.quarantine(prepared)[1].select("seq", "reason")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StringType") <= len(ev.FIELDS) and "explode(array" not in plan
