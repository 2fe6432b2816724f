"""Routes, resources, strict envelopes and golden command -> response pairs."""

import json

import pytest
from pyspark.sql import functions as F

from callroute.operators import commands as cm
from callroute.sources.dims import ROUTES


def _cmds(spark, rows):
    """rows: (method, url, body json or None, extra envelope fields)"""
    data = []
    for i, (method, url, body, *extra) in enumerate(rows):
        env = {"callContext": "CTX", "commandId": f"id{i}", "ariCommand": {"method": method, "url": url}}
        if body is not None:
            env["ariCommand"]["body"] = body
        for e in extra:
            env.update(e)
        data.append((i, None, i, json.dumps(env)))
    return spark.createDataFrame(data, "seq long, ts timestamp_ntz, request_id long, raw string")


def _sample_url(template):
    return template.replace("{channelId}", "C").replace("{bridgeId}", "B").replace(
        "{playbackId}", "P").replace("{recordingName}", "R").replace("{snoopId}", "S")


def test_every_template_matches_itself(spark):
    rows = [("GET", _sample_url(t), None) for t, _ in ROUTES]
    out = cm.classify_commands(cm.parse_commands(_cmds(spark, rows))).orderBy("seq").collect()
    assert [r.template for r in out] == [t for t, _ in ROUTES]
    assert [r.command_type for r in out] == [c for _, c in ROUTES]


@pytest.mark.parametrize(
    "url,template",
    [
        ("/channels/create", "/channels/create"),
        ("/channels/externalMedia", "/channels/externalMedia"),
        ("/channels/abc", "/channels/{channelId}"),
        ("/channels/abc/", "UNKNOWN"),
        ("/channels//answer", "UNKNOWN"),
        ("", "UNKNOWN"),
        ("?", "UNKNOWN"),
        ("/ari/channels/abc", "UNKNOWN"),
        ("/channels/a\\b", "/channels/{channelId}"),
        ("/channels/abc/answer?x=1", "/channels/{channelId}/answer"),
    ],
)
def test_route_edge_cases(spark, url, template):
    out = cm.classify_commands(cm.parse_commands(_cmds(spark, [("GET", url, None)]))).collect()[0]
    assert out.template == template


def test_metric_label_uses_unsplit_url(spark):
    rows = [("POST", "/channels/X/play?media=sound:a", None), ("DELETE", "/channels/X?reason=n", None)]
    out = cm.metric_path(cm.parse_commands(_cmds(spark, rows))).orderBy("seq").collect()
    assert [r.metric_path for r in out] == ["UNKNOWN", "/channels/{channelId}"]
    out = cm.metric_path(cm.parse_commands(_cmds(spark, rows)), strip_query=True).orderBy("seq").collect()
    assert [r.metric_path for r in out] == ["/channels/{channelId}/play", "/channels/{channelId}"]


def _relations(spark, rows):
    out = cm.prepare_commands(_cmds(spark, rows)).orderBy("seq")
    return [
        (r.rel, r.created_id, r.reason)
        for r in out.select(cm.flatten_resources(F.col("relations"), True).alias("rel"), "created_id", "reason").collect()
    ]


def test_relations_right_to_left_and_created(spark):
    rows = [
        ("POST", "/channels/C/play/P", None),
        ("POST", "/bridges/B/videoSource/C", None),
        ("POST", "/channels/C/play", {"playbackId": "P2"}),
        ("POST", "/channels/C/play", {"playbackId": "P"}),
        ("POST", "/channels/U", {"channelId": "BODY"}),
        ("DELETE", "/channels/D", None),
        ("POST", "/channels", None),
        ("POST", "/channels/create", {"channelId": "N"}),
        ("POST", "/bridges", {"bridgeId": None}),
        ("POST", "/bridges", "just text"),
    ]
    got = _relations(spark, rows)
    assert got[0] == ("PLAYBACK:P:1,CHANNEL:C:0", "P", None)
    assert got[1] == ("CHANNEL:C:0,BRIDGE:B:0", None, None)
    assert got[2] == ("PLAYBACK:P2:1,CHANNEL:C:0", "P2", None)
    assert got[4] == ("CHANNEL:U:1", "U", None)  # URL id wins over body id
    assert got[5] == ("CHANNEL:D:1", "D", None)  # flagged created, but DELETE registers nothing
    assert got[6] == ("", None, "no_created_id")
    assert got[7] == ("CHANNEL:N:1", "N", None)
    assert got[8][2] == "no_created_id" and got[9][2] == "no_created_id"


def test_body_id_already_in_path_is_not_duplicated(spark):
    rows = [("POST", "/bridges/B/play", {"playbackId": "X"}), ("POST", "/channels/C/snoop", {"snoopId": "S"})]
    got = _relations(spark, rows)
    assert got[0][0] == "PLAYBACK:X:1,BRIDGE:B:0"
    assert got[1][0] == "SNOOPING:S:1,CHANNEL:C:0"


def test_strict_envelope(spark):
    rows = [
        ("GET", "/channels/C/answer", None, {"extra": 1}),
        ("GET", "/channels/C/answer", None, {"ariCommand": {"method": "GET", "url": "/x", "oops": 1}}),
        ("POST", "/bridges", {"bridgeId": "b"}, {"callContext": None}),
        ("GET", "/channels/C/answer", None, {"callContext": None}),
        ("FETCH", "/channels/C/answer", None),
    ]
    out = cm.shape_requests(cm.prepare_commands(_cmds(spark, rows)), "http://h/ari").orderBy("seq").collect()
    assert [r.reason for r in out] == ["unknown_field", "unknown_field", "no_call_context", None, "bad_method"]
    regs = cm.context_registrations(cm.prepare_commands(_cmds(spark, rows))).collect()
    assert regs == []


GOLDEN = [
    # (method, url, body, status, result body, resources, payload)
    ("POST", "/bridges", {"bridgeId": "B1"}, 200, '{"id":"B1"}', [("BRIDGE", "B1")], {"status_code": 200, "body": {"id": "B1"}}),
    ("POST", "/channels/C1/play/P1", None, 200, '{"k":"v"}', [("PLAYBACK", "P1"), ("CHANNEL", "C1")], {"status_code": 200, "body": {"k": "v"}}),
    ("POST", "/channels/C1/answer", None, 204, "", [("CHANNEL", "C1")], {"status_code": 204}),
    ("DELETE", "/channels/C1?reason=normal", None, 204, " ", [("CHANNEL", "C1")], {"status_code": 204}),
    ("POST", "/bridges", {"bridgeId": "B2"}, None, None, [("BRIDGE", "B2")], {"status_code": 500}),
]


def test_golden_responses(spark):
    cmds = cm.shape_requests(
        cm.prepare_commands(_cmds(spark, [(m, u, b) for m, u, b, *_ in GOLDEN])), "http://h/ari"
    )
    results = spark.createDataFrame(
        [(i, g[3], g[4], 1.0) for i, g in enumerate(GOLDEN) if g[3] is not None],
        "request_id long, status int, result_body string, duration_ms double",
    )
    pay = cm.response_payloads(cm.correlate_results(cmds.filter("reason is null"), results))
    env = cm.response_envelopes(pay, "commandsTopic").orderBy("request_id").collect()
    assert len(env) == len(GOLDEN)
    for row, g in zip(env, GOLDEN):
        doc = json.loads(row.value)
        assert doc["type"] == "RESPONSE" and doc["callContext"] == "CTX"
        assert [(r["type"], r["id"]) for r in doc["resources"]] == g[5]
        assert doc["payload"] == g[6]
        assert doc["commandRequest"] == {"method": g[0], "url": g[1]}
    assert [r.is_error for r in pay.orderBy("request_id").collect()] == [False, False, False, False, True]


def test_non_json_result_gives_no_response(spark):
    cmds = cm.shape_requests(cm.prepare_commands(_cmds(spark, [("POST", "/channels/C/answer", None)])), "u")
    results = spark.createDataFrame([(0, 404, "oops", 1.0)], "request_id long, status int, result_body string, duration_ms double")
    pay = cm.response_payloads(cm.correlate_results(cmds, results)).collect()[0]
    assert pay.response_reason == "bad_response_body"


def test_command_without_id_keeps_field_out(spark):
    raw = '{"callContext":"CTX","ariCommand":{"method":"POST","url":"/channels/C/answer"}}'
    df = spark.createDataFrame([(0, None, 0, raw)], "seq long, ts timestamp_ntz, request_id long, raw string")
    pay = cm.response_payloads(
        cm.correlate_results(
            cm.shape_requests(cm.prepare_commands(df), "u"),
            spark.createDataFrame([(0, 204, "", 1.0)], "request_id long, status int, result_body string, duration_ms double"),
        )
    )
    doc = json.loads(cm.response_envelopes(pay, "t").collect()[0].value)
    assert "commandId" not in doc and "body" not in doc["payload"]
