"""The protocol by example: expectations written by hand, not derived from the library's own tables."""

import json

from callroute.operators import commands as cm
from callroute.operators import events as ev

# url -> (command type, resources right to left, creates)
COMMANDS = {
    "/channels": ("CHANNEL_CREATION", "", True),
    "/channels/create": ("CHANNEL_CREATION", "", True),
    "/channels/externalMedia": ("CHANNEL_CREATION", "", True),
    "/channels/C": ("CHANNEL_CREATION", "CHANNEL:C", True),
    "/channels/C/answer": ("CHANNEL", "CHANNEL:C", False),
    "/channels/C/transfer_progress": ("CHANNEL", "CHANNEL:C", False),
    "/channels/C/play": ("PLAYBACK_CREATION", "CHANNEL:C", True),
    "/channels/C/play/P": ("PLAYBACK_CREATION", "PLAYBACK:P,CHANNEL:C", True),
    "/channels/C/record": ("RECORDING_CREATION", "CHANNEL:C", True),
    "/channels/C/snoop": ("SNOOPING_CREATION", "CHANNEL:C", True),
    "/channels/C/snoop/S": ("SNOOPING_CREATION", "SNOOPING:S,CHANNEL:C", True),
    "/channels/C/rtp_statistics": ("CHANNEL", "CHANNEL:C", False),
    "/bridges": ("BRIDGE_CREATION", "", True),
    "/bridges/B": ("BRIDGE_CREATION", "BRIDGE:B", True),
    "/bridges/B/addChannel": ("BRIDGE", "BRIDGE:B", False),
    "/bridges/B/videoSource": ("BRIDGE", "BRIDGE:B", False),
    "/bridges/B/videoSource/C": ("BRIDGE", "CHANNEL:C,BRIDGE:B", False),
    "/bridges/B/play/P": ("PLAYBACK_CREATION", "PLAYBACK:P,BRIDGE:B", True),
    "/bridges/B/record": ("RECORDING_CREATION", "BRIDGE:B", True),
    "/playbacks/P": ("PLAYBACK", "PLAYBACK:P", False),
    "/playbacks/P/control": ("PLAYBACK", "PLAYBACK:P", False),
    "/recordings/stored": ("RECORDING", "", False),
    "/recordings/stored/R/copy": ("RECORDING", "RECORDING:R", False),
    "/recordings/live/R/stop": ("RECORDING", "RECORDING:R", False),
    "/invalid": ("UNKNOWN", "", False),
    "/channels/C/unheard": ("UNKNOWN", "", False),
}
# body field -> the creating url that reads it
BODIES = {"bridgeId": "/bridges", "channelId": "/channels/create", "playbackId": "/channels/C/play", "name": "/bridges/B/record", "snoopId": "/channels/C/snoop"}
# wire type -> (type, resource type, where the id stands)
EVENTS = {
    "StasisStart": ("STASIS_START", "CHANNEL", ("channel", "id")),
    "StasisEnd": ("STASIS_END", "CHANNEL", ("channel", "id")),
    "PlaybackStarted": ("PLAYBACK_STARTED", "PLAYBACK", ("playback", "id")),
    "PlaybackFinished": ("PLAYBACK_FINISHED", "PLAYBACK", ("playback", "id")),
    "RecordingStarted": ("RECORDING_STARTED", "RECORDING", ("recording", "name")),
    "RecordingFinished": ("RECORDING_FINISHED", "RECORDING", ("recording", "name")),
    "BridgeCreated": ("BRIDGE_CREATED", "BRIDGE", ("bridge", "id")),
    "BridgeDestroyed": ("BRIDGE_DESTROYED", "BRIDGE", ("bridge", "id")),
    "ChannelDtmfReceived": ("CHANNEL_DTMF_RECEIVED", "CHANNEL", ("channel", "id")),
    "ChannelDestroyed": ("CHANNEL_DESTROYED", "CHANNEL", ("channel", "id")),
    "ChannelHangupRequest": ("CHANNEL_HANGUP_REQUEST", "CHANNEL", ("channel", "id")),
    "Dial": ("DIAL", None, ("peer", "id")),
}


def command(seq, url, body=None, context="k"):
    inner = {"method": "POST", "url": url, **({"body": body} if body is not None else {})}
    return (seq, json.dumps({"callContext": context, "commandId": None, "ariCommand": inner}))


def test_commands_by_url(spark):
    rows = [command(i, url) for i, url in enumerate(COMMANDS)]
    out = cm.path_resources(cm.parse_commands(spark.createDataFrame(rows, "seq long, raw string")))
    got = {r.url: (r.command_type, r.resources, r.creates) for r in out.select("url", "command_type", cm.flatten_resources(out.path_resources).alias("resources"), "creates").collect()}
    assert got == COMMANDS


def test_created_ids_come_from_bodies(spark):
    rows = [command(i, url, {field: f"new-{field}", "other": 1}) for i, (field, url) in enumerate(BODIES.items())]
    rows += [command(10, "/bridges", {"bridgeId": "b"}, context=None), command(11, "/bridges", {"bridgeId": " "}), command(12, "/channels/C/play/P", {"playbackId": "ignored"})]
    out = cm.prepare_commands(spark.createDataFrame(rows, "seq long, raw string"))
    got = {r.seq: (r.created_id, r.reason) for r in out.collect()}
    assert got == {**{i: (f"new-{f}", None) for i, f in enumerate(BODIES)}, 10: ("b", "no_call_context"), 11: (None, "no_created_id"), 12: ("P", None)}


def test_events_by_type(spark):
    rows = [(i, json.dumps({"type": wire, where[0]: {where[1]: f"id-{i}"}})) for i, (wire, (_, _, where)) in enumerate(EVENTS.items())]
    out = ev.prepare_events(spark.createDataFrame(rows, "seq long, raw string")).collect()
    got = {r.wire_type: (r.type, r.resource_type, r.resource_id) for r in out}
    assert got == {wire: (kind, resource, f"id-{i}") for i, (wire, (kind, resource, _)) in enumerate(EVENTS.items())}
