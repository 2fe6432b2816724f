"""The two dimensions of the protocol, message types and URL routes.

Both are tiny, fixed tables (33 and 43 rows) built as JVM-local VALUES
relations, so joining them is always a broadcast of a proven, constant size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the protocol's definitions for right results).
#
# Message types: (type, wire type, resource type or None, JSON pointer of the
# resource id or None). Order as defined by the protocol.
MESSAGE_TYPES = [
    ("APPLICATION_REPLACED", "ApplicationReplaced", None, None),
    ("BRIDGE_BLIND_TRANSFER", "BridgeBlindTransfer", "CHANNEL", "/channel/id"),
    ("BRIDGE_CREATED", "BridgeCreated", "BRIDGE", "/bridge/id"),
    ("BRIDGE_DESTROYED", "BridgeDestroyed", "BRIDGE", "/bridge/id"),
    ("BRIDGE_MERGED", "BridgeMerged", "BRIDGE", "/bridge/id"),
    ("BRIDGE_VIDEOSOURCE_CHANGED", "BridgeVideoSourceChanged", "BRIDGE", "/bridge/id"),
    ("CHANNEL_CALLERID", "ChannelCallerId", "CHANNEL", "/channel/id"),
    ("CHANNEL_CONNECTED_LINE", "ChannelConnectedLine", "CHANNEL", "/channel/id"),
    ("CHANNEL_CREATED", "ChannelCreated", "CHANNEL", "/channel/id"),
    ("CHANNEL_DESTROYED", "ChannelDestroyed", "CHANNEL", "/channel/id"),
    ("CHANNEL_DIALPLAN", "ChannelDialplan", "CHANNEL", "/channel/id"),
    ("CHANNEL_DTMF_RECEIVED", "ChannelDtmfReceived", "CHANNEL", "/channel/id"),
    ("CHANNEL_ENTERED_BRIDGE", "ChannelEnteredBridge", "BRIDGE", "/bridge/id"),
    ("CHANNEL_HANGUP_REQUEST", "ChannelHangupRequest", "CHANNEL", "/channel/id"),
    ("CHANNEL_HOLD", "ChannelHold", "CHANNEL", "/channel/id"),
    ("CHANNEL_LEFT_BRIDGE", "ChannelLeftBridge", "BRIDGE", "/bridge/id"),
    ("CHANNEL_STATE_CHANGE", "ChannelStateChange", "CHANNEL", "/channel/id"),
    ("CHANNEL_TALKING_FINISHED", "ChannelTalkingFinished", "CHANNEL", "/channel/id"),
    ("CHANNEL_TALKING_STARTED", "ChannelTalkingStarted", "CHANNEL", "/channel/id"),
    ("CHANNEL_TRANSFER", "ChannelTransfer", "CHANNEL", "/referred_by/source_channel/id"),
    ("CHANNEL_UNHOLD", "ChannelUnhold", "CHANNEL", "/channel/id"),
    ("DIAL", "Dial", None, "/peer/id"),
    ("PLAYBACK_CONTINUING", "PlaybackContinuing", "PLAYBACK", "/playback/id"),
    ("PLAYBACK_FINISHED", "PlaybackFinished", "PLAYBACK", "/playback/id"),
    ("PLAYBACK_STARTED", "PlaybackStarted", "PLAYBACK", "/playback/id"),
    ("RECORDING_FAILED", "RecordingFailed", "RECORDING", "/recording/name"),
    ("RECORDING_FINISHED", "RecordingFinished", "RECORDING", "/recording/name"),
    ("RECORDING_STARTED", "RecordingStarted", "RECORDING", "/recording/name"),
    ("STASIS_END", "StasisEnd", "CHANNEL", "/channel/id"),
    ("STASIS_START", "StasisStart", "CHANNEL", "/channel/id"),
    ("RESPONSE", "AriResponse", None, None),
    ("CHANNELVARSET", "ChannelVarset", "CHANNEL", "/channel/id"),
    ("UNKNOWN", "UnknownAriMessage", None, None),
]

# Command types: (command type, resource type, creates a resource, JSON pointer
# of the resource id in the command body or None).
COMMAND_TYPES = [
    ("BRIDGE_CREATION", "BRIDGE", True, "/bridgeId"),
    ("BRIDGE", "BRIDGE", False, "/bridgeId"),
    ("CHANNEL_CREATION", "CHANNEL", True, "/channelId"),
    ("CHANNEL", "CHANNEL", False, "/channelId"),
    ("PLAYBACK_CREATION", "PLAYBACK", True, "/playbackId"),
    ("PLAYBACK", "PLAYBACK", False, "/playbackId"),
    ("RECORDING_CREATION", "RECORDING", True, "/name"),
    ("RECORDING", "RECORDING", False, "/name"),
    ("SNOOPING_CREATION", "SNOOPING", True, "/snoopId"),
    ("UNKNOWN", "UNKNOWN", False, None),
]

# URL path placeholders and the resource type each one names.
PLACEHOLDERS = [
    ("BRIDGE", "{bridgeId}"),
    ("CHANNEL", "{channelId}"),
    ("PLAYBACK", "{playbackId}"),
    ("RECORDING", "{recordingName}"),
    ("SNOOPING", "{snoopId}"),
]

# URL route templates and their command type, in the protocol's listing order.
ROUTES = [
    ("/channels", "CHANNEL_CREATION"),
    ("/channels/create", "CHANNEL_CREATION"),
    ("/channels/{channelId}", "CHANNEL_CREATION"),
    ("/channels/{channelId}/continue", "CHANNEL"),
    ("/channels/{channelId}/move", "CHANNEL"),
    ("/channels/{channelId}/redirect", "CHANNEL"),
    ("/channels/{channelId}/answer", "CHANNEL"),
    ("/channels/{channelId}/ring", "CHANNEL"),
    ("/channels/{channelId}/dtmf", "CHANNEL"),
    ("/channels/{channelId}/mute", "CHANNEL"),
    ("/channels/{channelId}/hold", "CHANNEL"),
    ("/channels/{channelId}/moh", "CHANNEL"),
    ("/channels/{channelId}/silence", "CHANNEL"),
    ("/channels/{channelId}/play", "PLAYBACK_CREATION"),
    ("/channels/{channelId}/play/{playbackId}", "PLAYBACK_CREATION"),
    ("/channels/{channelId}/record", "RECORDING_CREATION"),
    ("/channels/{channelId}/variable", "CHANNEL"),
    ("/channels/{channelId}/snoop", "SNOOPING_CREATION"),
    ("/channels/{channelId}/snoop/{snoopId}", "SNOOPING_CREATION"),
    ("/channels/{channelId}/dial", "CHANNEL"),
    ("/channels/{channelId}/rtp_statistics", "CHANNEL"),
    ("/channels/{channelId}/transfer_progress", "CHANNEL"),
    ("/channels/externalMedia", "CHANNEL_CREATION"),
    ("/bridges", "BRIDGE_CREATION"),
    ("/bridges/{bridgeId}", "BRIDGE_CREATION"),
    ("/bridges/{bridgeId}/addChannel", "BRIDGE"),
    ("/bridges/{bridgeId}/removeChannel", "BRIDGE"),
    ("/bridges/{bridgeId}/videoSource/{channelId}", "BRIDGE"),
    ("/bridges/{bridgeId}/videoSource", "BRIDGE"),
    ("/bridges/{bridgeId}/moh", "BRIDGE"),
    ("/bridges/{bridgeId}/play", "PLAYBACK_CREATION"),
    ("/bridges/{bridgeId}/play/{playbackId}", "PLAYBACK_CREATION"),
    ("/bridges/{bridgeId}/record", "RECORDING_CREATION"),
    ("/playbacks/{playbackId}", "PLAYBACK"),
    ("/playbacks/{playbackId}/control", "PLAYBACK"),
    ("/recordings/stored", "RECORDING"),
    ("/recordings/stored/{recordingName}", "RECORDING"),
    ("/recordings/stored/{recordingName}/file", "RECORDING"),
    ("/recordings/stored/{recordingName}/copy", "RECORDING"),
    ("/recordings/live/{recordingName}", "RECORDING"),
    ("/recordings/live/{recordingName}/stop", "RECORDING"),
    ("/recordings/live/{recordingName}/pause", "RECORDING"),
    ("/recordings/live/{recordingName}/mute", "RECORDING"),
]

# End of fixed values.
# ---------------------------------------------------------------------------

# Default prefixes of state keys and metric names.
STATE_KEY_PREFIX = "callroute:call-context:"
METRIC_PREFIX = "callroute"

NONE_RESOURCE = "NONE"
WILDCARD = "{}"

_PLACEHOLDER_TYPE = {placeholder: rtype for rtype, placeholder in PLACEHOLDERS}
_COMMAND_TYPE = {name: (rtype, creates, path) for name, rtype, creates, path in COMMAND_TYPES}


def _route_rows():
    """Derived attributes of every template, computed from its text.

    ``segments`` counts the '/'-separated parts, ``mask`` is the tuple of
    placeholder positions, ``key`` is the template with every placeholder
    replaced by ``{}`` (the equi-join key), ``placeholders`` are listed right to
    left because the protocol reports path resources in that order.
    """
    rows = []
    for order, (template, ctype) in enumerate(ROUTES):
        parts = template.split("/")
        positions = [i for i, p in enumerate(parts) if p.startswith("{")]
        key = "/".join(WILDCARD if i in positions else p for i, p in enumerate(parts))
        rtype, creates, body_path = _COMMAND_TYPE[ctype]
        placeholders = [(i, _PLACEHOLDER_TYPE[parts[i]]) for i in reversed(positions)]
        # rightmost placeholder of the route's own resource type (first in the right-to-left list)
        own = [i for i, t in placeholders if t == rtype]
        created_pos = own[0] if own else None
        rows.append(
            dict(
                template=template,
                command_type=ctype,
                resource_type=rtype,
                creates=creates,
                body_path=body_path,
                segments=len(parts),
                mask=tuple(positions),
                key=key,
                placeholders=placeholders,
                literal_count=len(parts) - len(positions),
                created_pos=created_pos,
                listing_order=order,
            )
        )
    return rows


ROUTE_ROWS = _route_rows()

# Distinct (segment count, placeholder mask) shapes, most literal first: when a
# URL fits two templates the one with more literal segments wins (the only
# ambiguous URLs are /channels/create and /channels/externalMedia).
ROUTE_SHAPES = sorted(
    {(r["segments"], r["mask"]) for r in ROUTE_ROWS}, key=lambda s: (s[0], len(s[1]), s[1])
)


def _sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _values(spark: SparkSession, rows, names, casts) -> DataFrame:
    """A JVM-local table (``LocalTableScan``) from literal rows: no Python workers."""
    body = ",\n".join("(" + ", ".join(r) + ")" for r in rows)
    df = spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")
    return df.select(*[F.col(n).cast(c).alias(n) for n, c in zip(names, casts)])


def message_types(spark: SparkSession) -> DataFrame:
    """The 33 message types: ``type, wire_type, resource_type, id_path``."""
    rows = [[_sql_lit(v) for v in row] for row in MESSAGE_TYPES]
    return _values(
        spark, rows, ["type", "wire_type", "resource_type", "id_path"], ["string"] * 4
    )


def routes(spark: SparkSession) -> DataFrame:
    """The 43 URL routes with their command type attributes."""
    rows = []
    for r in ROUTE_ROWS:
        ph = ", ".join(f"named_struct('pos', {p}, 'type', {_sql_lit(t)})" for p, t in r["placeholders"])
        rows.append(
            [
                _sql_lit(r["template"]),
                _sql_lit(r["command_type"]),
                _sql_lit(r["resource_type"]),
                _sql_lit(r["creates"]),
                _sql_lit(r["body_path"]),
                str(r["segments"]),
                _sql_lit(r["key"]),
                str(r["literal_count"]),
                f"array({ph})" if ph else "array()",
                "NULL" if r["created_pos"] is None else str(r["created_pos"]),
            ]
        )
    return _values(
        spark,
        rows,
        ["template", "command_type", "resource_type", "creates", "body_path", "segments", "key",
         "literal_count", "placeholders", "created_pos"],
        ["string", "string", "string", "boolean", "string", "int", "string", "int",
         "array<struct<pos:int,type:string>>", "int"],
    )
