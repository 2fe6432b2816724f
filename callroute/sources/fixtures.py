"""Adapters that turn the driver's test tables into telephony traffic.

The test tables hold no telephony data, so these deterministic projections
write raw JSON event messages, command envelopes and HTTP results whose
shapes follow the protocol. They only produce input rows; all routing work
happens in the library operators. The same texts run in DuckDB (``duck=True``)
so the oracle side can start from the ``*_base`` columns without parsing JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callroute.sources.dims import MESSAGE_TYPES, ROUTES

TS_SPARK = (
    "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast((o_orderkey * 7) % 43200 as int))"
)
TS_DUCK = "timestamp '2024-01-01' + to_minutes((o_orderkey * 7) % 43200)"

TASK_ROWS = 50_000  # rows that one task turns into messages and parses: a few seconds' work

# Every seventh event goes through all message types but the control message, every ninth command through all routes.
_SWEEP_TYPES = [wire for _, wire, _, _ in MESSAGE_TYPES if wire != "ApplicationReplaced"]
_TYPE_CASES = " ".join(f"when {i} then '{wire}'" for i, wire in enumerate(_SWEEP_TYPES))
_SWEEP_IDS = {
    "{channelId}": "ch-' || (o_custkey % 150) || '",
    "{bridgeId}": "br-' || (o_custkey % 20) || '",
    "{playbackId}": "pb-' || (o_orderkey % 201) || '",
    "{recordingName}": "rec-' || o_orderkey || '",
    "{snoopId}": "sn-' || o_orderkey || '",
}


def _url_text(template: str) -> str:
    for placeholder, text in _SWEEP_IDS.items():
        template = template.replace(placeholder, text)
    return f"'{template}'"


_URL_CASES = " ".join(f"when {i} then {_url_text(template)}" for i, (template, _) in enumerate(ROUTES))

EVENT_BASE = f"""
select event_id as seq, ts, user_id, event_id, event_type, value, case
 when event_id % 2500 = 2499 then 'ApplicationReplaced'
 when event_id % 7 = 3 then case cast((event_id - 3) / 7 as bigint) % {len(_SWEEP_TYPES)} {_TYPE_CASES} end
 when event_type = 'signup' then 'StasisStart'
 when event_type = 'view' then case when event_id % 2 = 0 then 'ChannelDtmfReceived' else 'ChannelStateChange' end
 when event_type = 'click' then case when event_id % 2 = 0 then 'PlaybackStarted' else 'PlaybackFinished' end
 when event_type = 'purchase' then case when event_id % 2 = 0 then 'BridgeCreated' else 'Dial' end
 when event_id % 4 = 0 then 'SomethingElse'
 when event_id % 8 = 1 then '#malformed'
 when event_id % 8 = 5 then '#no_type'
 when event_id % 4 = 2 then 'ChannelDestroyed'
 else 'StasisEnd' end as wire_type from {{events}}
"""

EVENTS = """
select seq, ts, case
 when wire_type = '#malformed' then '{{"type":"StasisStart", oops'
 when wire_type = '#no_type' then '{{"channel":{{"id":"ch-' || user_id || '"}}}}'
 else '{{"type":"' || wire_type || '",' || case
  when wire_type like 'Playback%' then '"playback":{{"id":"pb-' || (event_id % 201) || '"}}'
  when wire_type like 'Recording%' then '"recording":{{"name":"rec-' || (event_id % 500 * 8 + 4) || '"}}'
  when wire_type = 'ChannelTransfer' then '"referred_by":{{"source_channel":{{"id":"ch-' || user_id || '"}}}}'
  when wire_type in ('ChannelEnteredBridge', 'ChannelLeftBridge') then '"bridge":{{"id":"br-' || (user_id % 20) || '"}},"channel":{{"id":"ch-' || user_id || '"}}'
  when wire_type like 'Bridge%' and wire_type <> 'BridgeBlindTransfer' then '"bridge":{{"id":"br-' || (user_id % 20) || '"}}'
  when wire_type = 'Dial' then '"peer":{{"id":"ch-' || user_id || '"}}'
  when wire_type = 'ChannelDestroyed' then '"channel":{{"id":" "}}'
  else '"channel":{{"id":"ch-' || user_id || '","channelvars":{{"CALL_CONTEXT":"' || case when event_id % 3 = 0 then 'ctx-' || user_id || '-' || (event_id % 7) else '' end || '"}}}}' end
  || ',"application":"app-' || (user_id % 3) || '"}}' end as raw from ({base}) b
"""

COMMAND_BASE = f"""
select o_orderkey as seq, {{ts}} as ts, o_orderkey as request_id, case when o_orderkey % 29 = 7 then null else 'ctx-' || (o_custkey % 150) || '-cmd' end as call_context,
 case when o_orderkey % 10 = 0 then null else 'cmd-' || o_orderkey end as command_id,
 case when o_orderkey % 64 = 47 then 'FETCH' when o_orderkey % 8 = 3 then 'DELETE' when o_orderkey % 8 = 7 then 'GET' else 'POST' end as method,
 case when o_orderkey % 9 = 5 then case cast((o_orderkey - 5) / 9 as bigint) % {len(ROUTES)} {_URL_CASES} end || case when o_orderkey % 4 = 1 then '?a=b/c' else '' end
  else case o_orderkey % 8
  when 0 then '/channels/ch-' || (o_custkey % 150) || '/play/pb-' || (o_orderkey % 201) || '?lang=de'
  when 1 then '/channels/ch-' || (o_custkey % 150) || '/answer'
  when 2 then '/bridges'
  when 3 then '/channels/ch-' || (o_custkey % 150) || '?reason=normal'
  when 4 then '/channels/ch-' || (o_custkey % 150) || '/record'
  when 5 then '/channels'
  when 6 then '/channels/create'
  else '/unknown/route' end end as url,
 case when o_orderkey % 9 = 5 then case when o_orderkey % 5 < 3 then '{{{{"bridgeId":"br-' || (o_custkey % 20) || '","channelId":"ch-' || (o_custkey % 150) || '","name":"rec-' || o_orderkey || '","playbackId":"pb-' || (o_orderkey % 201) || '","snoopId":"sn-' || o_orderkey || '"}}}}' end
  else case o_orderkey % 8 when 2 then '{{{{"bridgeId":"br-' || (o_custkey % 20) || '"}}}}' when 4 then '{{{{"name":"rec-' || o_orderkey || '"}}}}'
  when 6 then '{{{{"channelId":"ch-' || (o_custkey % 150) || '"}}}}' end end as body,
 case when o_orderkey % 64 = 15 then 'malformed' when o_orderkey % 64 = 31 then 'unknown_field' end as defect from {{orders}}
"""

COMMANDS = """
select seq, ts, request_id, case when defect = 'malformed' then 'not json' else
 '{{' || coalesce('"callContext":"' || call_context || '",', case when seq % 2 = 0 then '"callContext":null,' else '' end) || coalesce('"commandId":"' || command_id || '",', '') || case when defect = 'unknown_field' then '"extra":1,' else '' end
 || '"ariCommand":{{"method":"' || method || '","url":"' || url || '"' || coalesce(',"body":' || body, '') || '}}}}' end as raw from ({base}) b
"""

RESULTS = """
select l_orderkey as request_id, case l_returnflag when 'N' then 200 when 'A' then 204 else 404 end as status,
 case when l_returnflag = 'N' then '{{"n":' || l_linenumber || '}}' when l_returnflag = 'A' then '' when l_linenumber % 2 = 0 then 'oops' else '{{"message":"no"}}' end as result_body,
 l_quantity * 100 as duration_ms from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as rn from {lineitem}) t where rn = 1
"""

# Probe log for the availability audits: one probe per event row, the
# service is the event type, every fifth probe reports an error.
PROBE_BASE = """
select ts, event_type as service, event_id, event_id % 5 = 0 as failed from {events}
"""


def duck_sql(name: str) -> str:
    """The adapter text for DuckDB with the driver's view names."""
    base_e = EVENT_BASE.format(events="events")
    base_c = COMMAND_BASE.format(ts=TS_DUCK, orders="orders")
    texts = {
        "ari_event_base": base_e,
        "ari_events": EVENTS.format(base=base_e),
        "ari_command_base": base_c,
        "ari_commands": COMMANDS.format(base=base_c),
        "ari_results": RESULTS.format(lineitem="lineitem"),
        "probe_base": PROBE_BASE.format(events="events"),
    }
    return texts[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` to tasks of some ``TASK_ROWS`` rows, as a file's row groups may be few and large.

    The number of rows comes from the files' footers. What fits one task stays as it is.
    """
    rows = df.count()
    if rows <= TASK_ROWS:
        return df
    return df.repartition(max(-(-rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism), key)


def ari_event_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVENT_BASE.replace("{events}", "{t}"), t=spread(table(spark, sf_dir, "events"), "event_id"))


def ari_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw event messages ``(seq, ts, raw)``."""
    base = ari_event_base(spark, sf_dir)
    return spark.sql(EVENTS.replace("({base})", "{b}"), b=base)


def ari_command_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = COMMAND_BASE.replace("{ts}", TS_SPARK).replace("{orders}", "{t}")
    return spark.sql(text, t=spread(table(spark, sf_dir, "orders"), "o_orderkey"))


def ari_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw command messages ``(seq, ts, request_id, raw)``."""
    base = ari_command_base(spark, sf_dir)
    return spark.sql(COMMANDS.replace("({base})", "{b}"), b=base)


def ari_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP results ``(request_id, status, result_body, duration_ms)``; some requests have none."""
    return spark.sql(RESULTS.replace("{lineitem}", "{t}"), t=table(spark, sf_dir, "lineitem"))


def ari_result_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HTTP results as messages that arrive 36 hours after their request, thus often in a later batch."""
    at = TS_SPARK.replace("o_orderkey", "request_id")
    return ari_results(spark, sf_dir).selectExpr(
        "request_id", "request_id as seq", f"{at} + interval 36 hours as ts", "cast(status as int) as status",
        "result_body", "cast(duration_ms as double) as duration_ms",
    )


def probe_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe log ``(ts, service, errors array<string>)`` for the audits."""
    base = spark.sql(PROBE_BASE.replace("{events}", "{t}"), t=table(spark, sf_dir, "events"))
    return base.selectExpr(
        "ts",
        "service",
        "case when failed then array('probe of ' || service || ' failed') else array() end as errors",
    )
