"""DuckDB oracle texts, one per registered query.

They start from the ``*_base`` columns of the adapters (never from the raw
JSON text) and recompute each answer with plain SQL: route matching by a
regular expression per template (as the protocol does), resources with
regexp_extract, the call-context policy as a recursive CTE walking each
resource's ops one by one.
"""

from __future__ import annotations

from callroute.sources.dims import MESSAGE_TYPES, ROUTE_ROWS
from callroute.sources.fixtures import duck_sql


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def _mt() -> str:
    rows = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in MESSAGE_TYPES)
    return f"mt(type, wire_type, resource_type, id_path) as (select * from (values {rows}) v(type, wire_type, resource_type, id_path))"


def _rt() -> str:
    rows = []
    for r in ROUTE_ROWS:
        parts = r["template"].split("/")
        rx = "^" + "/".join("[^/]+" if p.startswith("{") else p for p in parts) + "$"
        rows.append("(" + ", ".join([_lit(r["template"]), _lit(r["command_type"]), _lit(r["creates"]), _lit(rx), str(r["literal_count"])]) + ")")
    return (
        "rt(template, command_type, creates, rx, lit) as (select * from (values "
        + ", ".join(rows)
        + ") v(template, command_type, creates, rx, lit))"
    )


EVENTS = f"""
{_mt()},
ev0 as ({duck_sql('ari_event_base')}),
ev as (
 select b.seq, b.ts, b.user_id, b.event_id, b.wire_type as wt,
  case when b.wire_type in ('#malformed', '#no_type') then null else b.wire_type end as wire_text,
  coalesce(mt.type, 'UNKNOWN') as type, mt.resource_type, mt.id_path,
  case when b.wire_type in ('#malformed', 'ChannelDestroyed', 'ChannelTransfer', 'Dial') or b.wire_type like 'Playback%' or b.wire_type like 'Recording%'
         or b.wire_type in ('BridgeCreated', 'BridgeDestroyed', 'BridgeMerged', 'BridgeVideoSourceChanged') then null
       else 'ch-' || b.user_id end as channel_id,
  case when b.wire_type in ('#no_type', 'ChannelEnteredBridge', 'ChannelLeftBridge') or channel_id is null then null
       when b.event_id % 3 = 0 then 'ctx-' || b.user_id || '-' || (b.event_id % 7) end as channel_var
 from ev0 b left join mt on mt.wire_type = b.wire_type),
evr as (
 select *, case id_path when '/channel/id' then channel_id when '/playback/id' then 'pb-' || (event_id % 201)
   when '/bridge/id' then 'br-' || (user_id % 20) when '/recording/name' then 'rec-' || (event_id % 500 * 8 + 4)
   when '/peer/id' then 'ch-' || user_id when '/referred_by/source_channel/id' then 'ch-' || user_id end as resource_id
 from ev),
evq as (
 select *, case when wt = '#malformed' then 'malformed' when wt = '#no_type' then 'no_type'
   when type = 'APPLICATION_REPLACED' then null when type = 'UNKNOWN' then 'unknown_type'
   when id_path is null then 'not_routable' when resource_id is null then 'no_resource_id' end as reason
 from evr)"""

COMMANDS = f"""
{_rt()},
cb as ({duck_sql('ari_command_base')}),
cmd as (
 select seq, ts, request_id, defect,
  case when defect = 'malformed' then null else call_context end as call_context,
  case when defect = 'malformed' then null else command_id end as command_id,
  case when defect = 'malformed' then null else method end as method,
  case when defect = 'malformed' then null else url end as url,
  case when defect = 'malformed' then null else body end as body,
  case when defect = 'malformed' then null else split_part(url, '?', 1) end as path
 from cb),
cmt as (
 select c.*, m.template, m.command_type, m.creates from cmd c left join (
  select seq, arg_max(template, lit) as template, arg_max(command_type, lit) as command_type, arg_max(creates, lit) as creates
  from cmd join rt on regexp_full_match(cmd.path, rt.rx) group by seq) m using (seq)),
cseg as (
 select *, string_split(template, '/') as tsegs, string_split(path, '/') as psegs,
  case split_part(command_type, '_', 1) when 'BRIDGE' then '{{bridgeId}}' when 'CHANNEL' then '{{channelId}}' when 'PLAYBACK' then '{{playbackId}}'
       when 'RECORDING' then '{{recordingName}}' when 'SNOOPING' then '{{snoopId}}' end as own
 from cmt),
cres as (
 select *,
  coalesce(array_to_string(list_reverse([
    case tsegs[i] when '{{bridgeId}}' then 'BRIDGE' when '{{channelId}}' then 'CHANNEL' when '{{playbackId}}' then 'PLAYBACK'
      when '{{recordingName}}' then 'RECORDING' when '{{snoopId}}' then 'SNOOPING' end || ':' || psegs[i]
    for i in range(1, len(tsegs) + 1) if starts_with(tsegs[i], '{{')]), ','), '') as path_resources,
  case split_part(command_type, '_', 1) when 'BRIDGE' then json_extract_string(body, '$.bridgeId')
       when 'CHANNEL' then json_extract_string(body, '$.channelId')
       when 'RECORDING' then json_extract_string(body, '$.name')
       when 'PLAYBACK' then json_extract_string(body, '$.playbackId')
       when 'SNOOPING' then json_extract_string(body, '$.snoopId') end as body_resource_id
 from cseg),
crel as (
 select *,
  case when coalesce(creates, false) then coalesce(psegs[list_position(tsegs, own)], body_resource_id) end as created_id,
  case when coalesce(creates, false) then split_part(command_type, '_', 1) end as created_type
 from cres),
crel1 as (
 select *, regexp_replace(path_resources, '([A-Z]+:[^,]+)', '\\1:0', 'g') as unmarked, created_type || ':' || created_id as created from crel),
crel2 as (
 select *,
  case when created_id is null then unmarked
       when unmarked = '' then created || ':1'
       when contains(',' || unmarked, ',' || created || ':0') then replace(unmarked, created || ':0', created || ':1')
       else created || ':1,' || unmarked end as relations,
  coalesce(creates, false) and method = 'POST' as is_creation
 from crel1),
cq as (
 select *, case when defect is not null then defect
   when is_creation and created_id is null then 'no_created_id'
   when is_creation and call_context is null then 'no_call_context'
   when method not in ('CONNECT','DELETE','GET','HEAD','OPTIONS','PATCH','POST','PUT','TRACE') then 'bad_method' end as reason,
   coalesce(template, 'UNKNOWN') as template_label
 from crel2)"""

RESULTS = f"""
rs as ({duck_sql('ari_results')})"""

RESULTS_PAY = f"""{RESULTS},
req as (
 select c.*, coalesce(r.status, 500) as status_code, r.status is null as is_error, r.result_body, r.duration_ms,
  coalesce(m.template, 'UNKNOWN') as metric_path
 from cq c left join rs r using (request_id)
 left join (select seq, arg_max(template, lit) as template from cmd join rt on regexp_full_match(cmd.url, rt.rx) group by seq) m using (seq)
 where c.reason is null),
pay as (
 select *, case when result_body is null or trim(result_body) = '' then null else try_cast(result_body as json) end as body_json,
  case when result_body is not null and trim(result_body) <> '' and json_valid(result_body) = false then 'bad_response_body' end as response_reason
 from req)"""

REQUESTS = f"{COMMANDS},{RESULTS_PAY}"

REGS = """
regs as (
 select created_id as resource_id, call_context, ts, 0 as src, seq from cq where is_creation and reason is null)"""

OPS = """
ops as (
 select resource_id as rid, ts, 0 as src, seq, 'put' as k, call_context as ctx from regs
 union all
 select resource_id, ts, 1, seq,
  case when type = 'STASIS_START' and channel_var is not null then 'put' when type = 'STASIS_START' then 'create' else 'lookup' end,
  channel_var from evq where reason is null and resource_id is not null)"""


def _uuid(expr: str) -> str:
    h = f"md5({expr})"
    return f"substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || substr({h},17,4) || '-' || substr({h},21,12)"


FOLD = f"""
o as (select *, row_number() over (partition by rid order by ts, src, seq) as rn from ops),
f as (
 select rid, src, seq, k, rn,
  case k when 'put' then ctx when 'create' then {_uuid("rid || '|' || seq")} end as cur,
  case when k <> 'lookup' then ts end as w,
  k <> 'lookup' as written
 from o where rn = 1
 union all
 select o.rid, o.src, o.seq, o.k, o.rn,
  case when o.k = 'put' then o.ctx when o.ts < f.w + interval 6 hour then f.cur
       when o.k = 'create' then {_uuid("o.rid || '|' || o.seq")} end,
  case when o.k = 'put' then o.ts when o.ts < f.w + interval 6 hour then f.w when o.k = 'create' then o.ts end,
  o.k = 'put' or (o.k = 'create' and not coalesce(o.ts < f.w + interval 6 hour, false))
 from f join o on o.rid = f.rid and o.rn = f.rn + 1)"""

RESOLVED = f"with recursive {EVENTS},{COMMANDS},{REGS},{OPS},{FOLD}"

WRITES = """
writes as (
 select resource_id, call_context, ts, src, seq from regs
 union all
 select resource_id, channel_var, ts, 1, seq from evq where type = 'STASIS_START' and channel_var is not null and resource_id is not null),
state as (
 select resource_id, arg_max(call_context, (ts, src, seq)) as call_context, max(ts) as written_at from writes group by resource_id)"""

LAYERS = """
lbase as (select resource_id, arg_max(call_context, (ts, src, seq)) as call_context from writes where ts < timestamp '2024-01-15' group by resource_id),
lrecent as (select resource_id, arg_max(call_context, (ts, src, seq)) as call_context from writes where ts >= timestamp '2024-01-15' group by resource_id),
lk as (
 select e.seq, e.resource_id, coalesce(r.call_context, b.call_context) as call_context,
  case when r.call_context is not null then 'recent' when b.call_context is not null then 'base' end as layer
 from evq e left join lrecent r using (resource_id) left join lbase b using (resource_id)
 where e.reason is null and e.resource_id is not null)"""

BUCKET_COLS = ", ".join(f"count_if(duration_ms <= {b}) as le_{b}" for b in (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000))
HIST = f"count(duration_ms) as count, sum(duration_ms) as sum, max(duration_ms) as max, quantile_cont(duration_ms, 0.5) as p50, quantile_cont(duration_ms, 0.95) as p95, quantile_cont(duration_ms, 0.99) as p99, {BUCKET_COLS}"

PROBES = f"""
pb as ({duck_sql('probe_base')}),
probes as (select ts, service, case when failed then 1 else 0 end as n_errors from pb)"""

ROUTED = f"""{RESOLVED},
rv as (select e.*, f.cur as call_context from evq e left join f on f.rid = e.resource_id and f.src = 1 and f.seq = e.seq where e.type <> 'APPLICATION_REPLACED' or e.wt = '#malformed'),
rq as (select *, coalesce(reason, case when call_context is null then 'no_context' end) as reason2 from rv)"""


ORACLE = {
    "read_events": f"select * from ({duck_sql('ari_events')})",
    "read_commands": f"select * from ({duck_sql('ari_commands')})",
    "message_types": f"with {EVENTS} select mt.type, mt.resource_type, mt.id_path, (select count(*) from ev0 where ev0.wire_type = mt.wire_type) as n from mt",
    "routes": f"with {COMMANDS} select template, command_type, creates, (select count(*) from cmt where cmt.template = rt.template) as n from rt",
    "parse_messages": f"with {EVENTS} select seq, wt = '#malformed' as malformed from ev",
    "text_at": f"""with {EVENTS} select seq, channel_id,
        case when wt = 'Dial' then 'ch-' || user_id end as peer_id,
        case when wt in ('BridgeCreated', 'BridgeDestroyed', 'BridgeMerged', 'BridgeVideoSourceChanged', 'ChannelEnteredBridge', 'ChannelLeftBridge') then 'br-' || (user_id % 20) end as bridge_id,
        case when wt like 'Playback%' then 'pb-' || (event_id % 201) end as playback_id,
        case when wt in ('#malformed', '#no_type') then null else 'app-' || (user_id % 3) end as application from ev""",
    "classify_events": f"with {EVENTS} select seq, wire_text as wire_type, type, resource_type, id_path from ev",
    "extract_resource_id": f"with {EVENTS} select seq, type, resource_id from evr",
    "channel_var_context": f"with {EVENTS} select seq, channel_var from ev",
    "context_policy": f"with {EVENTS} select seq, case when type = 'STASIS_START' then 'CREATE_IF_MISSING' else 'LOOKUP_ONLY' end as policy from ev",
    "split_control": f"with {EVENTS} select seq, ts, type from ev where type = 'APPLICATION_REPLACED'",
    "quarantine": f"{ROUTED} select reason2 as reason, count(*) as n from rq where reason2 is not null group by 1",
    "event_envelopes": f"""{ROUTED} select seq, type, call_context,
        case when resource_type is null then '' else resource_type || ':' || resource_id end as resources,
        'commands' as commands_topic, cast(null as varchar) as command_id, type as json_type from rq where reason2 is null""",
    "parse_commands": f"with {COMMANDS} select seq, call_context, command_id, method, url, defect as reason from cmd",
    "command_path": f"with {COMMANDS} select seq, path from cmd",
    "classify_commands": f"with {COMMANDS} select seq, coalesce(template, 'UNKNOWN') as template, coalesce(command_type, 'UNKNOWN') as command_type, coalesce(creates, false) as creates from cmt",
    "metric_path": f"with {COMMANDS} select c.seq, coalesce(m.template, 'UNKNOWN') as metric_path from cmd c left join (select seq, arg_max(template, lit) as template from cmd join rt on regexp_full_match(cmd.url, rt.rx) group by seq) m using (seq)",
    "path_resources": f"with {COMMANDS} select seq, path_resources as resources from cres",
    "body_resource_id": f"with {COMMANDS} select seq, body_resource_id from cres",
    "resource_relations": f"with {COMMANDS} select seq, relations, created_id from crel2",
    "creation_commands": f"with {COMMANDS} select seq, created_id from crel2 where is_creation",
    "reject_unaddressed": f"with {COMMANDS} select seq, url from cq where reason = 'no_created_id'",
    "shape_requests": f"with {COMMANDS} select request_id, method as http_method, 'http://localhost:8088/ari' || url as uri, body as request_body, reason from cq",
    "response_payloads": f"with {REQUESTS} select request_id, status_code, case when response_reason is null then cast(body_json as varchar) end as body_json, response_reason from pay",
    "response_envelopes": f"""with {REQUESTS} select request_id, 'RESPONSE' as type, call_context, status_code, body_json is not null as has_body,
        regexp_replace(relations, ':[01](,|$)', '\\1', 'g') as resources, command_id, method, url, command_id as json_command_id from pay where response_reason is null""",
    "correlate_results": f"with {REQUESTS} select request_id, status_code, is_error from req",
    "namespaced_key": f"with {COMMANDS},{REGS} select seq, resource_id, 'callroute:call-context:' || resource_id as state_key from regs",
    "context_registrations": f"with {COMMANDS},{REGS} select resource_id, call_context, ts, seq from regs",
    "lookup_contexts": f"""with {EVENTS},{COMMANDS},{REGS},{WRITES},
        lk as (select resource_id as rid, ts, 1 as src, seq from evq where reason is null and resource_id is not null and type <> 'STASIS_START')
        select l.rid, l.seq, (select arg_max(w.call_context, (w.ts, w.src, w.seq)) from writes w
          where w.resource_id = l.rid and (w.ts, w.src, w.seq) <= (l.ts, l.src, l.seq)) as call_context from lk l""",
    "resolve_contexts": f"{RESOLVED} select rid, src, seq, cur as call_context from f",
    "generated_context": f"{RESOLVED} select rid, seq, cur as call_context from f where k = 'create' and written",
    "upsert_latest": f"with {EVENTS},{COMMANDS},{REGS},{WRITES} select * from state",
    "expire_state": f"with {EVENTS},{COMMANDS},{REGS},{WRITES} select * from state where written_at >= (select max(ts) from events) - interval 6 hour",
    "lookup_state": f"with {EVENTS},{COMMANDS},{REGS},{WRITES} select e.seq, e.resource_id, s.call_context from evq e left join state s using (resource_id) where e.reason is null and e.resource_id is not null",
    "lookup_layered": f"with {EVENTS},{COMMANDS},{REGS},{WRITES},{LAYERS} select * from lk",
    "missing_required": f"with {EVENTS},{COMMANDS},{REGS} select distinct resource_id as name from regs where resource_id not in (select resource_id from evr where resource_id is not null)",
    "event_counts": f"with {EVENTS} select mt.type, coalesce(mt.resource_type, 'NONE') as resource_type, count(ev.seq) as n from mt left join ev on ev.type = mt.type group by 1, 2",
    "request_counts": f"with {REQUESTS} select method, metric_path as path, count(*) as requests, count_if(is_error) as errors from req group by 1, 2",
    "request_durations": f"with {REQUESTS} select method, metric_path as path, {HIST} from req group by 1, 2",
    "lookup_stats": f"""with {EVENTS},{COMMANDS},{REGS},{WRITES},{LAYERS} select count(*) as attempts, count_if(layer is null) as misses,
        count_if(layer = 'recent') as recent_hits, count_if(layer = 'base') as base_hits from lk""",
    "write_durations": f"with {COMMANDS},{RESULTS},{REGS} select {HIST} from regs join rs on rs.request_id = regs.seq",
    "drop_counts": f"""{ROUTED}, d as (select 'event' as processor, reason2 as reason from rq where reason2 is not null
        union all select 'commandResponse', reason from cq where reason is not null)
        select processor, reason, count(*) as n from d group by 1, 2""",
    "merge_reports": f"with {PROBES} select service, count(*) as reports, cast(sum(n_errors) as bigint) as n_errors, sum(n_errors) = 0 as is_ok from probes group by 1",
    "availability": f"with {PROBES} select service, arg_max(case when n_errors = 0 then 1 else 0 end, (ts, case when n_errors = 0 then 1 else 0 end)) as value from probes group by 1",
    "with_common_tags": f"with {REQUESTS} select method, metric_path as path, count(*) as requests, count_if(is_error) as errors, 'callroute' as service, 'test' as env from req group by 1, 2",
    "route_events": f"""{ROUTED} select seq, call_context as key, type, resource_type, resource_id,
        row_number() over (partition by call_context order by ts, seq) as key_seq from rq where reason2 is null""",
    "route_responses": f"""with {REQUESTS} select request_id, call_context as key, status_code,
        regexp_replace(relations, ':[01](,|$)', '\\1', 'g') as resources, command_id,
        row_number() over (partition by call_context order by ts, seq) as key_seq from pay where response_reason is null""",
    "order_by_key": f"""with {REQUESTS} select call_context as key, seq,
        row_number() over (partition by call_context order by ts, seq) as key_seq from pay where response_reason is null""",
    "write_keyed": f"""with {REQUESTS} select 'events-and-responses' as topic, call_context as key, status_code, url from pay where response_reason is null""",
}


LE = [(f".le_{b}", f"count_if(duration_ms <= {b})") for b in (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)]


def _service_metrics() -> str:
    parts = [
        f"""select 'callroute.events' as metric, 'eventType=' || mt.type || ',resourceType=' || coalesce(mt.resource_type, 'NONE') as tags,
            cast(count(ev.seq) as double) as value from mt left join ev on ev.type = mt.type group by mt.type, mt.resource_type""",
        "select 'callroute.outgoing.requests', 'method=' || method || ',path=' || metric_path, count(*) from req group by method, metric_path",
        "select 'callroute.outgoing.requests.errors', 'method=' || method || ',path=' || metric_path, count_if(is_error) from req group by method, metric_path",
    ]
    for suffix, agg in [(".count", "count(duration_ms)"), (".sum", "sum(duration_ms)"), (".max", "max(duration_ms)"),
                        (".p50", "quantile_cont(duration_ms, 0.5)"), (".p95", "quantile_cont(duration_ms, 0.95)"),
                        (".p99", "quantile_cont(duration_ms, 0.99)"), *LE]:
        parts.append(f"select 'callroute.outgoing.requests.duration{suffix}', 'method=' || method || ',path=' || metric_path, {agg} from req group by method, metric_path")
    parts += [
        "select 'callroute.cache.read.attempts', '', count(*) from lk",
        "select 'callroute.cache.read.misses', '', count_if(layer is null) from lk",
        "select 'callroute.cache.read.recent_hits', '', count_if(layer = 'recent') from lk",
        "select 'callroute.cache.read.base_hits', '', count_if(layer = 'base') from lk",
    ]
    for suffix, agg in [(".count", "count(duration_ms)"), (".sum", "sum(duration_ms)"), (".max", "max(duration_ms)"),
                        (".p50", "quantile_cont(duration_ms, 0.5)"), (".p95", "quantile_cont(duration_ms, 0.95)"),
                        (".p99", "quantile_cont(duration_ms, 0.99)"), *LE]:
        parts.append(f"select 'callroute.persistence.write.duration{suffix}', '', {agg} from regs join rs on rs.request_id = regs.seq")
    parts += [
        """select 'callroute.processor.drops', 'processor=' || processor || ',reason=' || reason, count(*) from (
            select 'event' as processor, reason2 as reason from rq where reason2 is not null
            union all select 'commandResponse', reason from cq where reason is not null) group by processor, reason""",
        """select 'callroute.backing_service.availability', 'backing_service=' || service,
            arg_max(case when n_errors = 0 then 1 else 0 end, (ts, case when n_errors = 0 then 1 else 0 end)) from probes group by service""",
    ]
    body = "\nunion all ".join(parts)
    return f"""{ROUTED},{RESULTS_PAY},{WRITES},{LAYERS},{PROBES},
        m(metric, tags, value) as ({body})
        select metric, tags, cast(value as double) as value, 'callroute' as service, 'test' as env from m"""


ORACLE["service_metrics"] = _service_metrics()

# The streaming router must give exactly the batch answers.
ORACLE["stream_route_events"] = ORACLE["route_events"]
ORACLE["stream_commands_to_requests"] = ORACLE["route_responses"]
ORACLE["tap_counts"] = ORACLE["event_counts"]
ORACLE["stream_requests"] = f"with {COMMANDS} select request_id, call_context, method, 'http://localhost:8088/ari' || url as uri, body from cq where reason is null"
LOST = f"""{ROUTED},{RESULTS_PAY}, lost as (
 select 'event' as processor, reason2 as reason, seq from rq where reason2 is not null
 union all select 'commandResponse', reason, seq from cq where reason is not null
 union all select 'commandResponse', response_reason, seq from pay where response_reason is not null)"""
ORACLE["stream_quarantine"] = f"{LOST}, unclaimed as (select request_id from rs where request_id not in (select request_id from req)), every as (select processor, reason from lost union all select 'commandResponse', 'unclaimed_result' from unclaimed) select processor, reason, count(*) as n from every group by 1, 2"
ORACLE["quarantined_messages"] = f"""{LOST}, texts as (select 'event' as processor, seq, raw from ({duck_sql('ari_events')}) union all select 'commandResponse', seq, raw from ({duck_sql('ari_commands')}))
 select processor, reason, seq, raw from lost join texts using (processor, seq)"""
ORACLE["report_errors"] = f"with {PROBES} select service, 'probe of ' || service || ' failed' as error, count(*) as n from probes where n_errors > 0 group by 1"
ORACLE["stop_on_control"] = f"""{ROUTED}, stop as (select ts, seq from ev where type = 'APPLICATION_REPLACED' order by ts, seq limit 1)
 select rq.seq, rq.call_context as key, rq.type from rq left join stop on true
 where rq.reason2 is null and (stop.ts is null or (rq.ts, rq.seq) < (stop.ts, stop.seq))"""
ORACLE["context_lookups"] = f"{RESOLVED} select k, count(*) as attempts, count(*) filter (cur is null or written) as misses, count(*) filter (written) as created from f where k <> 'put' group by k"
ORACLE["read_event_lines"] = f"with {EVENTS}, texts as (select seq, raw from ({duck_sql('ari_events')})) select raw, type from evr join texts using (seq)"
ORACLE["stream_events"] = ORACLE["read_event_lines"]
ORACLE["lookup_laid_out"] = ORACLE["lookup_layered"]
