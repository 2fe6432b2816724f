"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query starts from the driver's tables through the adapters in
``callroute.sources.fixtures`` (raw JSON messages and HTTP results) and runs
the library operators on all rows. Output columns are typed and named as in
the DuckDB oracle (``callroute.plans.oracle``); arrays are flattened to text.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callroute.functions.ids import namespaced_key
from callroute.functions.jsonx import parse_messages, text_at
from callroute.operators import commands as cm
from callroute.operators import events as ev
from callroute.operators import metrics as mt
from callroute.operators import state as st
from callroute.plans import jobs
from callroute.session import materialize, scratch_path
from callroute.sources import dims, io
from callroute.sources import fixtures as fx
from callroute.sources.sink import KeyedSink

LAYER_SPLIT = datetime(2024, 1, 15)
COMMON_TAGS = {"service": "callroute", "env": "test"}


def _events(spark, d):
    return fx.ari_events(spark, d)


def _commands(spark, d):
    return fx.ari_commands(spark, d)


def _prepared(spark, d):
    return ev.with_drop_reason(ev.prepare_events(_events(spark, d)))


def _cmds(spark, d):
    return cm.shape_requests(cm.prepare_commands(_commands(spark, d)), jobs.BASE_URI)


# --- sources / sinks -------------------------------------------------------


def q_read_events(spark, d):
    path = scratch_path(spark, "raw-events")
    _events(spark, d).write.mode("overwrite").parquet(path)
    return io.read_events(spark, path)


def q_read_commands(spark, d):
    path = scratch_path(spark, "raw-commands")
    _commands(spark, d).write.mode("overwrite").parquet(path)
    return io.read_commands(spark, path).select("seq", "ts", "request_id", "raw")


def _event_lines(spark, d):
    """The raw events as text files, a message a line, named in time order."""
    path = scratch_path(spark, "lines")
    _events(spark, d).repartitionByRange(4, "ts", "seq").sortWithinPartitions("ts", "seq").select("raw").write.mode("overwrite").text(path)
    return path


def q_read_event_lines(spark, d):
    """S1 on text: every line a message; where its type stands is read like that of any source."""
    return ev.classify_events(io.read_events(spark, _event_lines(spark, d), fmt="text", splitBytes=65_536)).select("raw", "type")


def q_stream_events(spark, d):
    """S2 on text: the same lines as a stream."""
    base = scratch_path(spark, "lines-stream")
    lines = ev.classify_events(io.stream_events(spark, _event_lines(spark, d), fmt="text")).select("raw", "type")
    lines.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out", format="parquet").awaitTermination()
    return spark.read.schema("raw string, type string").parquet(f"{base}/out")


def q_write_keyed(spark, d):
    """All response records through the keyed sink; a repeated attempt adds nothing."""
    base = scratch_path(spark, "keyed")
    path = f"{base}/topic"
    routed = jobs.route_responses(_commands(spark, d), fx.ari_results(spark, d))
    records = routed.select("topic", "key", "value", "ts", "src", "seq", F.col("request_id").alias("record_id"))
    records.write.parquet(f"{base}/outbox")
    sink = KeyedSink(spark, f"{base}/markers", path)
    for _attempt in range(2):
        sink.publish(spark.read.parquet(f"{base}/outbox"), "responses")
    back = spark.read.parquet(path)
    return back.select(
        "topic",
        "key",
        F.try_variant_get(F.try_parse_json("value"), "$.payload.status_code", "int").alias("status_code"),
        F.try_variant_get(F.try_parse_json("value"), "$.commandRequest.url", "string").alias("url"),
    )


def q_order_by_key(spark, d):
    routed = jobs.route_responses(_commands(spark, d), fx.ari_results(spark, d))
    return io.with_key_sequence(routed).select("key", "seq", "key_seq")


def q_message_types(spark, d):
    """The message types with the number of messages that carry each wire type."""
    carried = ev.classify_events(_events(spark, d)).groupBy("wire_type").agg(F.count(F.lit(1)).alias("n"))
    return dims.message_types(spark).join(carried, "wire_type", "left").select(
        "type", "resource_type", "id_path", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def q_routes(spark, d):
    """The routes with the number of commands addressed to each."""
    taken = cm.classify_commands(cm.command_path(cm.parse_commands(_commands(spark, d)))).groupBy("template").agg(F.count(F.lit(1)).alias("n"))
    return dims.routes(spark).join(taken, "template", "left").select(
        "template", "command_type", "creates", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


# --- event projections -------------------------------------------------------


def q_parse_messages(spark, d):
    return parse_messages(_events(spark, d)).select("seq", "malformed")


def q_text_at(spark, d):
    p = parse_messages(_events(spark, d))
    return p.select(
        "seq",
        text_at(F.col("msg"), "/channel/id").alias("channel_id"),
        text_at(F.col("msg"), "/peer/id").alias("peer_id"),
        text_at(F.col("msg"), "/bridge/id").alias("bridge_id"),
        text_at(F.col("msg"), "/playback/id").alias("playback_id"),
        text_at(F.col("msg"), "/application").alias("application"),
    )


def q_classify_events(spark, d):
    return ev.classify_events(_events(spark, d)).select("seq", "wire_type", "type", "resource_type", "id_path")


def q_extract_resource_id(spark, d):
    return ev.extract_resource_id(_events(spark, d)).select("seq", "type", "resource_id")


def q_channel_var_context(spark, d):
    return ev.channel_var_context(_events(spark, d)).select("seq", "channel_var")


def q_context_policy(spark, d):
    return ev.context_policy(_events(spark, d)).select("seq", "policy")


def q_split_control(spark, d):
    _data, control = ev.split_control(ev.classify_events(_events(spark, d)))
    return control.select("seq", "ts", "type")


def q_quarantine(spark, d):
    regs = cm.context_registrations(cm.prepare_commands(_commands(spark, d)))
    _good, bad = ev.quarantine(jobs.counted_events(_events(spark, d), regs))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def q_event_envelopes(spark, d):
    # an event without a resource id has no envelope
    good, _bad = ev.quarantine(jobs.routed_events(_events(spark, d), _commands(spark, d), unaddressed=False))
    env = ev.event_envelopes(good, jobs.COMMANDS_TOPIC)
    return env.select(
        "seq",
        F.col("envelope.type").alias("type"),
        F.col("envelope.callContext").alias("call_context"),
        cm.flatten_resources(F.col("envelope.resources")).alias("resources"),
        F.col("envelope.commandsTopic").alias("commands_topic"),
        F.col("envelope.commandId").alias("command_id"),
        F.try_variant_get(F.try_parse_json("value"), "$.type", "string").alias("json_type"),
    )


# --- command projections -----------------------------------------------------


def q_parse_commands(spark, d):
    p = cm.parse_commands(_commands(spark, d))
    return p.select(
        "seq",
        F.col("callContext").alias("call_context"),
        F.col("commandId").alias("command_id"),
        "method",
        "url",
        "reason",
    )


def q_command_path(spark, d):
    return cm.command_path(cm.parse_commands(_commands(spark, d))).select("seq", "path")


def q_classify_commands(spark, d):
    c = cm.classify_commands(cm.parse_commands(_commands(spark, d)))
    return c.select("seq", "template", "command_type", "creates")


def q_metric_path(spark, d):
    return cm.metric_path(cm.parse_commands(_commands(spark, d))).select("seq", "metric_path")


def q_path_resources(spark, d):
    p = cm.path_resources(cm.parse_commands(_commands(spark, d)))
    return p.select("seq", cm.flatten_resources(F.col("path_resources")).alias("resources"))


def q_body_resource_id(spark, d):
    p = cm.body_resource_id(cm.parse_commands(_commands(spark, d)))
    return p.select("seq", "body_resource_id")


def q_resource_relations(spark, d):
    p = cm.resource_relations(cm.parse_commands(_commands(spark, d)))
    return p.select("seq", cm.flatten_resources(F.col("relations"), with_flag=True).alias("relations"), "created_id")


def q_creation_commands(spark, d):
    return cm.creation_commands(cm.resource_relations(cm.parse_commands(_commands(spark, d)))).select(
        "seq", "created_id"
    )


def q_reject_unaddressed(spark, d):
    return cm.reject_unaddressed(cm.prepare_commands(_commands(spark, d))).select("seq", "url")


def q_shape_requests(spark, d):
    return _cmds(spark, d).select(
        "request_id", F.col("method").alias("http_method"), "uri", "request_body", "reason"
    )


def q_response_payloads(spark, d):
    r = jobs.responses(_commands(spark, d), fx.ari_results(spark, d))
    return r.select(
        "request_id",
        F.col("payload.status_code").alias("status_code"),
        F.to_json(F.col("payload.body")).alias("body_json"),
        "response_reason",
    )


def q_response_envelopes(spark, d):
    r = jobs.responses(_commands(spark, d), fx.ari_results(spark, d)).filter(F.col("response_reason").isNull())
    env = cm.response_envelopes(r, jobs.COMMANDS_TOPIC)
    return env.select(
        "request_id",
        F.col("envelope.type").alias("type"),
        F.col("envelope.callContext").alias("call_context"),
        F.col("envelope.payload.status_code").alias("status_code"),
        F.col("envelope.payload.body").isNotNull().alias("has_body"),
        cm.flatten_resources(F.col("envelope.resources")).alias("resources"),
        F.col("envelope.commandId").alias("command_id"),
        F.col("envelope.commandRequest.method").alias("method"),
        F.col("envelope.commandRequest.url").alias("url"),
        F.try_variant_get(F.try_parse_json("value"), "$.commandId", "string").alias("json_command_id"),
    )


def q_correlate_results(spark, d):
    cmds = _cmds(spark, d).filter(F.col("reason").isNull())
    return cm.correlate_results(cmds, fx.ari_results(spark, d)).select("request_id", "status_code", "is_error")


# --- state ---------------------------------------------------------------------


def q_context_registrations(spark, d):
    regs = cm.context_registrations(cm.prepare_commands(_commands(spark, d)))
    return regs.select("resource_id", "call_context", "ts", "seq")


def q_namespaced_key(spark, d):
    regs = cm.context_registrations(cm.prepare_commands(_commands(spark, d)))
    return regs.select("seq", "resource_id", namespaced_key(F.col("resource_id")).alias("state_key"))


def _explicit_writes(spark, d):
    """Prepared events and the writes named in events and commands, both stored: lookups and each layer read them again."""
    prepared = materialize(_prepared(spark, d).select("seq", "ts", "type", "resource_id", "channel_var", "reason"))
    regs = cm.context_registrations(cm.prepare_commands(_commands(spark, d)))
    return prepared, materialize(jobs.explicit_writes(prepared, regs))


def q_lookup_contexts(spark, d):
    prepared, writes = _explicit_writes(spark, d)
    lookups = st.event_ops(prepared.filter(F.col("reason").isNull())).filter(F.col("k") == "lookup")
    res = st.lookup_contexts(
        lookups.select("rid", "ts", "src", "seq"),
        writes.select(F.col("resource_id").alias("rid"), "ts", "src", "seq", F.col("call_context").alias("ctx")),
    )
    return res.select("rid", "seq", "call_context")


def q_resolve_contexts(spark, d):
    data, _ = ev.split_control(ev.prepare_events(_events(spark, d)))
    regs = cm.context_registrations(cm.prepare_commands(_commands(spark, d)))
    ops = st.event_ops(data).unionByName(st.registration_ops(regs))
    return st.resolve_contexts(ops).select("rid", "src", "seq", "call_context")


def q_context_lookups(spark, d):
    """A4: what the router's own lookups found, by policy."""
    data, _ = ev.split_control(ev.prepare_events(_events(spark, d)))
    regs = cm.context_registrations(cm.prepare_commands(_commands(spark, d)))
    return mt.context_lookups(st.resolve_contexts(st.event_ops(data).unionByName(st.registration_ops(regs))))


def q_generated_context(spark, d):
    data, _ = ev.split_control(ev.prepare_events(_events(spark, d)))
    regs = cm.context_registrations(cm.prepare_commands(_commands(spark, d)))
    ops = st.event_ops(data).unionByName(st.registration_ops(regs))
    res = st.resolve_contexts(ops)
    return res.filter(F.col("written") & (F.col("k") == "create")).select("rid", "seq", "call_context")


def _state(spark, d):
    regs = cm.context_registrations(cm.prepare_commands(_commands(spark, d)))
    return st.upsert_latest(None, jobs.explicit_writes(_prepared(spark, d), regs))


def q_upsert_latest(spark, d):
    return _state(spark, d)


def q_expire_state(spark, d):
    now = fx.table(spark, d, "events").agg(F.max("ts")).collect()[0][0]
    return st.expire_state(_state(spark, d), now)


def q_lookup_state(spark, d):
    prepared, writes = _explicit_writes(spark, d)
    keys = prepared.filter(F.col("reason").isNull() & F.col("resource_id").isNotNull()).select("seq", "resource_id")
    return st.lookup_state(keys, st.upsert_latest(None, writes)).select("seq", "resource_id", "call_context")


def q_lookup_layered(spark, d):
    prepared, writes = _explicit_writes(spark, d)
    split = st.ntz_lit(LAYER_SPLIT)
    base = st.upsert_latest(None, writes.filter(F.col("ts") < split))
    recent = st.upsert_latest(None, writes.filter(F.col("ts") >= split))
    keys = prepared.filter(F.col("reason").isNull() & F.col("resource_id").isNotNull()).select("seq", "resource_id")
    return st.lookup_layered(keys, recent, base).select("seq", "resource_id", "call_context", "layer")


def q_lookup_laid_out(spark, d):
    """J7/J8 on a stored state: both layers as one bucketed table, to which the keys are sent."""
    prepared, writes = _explicit_writes(spark, d)
    split = st.ntz_lit(LAYER_SPLIT)
    base, recent = (st.upsert_latest(None, writes.filter(side)) for side in (F.col("ts") < split, F.col("ts") >= split))
    path = scratch_path(spark, "layers")
    table = st.layers(base, recent, "layers_" + path.rsplit("-", 1)[1].replace("_", "u").lower(), f"{path}/table")
    keys = prepared.filter(F.col("reason").isNull() & F.col("resource_id").isNotNull()).select("seq", "resource_id")
    return st.lookup_laid_out(keys, table).select("seq", "resource_id", "call_context", "layer")


def q_missing_required(spark, d):
    """Resources that commands registered and no event ever named."""
    registered = cm.context_registrations(cm.prepare_commands(_commands(spark, d)))
    seen = ev.extract_resource_id(_events(spark, d)).where(F.col("resource_id").isNotNull())
    return mt.missing_required(registered.select(F.col("resource_id").alias("name")), seen.select(F.col("resource_id").alias("name")))


# --- metrics -------------------------------------------------------------------


def q_event_counts(spark, d):
    return mt.event_counts(ev.prepare_events(_events(spark, d)))


def _requests(spark, d):
    cmds = _cmds(spark, d).filter(F.col("reason").isNull())
    return cm.metric_path(cm.correlate_results(cmds, fx.ari_results(spark, d)))


def q_request_counts(spark, d):
    return mt.request_counts(_requests(spark, d))


def q_request_durations(spark, d):
    return mt.request_durations(_requests(spark, d))


def q_lookup_stats(spark, d):
    return mt.lookup_stats(q_lookup_layered(spark, d))


def q_write_durations(spark, d):
    regs = cm.context_registrations(cm.prepare_commands(_commands(spark, d)))
    return mt.write_durations(jobs.write_timings(regs, fx.ari_results(spark, d)))


def q_drop_counts(spark, d):
    # registrations and rejections are of the same commands: they are parsed once
    cmds = materialize(_cmds(spark, d).select("seq", "ts", "callContext", "created_id", "is_creation", "reason"))
    routed = ev.with_drop_reason(jobs.counted_events(_events(spark, d), cm.context_registrations(cmds)))
    return mt.drop_counts(jobs.dropped_messages(routed, cmds))


def q_merge_reports(spark, d):
    return mt.merge_reports(fx.probe_log(spark, d), ["service"])


def q_availability(spark, d):
    return mt.availability(fx.probe_log(spark, d))


def q_with_common_tags(spark, d):
    return mt.with_common_tags(q_request_counts(spark, d), COMMON_TAGS)


# --- composed jobs -----------------------------------------------------------


def q_route_events(spark, d):
    out = jobs.route_events(_events(spark, d), _commands(spark, d))
    return io.with_key_sequence(out).select("seq", "key", "type", "resource_type", "resource_id", "key_seq")


def q_route_responses(spark, d):
    out = jobs.route_responses(_commands(spark, d), fx.ari_results(spark, d))
    return io.with_key_sequence(out).select(
        "request_id",
        "key",
        "status_code",
        cm.flatten_resources(F.col("relations")).alias("resources"),
        F.col("commandId").alias("command_id"),
        "key_seq",
    )


def q_service_metrics(spark, d):
    return jobs.service_metrics(
        _events(spark, d), _commands(spark, d), fx.ari_results(spark, d), fx.probe_log(spark, d), COMMON_TAGS,
        LAYER_SPLIT,
    )


# --- streaming (T1-T5): the router query fed with the table in time order ---

STREAM_CHUNKS = 3
REPLAY_TIMEOUT = "48 hours"  # results arrive 36 hours after their request


def _stream_run(spark, d, chunks=STREAM_CHUNKS, stop_at_control=False, answers=False):
    """The tables replayed through the router; ``answers``: the answering query too."""
    from callroute.streaming import stream as sm

    paths = sm.new_paths(spark, "router")
    results = fx.ari_result_messages(spark, d) if answers else None
    sm.feed_in_chunks(
        spark, _events(spark, d), _commands(spark, d), paths, results,
        chunks=chunks, stop_at_control=stop_at_control, result_timeout=REPLAY_TIMEOUT,
    )
    return paths


def q_stream_route_events(spark, d):
    from callroute.streaming import stream as sm

    out = sm.read_output(spark, _stream_run(spark, d).events_out)
    return io.with_key_sequence(out).select("seq", "key", "type", "resource_type", "resource_id", "key_seq")


def q_stream_commands_to_requests(spark, d):
    from callroute.streaming import stream as sm

    out = sm.read_output(spark, _stream_run(spark, d, answers=True).responses_out)
    return io.with_key_sequence(out).select(
        "request_id", "key", "status_code", "resources", F.col("commandId").alias("command_id"), "key_seq"
    )


def q_stream_requests(spark, d):
    """T2, first half: the HTTP requests that the router issues."""
    from callroute.streaming import stream as sm

    out = sm.read_output(spark, _stream_run(spark, d).requests_out)
    return out.select("request_id", F.col("callContext").alias("call_context"), "method", "uri", F.col("request_body").alias("body"))


def q_stream_quarantine(spark, d):
    """T4: every message that the router could not route, counted by reason."""
    from callroute.streaming import stream as sm

    return mt.drop_counts(sm.read_output(spark, _stream_run(spark, d, answers=True).quarantine_out))


def q_quarantined_messages(spark, d):
    """P8 of both batch jobs: every message that is not routed, with its reason."""
    out = jobs.quarantined(_events(spark, d), _commands(spark, d), fx.ari_results(spark, d))
    return out.select("processor", "reason", "seq", "raw")


def q_tap_counts(spark, d):
    from callroute.streaming import stream as sm

    return sm.tap_counts(spark, _stream_run(spark, d))


def q_stop_on_control(spark, d):
    from callroute.streaming import stream as sm

    paths = _stream_run(spark, d, stop_at_control=True)
    return sm.read_output(spark, paths.events_out).select("seq", "key", "type")


def q_report_errors(spark, d):
    """The merged error list as rows."""
    return mt.report_errors(fx.probe_log(spark, d), ["service"])


QUERIES = {
    "read_events": q_read_events,
    "read_commands": q_read_commands,
    "read_event_lines": q_read_event_lines,
    "stream_events": q_stream_events,
    "write_keyed": q_write_keyed,
    "order_by_key": q_order_by_key,
    "message_types": q_message_types,
    "routes": q_routes,
    "parse_messages": q_parse_messages,
    "text_at": q_text_at,
    "classify_events": q_classify_events,
    "extract_resource_id": q_extract_resource_id,
    "channel_var_context": q_channel_var_context,
    "context_policy": q_context_policy,
    "split_control": q_split_control,
    "quarantine": q_quarantine,
    "parse_commands": q_parse_commands,
    "command_path": q_command_path,
    "classify_commands": q_classify_commands,
    "metric_path": q_metric_path,
    "path_resources": q_path_resources,
    "body_resource_id": q_body_resource_id,
    "resource_relations": q_resource_relations,
    "creation_commands": q_creation_commands,
    "reject_unaddressed": q_reject_unaddressed,
    "shape_requests": q_shape_requests,
    "event_envelopes": q_event_envelopes,
    "response_payloads": q_response_payloads,
    "response_envelopes": q_response_envelopes,
    "namespaced_key": q_namespaced_key,
    "context_registrations": q_context_registrations,
    "lookup_contexts": q_lookup_contexts,
    "resolve_contexts": q_resolve_contexts,
    "generated_context": q_generated_context,
    "upsert_latest": q_upsert_latest,
    "expire_state": q_expire_state,
    "lookup_state": q_lookup_state,
    "lookup_layered": q_lookup_layered,
    "lookup_laid_out": q_lookup_laid_out,
    "correlate_results": q_correlate_results,
    "missing_required": q_missing_required,
    "event_counts": q_event_counts,
    "request_counts": q_request_counts,
    "request_durations": q_request_durations,
    "lookup_stats": q_lookup_stats,
    "write_durations": q_write_durations,
    "context_lookups": q_context_lookups,
    "drop_counts": q_drop_counts,
    "merge_reports": q_merge_reports,
    "availability": q_availability,
    "with_common_tags": q_with_common_tags,
    "route_events": q_route_events,
    "route_responses": q_route_responses,
    "service_metrics": q_service_metrics,
    "stream_route_events": q_stream_route_events,
    "stream_commands_to_requests": q_stream_commands_to_requests,
    "tap_counts": q_tap_counts,
    "stop_on_control": q_stop_on_control,
    "stream_requests": q_stream_requests,
    "stream_quarantine": q_stream_quarantine,
    "quarantined_messages": q_quarantined_messages,
    "report_errors": q_report_errors,
}

__all__ = ["QUERIES"]
