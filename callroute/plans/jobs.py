"""Q1-Q3: the user entry points, composed from the operators.

Q1 ``route_events``: raw events (+ raw commands for the registrations) ->
   keyed event envelopes, ordered per call context.
Q2 ``route_responses``: raw commands + HTTP results -> keyed response envelopes.
Q3 ``service_metrics``: all measurements as ``metric, tags, value`` rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callroute.operators import commands as cm
from callroute.operators import events as ev
from callroute.operators import metrics as mt
from callroute.operators import state as st
from callroute.session import materialize
from callroute.sources.dims import METRIC_PREFIX
from callroute.sources.io import order_by_key

COMMANDS_TOPIC = "commands"
EVENTS_TOPIC = "events-and-responses"
_HISTOGRAM = {f".{c}": c for c in ["count", "sum", "max", *mt.QUANTILES, *(f"le_{b}" for b in mt.DURATION_BUCKETS_MS)]}
BASE_URI = "http://localhost:8088/ari"


def routed_events(events_raw: DataFrame, commands_raw: DataFrame, ttl=st.DEFAULT_TTL, unaddressed: bool = True) -> DataFrame:
    """Parsed events (control messages removed) with their resolved ``call_context``; ``unaddressed``: those without a resource id too."""
    prepared = ev.prepare_events(events_raw)
    data, _control = ev.split_control(prepared)
    return attach_contexts(data, cm.context_registrations(cm.prepare_commands(commands_raw)), ttl, unaddressed)


#: what the counts of dropped events read of a prepared event
COUNTED = ["seq", "ts", "malformed", "has_type", "type", "id_path", "resource_id", "channel_var"]


def counted_events(events_raw: DataFrame, registrations: DataFrame, ttl=st.DEFAULT_TTL) -> DataFrame:
    """``routed_events`` for counts: without the messages, which are parsed once and not carried along."""
    data, _control = ev.split_control(ev.prepare_events(events_raw))
    # the fold, its last step and the events without a resource id each read them
    return attach_contexts(materialize(data.select(*COUNTED)), registrations, ttl)


def attach_contexts(data: DataFrame, regs: DataFrame, ttl=st.DEFAULT_TTL, unaddressed: bool = True) -> DataFrame:
    """J3 for prepared events: adds ``call_context`` and ``context_written``.

    The events' columns go with their op through the last step of the fold, so
    they are exchanged once, by (id, bucket, slice), and never joined back.
    """
    done = st.fold(st.event_ops(data).unionByName(st.registration_ops(regs)), ttl)
    carried = {c: f"event_{c}" for c in data.columns}
    rows = st.with_bucket(st.event_ops(data, carried), done.width)
    registered = done.ops.filter(F.col("src") != 1)
    resolved = done.resolve(rows.unionByName(registered, allowMissingColumns=True)).filter(F.col("src") == 1)
    named = resolved.select(*(F.col(n).alias(c) for c, n in carried.items()), "call_context", F.col("written").alias("context_written"))
    if not unaddressed:
        return named
    rest = data.filter(F.col("resource_id").isNull())
    return named.unionByName(rest.withColumns({"call_context": F.lit(None).cast("string"), "context_written": F.lit(False)}))


def route_events(
    events_raw: DataFrame,
    commands_raw: DataFrame,
    ttl=st.DEFAULT_TTL,
    commands_topic: str = COMMANDS_TOPIC,
    events_topic: str = EVENTS_TOPIC,
) -> DataFrame:
    """Q1: S1 -> P1 P3-P6 -> P7 -> J1 + J3 -> P8 -> P19 -> S5.

    Output: ``topic, key, value, ts, src, seq, type, resource_type, resource_id``,
    hash-partitioned by ``key`` and sorted within partitions.
    """
    good, _bad = ev.quarantine(routed_events(events_raw, commands_raw, ttl, unaddressed=False))
    env = ev.event_envelopes(good, commands_topic)
    out = env.select(
        F.lit(events_topic).alias("topic"),
        F.col("call_context").alias("key"),
        "value",
        "ts",
        F.lit(1).alias("src"),
        "seq",
        "type",
        "resource_type",
        "resource_id",
    )
    return order_by_key(out)


def quarantined(events_raw: DataFrame, commands_raw: DataFrame, results: DataFrame, ttl=st.DEFAULT_TTL, base_uri: str = BASE_URI) -> DataFrame:
    """P8 of Q1 and Q2: ``processor, reason, seq, ts, raw`` of every message that gets no record."""
    columns = ["seq", "ts", "raw"]
    _good, bad = ev.quarantine(routed_events(events_raw, commands_raw, ttl))
    cmds = cm.shape_requests(cm.prepare_commands(commands_raw), base_uri)
    rejected = cmds.filter(F.col("reason").isNotNull())
    odd = responses(commands_raw, results, base_uri).filter(F.col("response_reason").isNotNull())
    side = lambda df, processor, reason: df.select(F.lit(processor).alias("processor"), F.col(reason).alias("reason"), *columns)
    return side(bad, "event", "reason").unionByName(side(rejected, "commandResponse", "reason")).unionByName(side(odd, "commandResponse", "response_reason"))


def responses(commands_raw: DataFrame, results: DataFrame, base_uri: str = BASE_URI) -> DataFrame:
    """Accepted commands with request, result and response payload."""
    cmds = cm.shape_requests(cm.prepare_commands(commands_raw), base_uri)
    accepted = cmds.filter(F.col("reason").isNull())
    return cm.response_payloads(cm.correlate_results(accepted, results))


def route_responses(
    commands_raw: DataFrame,
    results: DataFrame,
    base_uri: str = BASE_URI,
    commands_topic: str = COMMANDS_TOPIC,
    events_topic: str = EVENTS_TOPIC,
) -> DataFrame:
    """Q2: S3 -> P9-P18 -> J9 -> P20 -> P21 -> S5."""
    pay = responses(commands_raw, results, base_uri).filter(F.col("response_reason").isNull())
    env = cm.response_envelopes(pay, commands_topic)
    out = env.select(
        F.lit(events_topic).alias("topic"),
        F.col("callContext").alias("key"),
        "value",
        "ts",
        F.lit(0).alias("src"),
        "seq",
        "request_id",
        "status_code",
        "commandId",
        "relations",
    )
    return order_by_key(out)


def service_metrics(
    events_raw: DataFrame,
    commands_raw: DataFrame,
    results: DataFrame,
    probes: DataFrame,
    tags: dict[str, str] | None = None,
    layer_split: datetime = datetime(2024, 1, 15),
) -> DataFrame:
    """Q3: A1 + A2 + A3 + A4 + A5 + A6 + A8 (+ A9 tags) as ``metric, tags, value``."""
    # every measurement reads these two projections: compute each once
    prepared = materialize(
        ev.with_drop_reason(ev.prepare_events(events_raw)).select(
            "seq", "ts", "type", "resource_type", "resource_id", "channel_var", "reason"
        )
    )
    cmds = materialize(
        cm.shape_requests(cm.prepare_commands(commands_raw), BASE_URI).select(
            "seq", "ts", "request_id", "method", "url", "callContext", "created_id", "is_creation", "reason"
        )
    )
    requests = cm.metric_path(cm.correlate_results(cmds.filter(F.col("reason").isNull()), results))
    regs = cm.context_registrations(cmds)
    counts = mt.event_counts(prepared).withColumnsRenamed({"type": "eventType", "resource_type": "resourceType"})
    parts = [
        mt.as_long(counts, f"{METRIC_PREFIX}.events", ["eventType", "resourceType"], {"": "n"}),
    ]
    rc = mt.request_counts(requests)
    parts.append(mt.as_long(rc, f"{METRIC_PREFIX}.outgoing.requests", ["method", "path"], {"": "requests", ".errors": "errors"}))
    rd = mt.request_durations(requests)
    parts.append(
        mt.as_long(
            rd,
            f"{METRIC_PREFIX}.outgoing.requests.duration",
            ["method", "path"],
            _HISTOGRAM,
        )
    )
    writes = explicit_writes(prepared, regs)
    split = st.ntz_lit(layer_split)
    base = st.upsert_latest(None, writes.filter(F.col("ts") < split))
    recent = st.upsert_latest(None, writes.filter(F.col("ts") >= split))
    keys = prepared.filter(F.col("resource_id").isNotNull() & F.col("reason").isNull()).select(
        F.col("resource_id")
    )
    ls = mt.lookup_stats(st.lookup_layered(keys, recent, base))
    parts.append(
        mt.as_long(
            ls,
            f"{METRIC_PREFIX}.cache.read",
            [],
            {".attempts": "attempts", ".misses": "misses", ".recent_hits": "recent_hits", ".base_hits": "base_hits"},
        )
    )
    wd = mt.write_durations(write_timings(regs, results))
    parts.append(
        mt.as_long(wd, f"{METRIC_PREFIX}.persistence.write.duration", [], _HISTOGRAM)
    )
    routed = attach_contexts(ev.split_control(prepared)[0], regs)
    no_context = F.when(F.col("resource_id").isNotNull() & F.col("call_context").isNull(), F.lit("no_context"))
    routed = routed.withColumn("reason", F.coalesce("reason", no_context))
    drops = mt.drop_counts(dropped_messages(routed, cmds))
    parts.append(mt.as_long(drops, f"{METRIC_PREFIX}.processor.drops", ["processor", "reason"], {"": "n"}))
    av = mt.availability(probes).withColumnRenamed("service", "backing_service")
    parts.append(mt.as_long(av, f"{METRIC_PREFIX}.backing_service.availability", ["backing_service"], {"": "value"}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return mt.with_common_tags(out, tags or {})


def explicit_writes(prepared_events: DataFrame, registrations: DataFrame) -> DataFrame:
    """State writes named in the input: registrations and StasisStart channel variables."""
    var_puts = prepared_events.filter(
        (F.col("type") == ev.CREATE_TYPE) & F.col("channel_var").isNotNull() & F.col("resource_id").isNotNull()
    ).select(
        "resource_id",
        F.col("channel_var").alias("call_context"),
        "ts",
        F.lit(1).alias("src"),
        "seq",
    )
    return registrations.select("resource_id", "call_context", "ts", "src", "seq").unionByName(var_puts)


def write_timings(registrations: DataFrame, results: DataFrame) -> DataFrame:
    """State writes of registrations with the duration of their request."""
    return registrations.join(
        results.select("request_id", "duration_ms"), "request_id", "inner"
    )


def dropped_messages(prepared_events: DataFrame, commands: DataFrame) -> DataFrame:
    """Dropped rows of both processors: ``processor, reason``."""
    e = prepared_events.filter(F.col("reason").isNotNull()).select(
        F.lit("event").alias("processor"), "reason"
    )
    c = commands.filter(F.col("reason").isNotNull()).select(F.lit("commandResponse").alias("processor"), "reason")
    return e.unionByName(c)
