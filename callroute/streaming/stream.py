"""The router as two Structured Streaming queries.

**Routing** (T1, T3-T5) reads events and commands as one stream
(``unionByName``), so the state has a single writer. A micro-batch

1. looks up the stored entries of its own ids (``KeyedState``: only their
   buckets are read); they re-enter the fold as writes at their ``written_at``;
2. resolves contexts (J3) and writes event envelopes (T1), requests, event
   counts before any drop (T3) and quarantined rows with their reason (T4);
3. stores its writes as runs of the state, and the version that names them
   last: a repeated batch whose version is there does nothing, any other
   writes the same folders again.

Time: the clock of a batch is the median time stamp of its rows. It never goes
back and moves on by at most ``max_step`` a batch, so a few rows dated in the
future can't expire anything. State is kept for ``ttl + lateness`` by that
clock. An op older than the stored write of its id is late: it reads the stored
context where its own time has none, never creates one, and its record says
``late``.

T5, ``stop_at_control``: a batch that holds a control message (ApplicationReplaced)
is routed up to it, its version stores the cut, and the query ends before Spark
commits the batch's offsets. A new start gets the same batch again, goes on
after the cut, and loses nothing.

**Answering** (T2) joins commands and results as two streams: a full outer
interval join on the request with watermarks on both sides. A request fails when the watermark passes its
time stamp by ``result_timeout``; a result that no request claims is
quarantined. ``ticks`` (time stamps, as of ``heartbeat``) move both watermarks
on while no message comes. Of several results of a request the earliest of the
first batch counts, the rest are quarantined. Rows that come later than
``lateness`` behind the watermark are dropped by the join, which only counts
them (``Router.late_rows``); ``quarantine_late`` finds them in the inputs.

Records go to tables below ``paths``; with ``sinks`` they are then published
to a keyed topic, each once (``sources.sink``).
"""

from __future__ import annotations

import json
import os
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from callroute.operators import commands as cm
from callroute.operators import events as ev
from callroute.operators import metrics as mt
from callroute.operators import state as st
from callroute.plans import jobs
from callroute.session import checkpoint_dir
from callroute.sources import io
from callroute.sources.files import Folder
from callroute.sources.sink import KeyedSink
from callroute.streaming.keyed_state import KeyedState, Version

LATENESS = "1 hour"
MAX_STEP = "1 hour"
RESULT_TIMEOUT = "10 minutes"
CONTROL_REACHED = "control message reached"
PARTITIONS = "spark.sql.shuffle.partitions"
#: what a batch reads of its prepared commands
COMMAND_COLUMNS = ["seq", "ts", "request_id", "raw", "callContext", "method", "uri", "request_body", "created_id", "is_creation", "reason"]
PARTITION_ROWS = 50_000  # of a replay's rows that one partition of its queries takes
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: The answering query's state lies on the executors' disks, with bounded memory: Spark's default store is a map in memory of
#: all waiting commands and results. One store per partition (format 3) instead of four, open only while a task works on it,
#: so memory follows the running tasks, not partitions or starts.
STATE_STORE = {
    STATE_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}
_EPOCH = datetime(1970, 1, 1)


@dataclass
class RouterPaths:
    """Folders of one router deployment (all in shared storage)."""

    root: str
    state: str = field(init=False)
    answered: str = field(init=False)
    joined: str = field(init=False)
    events_out: str = field(init=False)
    requests_out: str = field(init=False)
    responses_out: str = field(init=False)
    counts_out: str = field(init=False)
    quarantine_out: str = field(init=False)
    control_out: str = field(init=False)
    measured: str = field(init=False)
    checkpoint: str = field(init=False)
    answers_checkpoint: str = field(init=False)

    def __post_init__(self):
        r = self.root.rstrip("/")
        self.state = f"{r}/state"
        self.answered = f"{r}/answered"
        self.joined = f"{r}/joined"
        self.events_out = f"{r}/out/events"
        self.requests_out = f"{r}/out/requests"
        self.responses_out = f"{r}/out/responses"
        self.counts_out = f"{r}/out/counts"
        self.quarantine_out = f"{r}/out/quarantine"
        self.control_out = f"{r}/out/control"
        self.measured = f"{r}/measured"
        self.checkpoint = f"{r}/checkpoint"
        self.answers_checkpoint = f"{r}/answers-checkpoint"


@dataclass
class Sinks:
    """Keyed topics of the router; None: tables only."""

    events: KeyedSink | None = None
    responses: KeyedSink | None = None


class ControlReached(Exception):
    """Ends the routing query at a control message, before its batch's offsets are committed."""


def _micros(at: datetime) -> int:
    return (at - _EPOCH) // timedelta(microseconds=1)


def _save(df: DataFrame, path: str, batch_id: int, part: int = 0) -> str:
    folder = f"{path}/batch={batch_id}/part={part}"
    df.write.mode("overwrite").parquet(folder)
    return folder


def load_state(spark: SparkSession, paths: RouterPaths, version: Version | None = None) -> DataFrame:
    """The call contexts as of a version (the newest, if not named)."""
    return KeyedState(spark, paths.state).snapshot(version).select("resource_id", "call_context", "written_at")


def next_clock(previous: datetime | None, median: datetime | None, max_step=MAX_STEP) -> datetime | None:
    """The batch's clock: its median time stamp, monotone and at most ``max_step`` ahead of the last."""
    if previous is None or median is None:
        return previous or median
    return max(previous, min(median, previous + timedelta(microseconds=st.ttl_micros(max_step))))


def survey(events: DataFrame, commands: DataFrame) -> Row:
    """What a batch holds, in one pass and one row: ``middle``, the median time stamp in microseconds; ``control``, the first
    control message (``ts``, ``seq``); ``counts``, the events of each message type (T3).

    ``events`` as of ``prepare_events``: any type that is not known counts as UNKNOWN, so the row's width is fixed.
    """
    rows = events.select("type", "ts", "seq").unionByName(commands.select(F.lit(None).cast("string").alias("type"), "ts", "seq"))
    return rows.agg(
        F.percentile_approx(st.micros(F.col("ts")), 0.5).alias("middle"),
        F.min(F.when(F.col("type") == ev.CONTROL_TYPE, F.struct("ts", "seq"))).alias("control"),
        F.struct(*(F.count_if(F.col("type") == t).alias(t) for t in mt.TYPES)).alias("counts"),
    ).first()


def batch_clock(middle: int | None, previous: int | None, max_step=MAX_STEP) -> int | None:
    """The clock after a batch of that median time stamp, in microseconds."""
    at = lambda x: None if x is None else _EPOCH + timedelta(microseconds=x)
    clock = next_clock(at(previous), at(middle), max_step)
    return None if clock is None else _micros(clock)


def resolve_with_state(ops: DataFrame, state: DataFrame, ttl=st.DEFAULT_TTL) -> DataFrame:
    """J3 over the ops of a batch and the stored state of their ids.

    Adds ``late``: the op is older than the stored write. A late op that finds
    no context of its own time gets the stored one; a late create is a lookup.
    """
    marks = state.select(F.col("resource_id").alias("rid"), "call_context", "written_at")
    known = ops.join(marks, "rid", "left").withColumn("late", F.coalesce(F.col("ts") < F.col("written_at"), F.lit(False)))
    fold = known.withColumn("k", F.when(F.col("late") & (F.col("k") == "create"), F.lit("lookup")).otherwise(F.col("k")))
    resolved = st.resolve_contexts(fold.select(*ops.columns).unionByName(st.state_ops(state)), ttl).filter("src >= 0")
    resolved = resolved.join(marks.withColumnRenamed("call_context", "_stored"), "rid", "left")
    late = F.coalesce(F.col("ts") < F.col("written_at"), F.lit(False))
    return resolved.select(
        "rid", "ts", "src", "seq", "k", "written", late.alias("late"),
        F.coalesce("call_context", F.when(late, F.col("_stored"))).alias("call_context"),
    )


def _quarantined(df: DataFrame, processor: str, reason: str = "reason") -> DataFrame:
    return df.select(F.lit(processor).alias("processor"), F.col(reason).alias("reason"), "seq", "ts", "raw")


def _publish(sink: KeyedSink | None, spark: SparkSession, folder: str, name: str, batch_id: int, part: int = 0) -> None:
    """Send the stored records of a batch on; repeated, it sends what is missing."""
    if sink is not None:
        outbox = spark.read.parquet(folder).withColumn("record_id", F.concat_ws("-", F.lit(name), F.col("seq")))
        sink.publish(outbox, f"{name}-{batch_id}-{part}")


MEASURED = "batch bigint, part bigint, lookups bigint, misses bigint, created bigint, written bigint, rows_read bigint, duration_ms double, error string"


def _measure(spark: SparkSession, paths: RouterPaths, batch_id: int, part: int, **values) -> None:
    """A4, A5 of the router: one small file per batch, or per failure of one."""
    name = f"m-{batch_id:012d}-{part:04d}" + (f"-error-{uuid.uuid4().hex}" if values.get("error") else "")
    Folder(spark, paths.measured).write(f"{name}.json", json.dumps({"batch": batch_id, "part": part, **values}))


def measurements(spark: SparkSession, paths: RouterPaths) -> DataFrame:
    """What the routing query measured, a row per batch: lookups of call contexts, those that found none, contexts created, entries
    written, stored rows in the files read, how long the state's write took; and a row with ``error`` per failed attempt."""
    if not Folder(spark, paths.measured).names():
        return spark.createDataFrame([], MEASURED)
    return spark.read.schema(MEASURED).json(paths.measured)


def process_batch(batch: DataFrame, batch_id: int, paths: RouterPaths, **options) -> bool:
    """``route_batch``, and a measurement if it fails: the batch comes again, and the failure stays on record."""
    try:
        return route_batch(batch, batch_id, paths, **options)
    except Exception as failed:
        _measure(batch.sparkSession, paths, batch_id, 0, error=f"{type(failed).__name__}: {str(failed)[:300]}")
        raise


def route_batch(
    batch: DataFrame,
    batch_id: int,
    paths: RouterPaths,
    ttl=st.DEFAULT_TTL,
    base_uri: str = jobs.BASE_URI,
    commands_topic: str = jobs.COMMANDS_TOPIC,
    events_topic: str = jobs.EVENTS_TOPIC,
    stop_at_control: bool = False,
    resume: bool = False,
    lateness=LATENESS,
    max_step=MAX_STEP,
    sinks: Sinks | None = None,
) -> bool:
    """The body of the routing query's ``foreachBatch`` (T1, T3-T5); whether the whole batch is routed.

    ``stop_at_control``: rows after the first control message, by ``(ts, src,
    seq)``, wait; the batch is not whole, and no later one is begun.
    ``resume``: such a batch goes on after its cut, to the next control
    message or its end.
    """
    spark = batch.sparkSession
    sinks = sinks or Sinks()
    state = KeyedState(spark, paths.state)
    last = state.latest()
    here = F.struct("ts", "src", "seq")
    point = lambda cut: F.struct(st.ntz_lit(_EPOCH + timedelta(microseconds=cut[0])).alias("ts"), F.lit(1).alias("src"), F.lit(cut[1]).alias("seq"))
    part, since = 0, None
    if last.batch >= batch_id and not (last.batch == batch_id and last.cut and resume):
        return last.cut is None  # it is done, or stopped at its cut
    if last.cut:
        if last.batch < batch_id:
            return False
        part, since = last.part + 1, last.cut
    batch = batch.filter(F.col("src") < 2)
    if since:
        batch = batch.filter(here > point(since))
    batch = batch.persist()
    # the parsed values are not kept: envelopes take the message's own text
    kept = prepared = ev.prepare_events(batch.filter(F.col("src") == 1).select("seq", "ts", "raw")).drop("msg").persist()
    sent = batch.filter(F.col("src") == 0).select("seq", "ts", "request_id", "raw")
    seen = survey(prepared, sent)
    first = seen.control
    cut = (_micros(first.ts), first.seq) if stop_at_control and first is not None else None
    if cut:
        until = lambda df, src: df.filter(F.struct("ts", F.lit(src).alias("src"), "seq") <= point(cut))
        prepared, sent = until(prepared, 1), until(sent, 0)
        seen = survey(prepared, sent)
    cmds = cm.shape_requests(cm.prepare_commands(sent), base_uri).select(*COMMAND_COLUMNS).persist()
    clock = batch_clock(seen.middle, last.clock, max_step)
    horizon = None if clock is None else clock - st.ttl_micros(ttl) - st.ttl_micros(lateness)

    # Counts before any drop
    _save(mt.counts_by_type(spark, seen.counts.asDict()).withColumn("batch_id", F.lit(batch_id)), paths.counts_out, batch_id, part)
    data, control = ev.split_control(prepared)
    ops = st.event_ops(data).unionByName(st.registration_ops(cm.context_registrations(cmds))).persist()
    expired = None if last.clock is None else last.clock - st.ttl_micros(ttl) - st.ttl_micros(lateness)
    ids = ops.select(F.col("rid").alias("resource_id"))
    stored = state.entries(last, ids, expired)
    resolved = resolve_with_state(ops, stored, ttl).persist()

    # Event envelopes
    ev_ctx = resolved.filter(F.col("src") == 1).select("seq", F.col("rid").alias("resource_id"), "call_context", "late")
    good, bad_events = ev.quarantine(data.join(ev_ctx, ["seq", "resource_id"], "left"))
    env = ev.event_envelopes(good, commands_topic).select(
        F.lit(events_topic).alias("topic"),
        F.col("call_context").alias("key"),
        "value",
        "ts",
        F.lit(1).alias("src"),
        "seq",
        "type",
        "resource_type",
        "resource_id",
        "late",
    )
    outbox = _save(io.order_by_key(env), paths.events_out, batch_id, part)
    _publish(sinks.events, spark, outbox, "event", batch_id, part)

    # T2, first half: the requests
    accepted = cmds.filter(F.col("reason").isNull())
    requests = accepted.select("request_id", "ts", "callContext", "method", "uri", "request_body")
    _save(requests, paths.requests_out, batch_id, part)

    # T4: what was not routed, with its reason
    quarantine = _quarantined(bad_events, "event").unionByName(_quarantined(cmds.filter(F.col("reason").isNotNull()), "commandResponse"))
    _save(quarantine, paths.quarantine_out, batch_id, part)
    if first is not None:
        _save(control.select("seq", "ts", "raw"), paths.control_out, batch_id, part)

    # the latest write per id becomes a run of the state; the version that names it ends the batch
    writes = resolved.filter(F.col("written")).select(
        F.col("rid").alias("resource_id"), "call_context", "ts", "src", "seq"
    )
    found = resolved.agg(
        F.count_if(F.col("k") != "put").alias("lookups"),
        F.count_if((F.col("k") != "put") & (F.col("call_context").isNull() | F.col("written"))).alias("misses"),
        F.count_if((F.col("k") != "put") & F.col("written")).alias("created"),
    ).first()
    began = time.perf_counter()
    version = state.commit(last, batch_id, part, st.upsert_latest(None, writes), clock, horizon, cut)
    took = (time.perf_counter() - began) * 1000
    number = (batch_id << 16) + part
    written = sum(run[2] for runs in version.runs.values() for run in runs if run[1] == number)
    _measure(spark, paths, batch_id, part, **found.asDict(), written=written, rows_read=last.rows(state.touched(ids)), duration_ms=took)
    for cached in (resolved, ops, cmds, kept, batch):
        cached.unpersist()
    return cut is None


# ---------------------------------------------------------------------------
# Requests and their results


def heartbeat(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """Time stamps of the wall clock: what moves the watermarks on in a quiet system."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.col("timestamp").cast("timestamp_ntz").alias("ts"))


def answer_stream(
    commands: DataFrame,
    results: DataFrame,
    ticks: DataFrame | None = None,
    base_uri: str = jobs.BASE_URI,
    result_timeout=RESULT_TIMEOUT,
    lateness=LATENESS,
) -> DataFrame:
    """Accepted commands with their result (columns ``r_...``, null where it did not come in time), and results without a command.

    A result may be ``lateness`` older than its command, and at most ``result_timeout`` younger.
    """
    micros = st.ttl_micros(lateness)
    delay = f"{micros} microseconds"
    none = lambda kind: F.lit(None).cast(kind)
    accepted = cm.shape_requests(cm.prepare_commands(commands), base_uri).filter(F.col("reason").isNull())
    left = accepted.select(F.col("ts").cast("timestamp").alias("c_at"), "request_id", "seq", "ts", "raw")
    right = results.select(F.col("ts").cast("timestamp").alias("r_at"), *(F.col(c).alias(f"r_{c}") for c in io.RESULT_COLUMNS))
    if ticks is not None:
        at = ticks.select(F.col("ts").cast("timestamp").alias("at"))
        left = left.unionByName(at.select(F.col("at").alias("c_at"), *(none(f.dataType).alias(f.name) for f in left.schema.fields[1:])))
        right = right.unionByName(at.select(F.col("at").alias("r_at"), *(none(f.dataType).alias(f.name) for f in right.schema.fields[1:])))
    # ticks go once they have moved the watermark: an alternative on the event time keeps the filter above it
    never = F.lit("0001-01-01 00:00:00").cast("timestamp")
    left = left.withWatermark("c_at", delay).filter(F.col("request_id").isNotNull() | (F.col("c_at") < never))
    right = right.withWatermark("r_at", delay).filter(F.col("r_request_id").isNotNull() | (F.col("r_at") < never))
    within = (
        (F.col("request_id") == F.col("r_request_id"))
        & (F.col("r_at") >= F.col("c_at") - F.expr(f"interval {micros} microseconds"))
        & (F.col("r_at") <= F.col("c_at") + F.expr(f"interval {st.ttl_micros(result_timeout)} microseconds"))
    )
    return left.join(right, within, "fullOuter").drop("c_at", "r_at")


def _respond(answered: DataFrame, commands_topic: str, events_topic: str) -> tuple[DataFrame, DataFrame]:
    """(response records, rows whose result is no JSON)."""
    pay = cm.response_payloads(answered)
    env = cm.response_envelopes(pay.filter(F.col("response_reason").isNull()), commands_topic).select(
        F.lit(events_topic).alias("topic"),
        F.col("callContext").alias("key"),
        "value",
        "ts",
        F.lit(0).alias("src"),
        "seq",
        "request_id",
        "status_code",
        "commandId",
        cm.flatten_resources(F.col("relations")).alias("resources"),
    )
    return env, _quarantined(pay.filter(F.col("response_reason").isNotNull()), "commandResponse", "response_reason")


def process_answers(
    batch: DataFrame,
    batch_id: int,
    paths: RouterPaths,
    base_uri: str = jobs.BASE_URI,
    commands_topic: str = jobs.COMMANDS_TOPIC,
    events_topic: str = jobs.EVENTS_TOPIC,
    result_timeout=RESULT_TIMEOUT,
    lateness=LATENESS,
    sinks: Sinks | None = None,
) -> None:
    """The body of the answering query's ``foreachBatch``: response records, and results that answer nothing.

    Requests answered before are remembered (``KeyedState`` by request) for as
    long as the join may bring another result of theirs.
    """
    spark = batch.sparkSession
    sinks = sinks or Sinks()
    state = KeyedState(spark, paths.answered)
    last = state.latest()
    if last.batch >= batch_id:
        return
    batch = batch.persist()
    result = [c for c in io.RESULT_COLUMNS if c != "request_id"]
    joined = batch.filter(F.col("request_id").isNotNull())
    number = F.col("request_id").cast("string")
    known = state.entries(last, joined.select(number.alias("resource_id"))).select(F.col("resource_id").cast("bigint").alias("request_id"), F.lit(True).alias("known"))
    order = F.struct(F.col("r_ts").isNull(), "r_ts", "r_seq")
    first = joined.groupBy("request_id").agg(F.min(order).alias("at"), F.first("seq").alias("seq"), F.first("ts").alias("ts"), F.first("raw").alias("raw"), F.min_by(F.struct(*(F.col(f"r_{c}").alias(c) for c in result)), order).alias("r"))
    fresh = first.join(known, "request_id", "left_anti").persist()
    commands = cm.shape_requests(cm.prepare_commands(fresh.select("seq", "ts", "request_id", "raw")), base_uri)
    answered = cm.correlate_results(commands, fresh.select("request_id", "r.status", "r.result_body", "r.duration_ms"))
    env, bad_results = _respond(answered, commands_topic, events_topic)
    outbox = _save(io.order_by_key(env), paths.responses_out, batch_id)
    _publish(sinks.responses, spark, outbox, "response", batch_id)

    _save(fresh.select("request_id", F.col("r.seq").alias("r_seq"), F.col("r.ts").alias("r_ts")), paths.joined, batch_id)
    taken = fresh.select(F.col("request_id").alias("r_request_id"), F.col("r.seq").alias("r_seq"), F.col("r.ts").alias("r_ts"))
    lost = lambda df, reason: df.select(F.lit("commandResponse").alias("processor"), F.lit(reason).alias("reason"), F.col("r_seq").alias("seq"), F.col("r_ts").alias("ts"), F.col("r_result_body").alias("raw"))
    repeated = joined.filter(F.col("r_request_id").isNotNull()).join(taken, ["r_request_id", "r_seq", "r_ts"], "left_anti")
    unclaimed = batch.filter(F.col("request_id").isNull())
    _save(bad_results.unionByName(lost(repeated, "repeated_result")).unionByName(lost(unclaimed, "unclaimed_result")), f"{paths.quarantine_out}/answers", batch_id)

    latest = batch.agg(F.max(F.greatest("ts", "r_ts")).alias("at")).first().at
    clock = max((c for c in (last.clock, latest and _micros(latest)) if c is not None), default=None)
    horizon = None if clock is None else clock - 2 * (st.ttl_micros(result_timeout) + st.ttl_micros(lateness))
    state.commit(last, batch_id, 0, fresh.select(number.alias("resource_id"), F.lit("").alias("call_context"), F.col("ts").alias("written_at")), clock, horizon)
    for cached in (fresh, batch):
        cached.unpersist()


def _saved(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows below an output folder; none before its first batch."""
    if not Folder(spark, path).names():
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def late_messages(
    spark: SparkSession,
    paths: RouterPaths,
    commands: DataFrame,
    results: DataFrame,
    watermark: datetime,
    base_uri: str = jobs.BASE_URI,
    result_timeout=RESULT_TIMEOUT,
    lateness=LATENESS,
) -> DataFrame:
    """Rows of the inputs (as batch frames) that the answering query dropped, in the quarantine's columns.

    Those are accepted commands and results that ``watermark`` (``Router.watermark``)
    has left behind by all that the join may wait for, and that are in none of
    its outputs: ``late_command`` (its request went out, nothing answered it) and
    ``late_result``. A command whose request number was answered is none of them;
    a row without a time stamp is never late, a result without ``seq`` can't be
    told from others and is left out. Inputs bounded by time give the rows of that time.
    """
    reach = st.ttl_micros(result_timeout) + st.ttl_micros(lateness)
    gone = F.col("ts") < st.ntz_lit(watermark - timedelta(microseconds=reach))
    joined = _saved(spark, paths.joined, "request_id bigint, r_seq bigint, r_ts timestamp_ntz")
    refused = _saved(spark, f"{paths.quarantine_out}/answers", "reason string, seq bigint, ts timestamp_ntz").filter(F.col("reason").isin("repeated_result", "unclaimed_result"))
    accepted = cm.shape_requests(cm.prepare_commands(commands.filter(gone)), base_uri).filter(F.col("reason").isNull() & F.col("request_id").isNotNull())
    unanswered = accepted.join(joined.select("request_id"), "request_id", "left_anti")
    seen = joined.select(F.col("r_seq").alias("seq"), F.col("r_ts").alias("ts")).unionByName(refused.select("seq", "ts"))
    unseen = results.filter(gone & F.col("seq").isNotNull()).join(seen, ["seq", "ts"], "left_anti").withColumn("raw", F.col("result_body"))
    late = lambda df, reason: _quarantined(df.withColumn("reason", F.lit(reason)), "commandResponse")
    return late(unanswered, "late_command").unionByName(late(unseen, "late_result"))


def quarantine_late(spark: SparkSession, paths: RouterPaths, commands: DataFrame, results: DataFrame, watermark: datetime, **options) -> None:
    """Write ``late_messages`` of these inputs to the quarantine, in place of what an earlier call wrote there."""
    late_messages(spark, paths, commands, results, watermark, **options).write.mode("overwrite").parquet(f"{paths.quarantine_out}/late")


# ---------------------------------------------------------------------------
# the queries


def router_stream(events: DataFrame, commands: DataFrame) -> DataFrame:
    """One streaming frame of both inputs: ``src`` 0 = command, 1 = event."""
    e = events.select("seq", "ts", F.lit(None).cast("long").alias("request_id"), "raw", F.lit(1).alias("src"))
    return commands.select("seq", "ts", "request_id", "raw", F.lit(0).alias("src")).unionByName(e)


class Router:
    """The running queries of one router."""

    def __init__(self, queries: list):
        self.queries = queries

    @property
    def isActive(self) -> bool:  # noqa: N802 - as a streaming query has it
        return any(q.isActive for q in self.queries)

    def stop(self) -> None:
        for q in self.queries:
            q.stop()

    def late_rows(self) -> int:
        """Commands and results that came too late for the answering query's join, of the batches that Spark still reports."""
        return sum(s.numRowsDroppedByWatermark for q in self.queries[1:] for p in q.recentProgress for s in p.stateOperators)

    def watermark(self) -> datetime | None:
        """How far the answering query has come, as of its last batch that Spark reports; None before one."""
        marks = [p.eventTime["watermark"] for q in self.queries[1:] for p in q.recentProgress if "watermark" in p.eventTime]
        return max((datetime.fromisoformat(m.replace("Z", "+00:00")).replace(tzinfo=None) for m in marks), default=None)

    def awaitTermination(self, seconds: float | None = None) -> bool:  # noqa: N802
        """Wait for all queries; whether they ended. One that failed raises, unless it stopped at a control message."""
        ended = True
        for q in self.queries:
            try:
                ended &= q.awaitTermination(seconds) is not False if seconds is not None else q.awaitTermination() is None
            except StreamingQueryException as failed:
                if CONTROL_REACHED not in str(failed):
                    self.stop()
                    raise
        return ended


@contextmanager
def _configured(spark: SparkSession, settings: dict[str, str]):
    """The session with these settings, and as it was before."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start_router(
    spark: SparkSession,
    events: DataFrame,
    commands: DataFrame,
    paths: RouterPaths,
    results: DataFrame | None = None,
    ticks: DataFrame | None = None,
    available_now: bool = True,
    result_timeout=RESULT_TIMEOUT,
    lateness=LATENESS,
    sinks: Sinks | None = None,
    partitions: int | None = None,
    **options,
) -> Router:
    """Start the routing query and, with ``results``, the answering query (checkpointed offsets, idempotent outputs).

    A start after a stop at a control message goes on behind it. ``partitions``: of these queries' exchanges, in place of the
    session's number; the answering query's state keeps those of its first start, and its store too. A session that names a
    state store provider has its own. ``options`` as of ``route_batch``.
    """
    own = spark.conf.get(STATE_PROVIDER, None) is not None
    settings = {} if own else {k: v for k, v in STATE_STORE.items() if spark.conf.get(k, None) is None}
    if partitions is not None:
        settings[PARTITIONS] = str(partitions)

    def started(frame: DataFrame, body, checkpoint: str):
        writer = frame.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
        with _configured(spark, settings):  # a query takes the session's settings with it as it starts
            return writer.start()

    # a batch that was cut before this start goes on; one that this start cuts does not, should Spark bring it again
    begun = KeyedState(spark, paths.state).latest()

    def route(df: DataFrame, batch_id: int) -> None:
        now = KeyedState(spark, paths.state).latest()
        if not process_batch(df, batch_id, paths, lateness=lateness, sinks=sinks, resume=now.order == begun.order, **options):
            raise ControlReached(CONTROL_REACHED)

    queries = [started(router_stream(events, commands), route, paths.checkpoint)]
    if results is not None:
        shared = {k: v for k, v in options.items() if k in ("base_uri", "commands_topic", "events_topic")}
        more = {"result_timeout": result_timeout, "lateness": lateness}
        joined = answer_stream(commands, results, ticks, shared.get("base_uri", jobs.BASE_URI), **more)
        queries.append(started(joined, lambda df, b: process_answers(df, b, paths, sinks=sinks, **more, **shared), paths.answers_checkpoint))
    return Router(queries)


def control_seen(spark: SparkSession, paths: RouterPaths) -> bool:
    """T5: has any complete batch carried a control message?"""
    batches = Folder(spark, paths.control_out)
    return any(Folder(spark, f"{paths.control_out}/{b}/{p}").exists("_SUCCESS") for b in batches.names() for p in Folder(spark, f"{paths.control_out}/{b}").names())


def stopped_at(spark: SparkSession, paths: RouterPaths) -> tuple[int, int] | None:
    """T5: the control message, as (microseconds, seq), behind which rows of the last batch wait."""
    return KeyedState(spark, paths.state).latest().cut


def stop_on_control(router: Router, spark: SparkSession, paths: RouterPaths) -> bool:
    """T5: wait for the router's end; whether it stopped at a control message, all rows up to it routed."""
    routing = router.queries[0]
    try:
        routing.awaitTermination()
    except StreamingQueryException as failed:
        if CONTROL_REACHED not in str(failed):
            router.stop()
            raise
    for q in router.queries[1:]:
        q.processAllAvailable() if q.isActive else None
        q.stop()
    return stopped_at(spark, paths) is not None


def tap_counts(spark: SparkSession, paths: RouterPaths) -> DataFrame:
    """Cumulative event counts over all committed batches."""
    counts = spark.read.parquet(paths.counts_out)
    return counts.groupBy("type", "resource_type").agg(F.sum("n").cast("long").alias("n"))


def read_output(spark: SparkSession, path: str) -> DataFrame:
    """All records below an output folder."""
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def replay_partitions(spark: SparkSession, rows: int) -> int:
    """The session's number of partitions, fewer for a replay of few rows: exchanges and state stores of streams are not
    coalesced, and each costs its time in every batch, rows or none."""
    enough = max(-(-rows // PARTITION_ROWS), spark.sparkContext.defaultParallelism)
    return min(int(spark.conf.get(PARTITIONS)), enough)


def feed_in_chunks(
    spark: SparkSession,
    events_raw: DataFrame,
    commands_raw: DataFrame,
    paths: RouterPaths,
    results: DataFrame | None,
    chunks: int = 3,
    stop_at_control: bool = False,
    result_timeout=RESULT_TIMEOUT,
    lateness=LATENESS,
    **options,
) -> int:
    """Replay tables as ``chunks`` arrivals in time order through the router, then one tick after the last timeout.

    The tables are written once as they are, so that no arrival makes all of their rows anew.
    Each arrival is written (in parallel) as new files of the input folders,
    then the queries restart from their checkpoints with ``availableNow`` and
    process exactly the new files; a control message ends the replay if the
    router is to stop at one. Returns the number of chunks consumed.
    """
    inputs = {"events": events_raw, "commands": commands_raw}
    if results is not None:
        inputs["results"] = results
    for name, df in inputs.items():
        df.write.parquet(f"{paths.root}/tables/{name}")
        inputs[name] = spark.read.parquet(f"{paths.root}/tables/{name}")
    spans = [df.select(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count(F.lit(1)).alias("rows")).first() for df in inputs.values()]
    partitions = replay_partitions(spark, sum(s.rows for s in spans))
    lo = min(s.lo for s in spans if s.lo is not None)
    hi = max(s.hi for s in spans if s.hi is not None)
    step = (hi - lo) / chunks
    last = hi + timedelta(microseconds=st.ttl_micros(result_timeout) + 2 * st.ttl_micros(lateness) + 1_000_000)
    for k in range(chunks):
        since, until = F.col("ts") >= st.ntz_lit(lo + step * k), F.col("ts") < st.ntz_lit(lo + step * (k + 1))
        arrived = since & (until | F.lit(k == chunks - 1))
        for name, df in inputs.items():
            df.filter(arrived).write.mode("append").parquet(f"{paths.root}/in/{name}")
        at = [last] if k == chunks - 1 else []
        spark.createDataFrame([(x,) for x in at], "ts timestamp_ntz").write.mode("append").parquet(f"{paths.root}/in/ticks")
        router = start_router(
            spark,
            io.stream_events(spark, f"{paths.root}/in/events"),
            io.stream_commands(spark, f"{paths.root}/in/commands"),
            paths,
            io.stream_results(spark, f"{paths.root}/in/results") if results is not None else None,
            spark.readStream.schema("ts timestamp_ntz").parquet(f"{paths.root}/in/ticks") if results is not None else None,
            stop_at_control=stop_at_control,
            result_timeout=result_timeout,
            lateness=lateness,
            partitions=partitions,
            **options,
        )
        if stop_at_control:
            if stop_on_control(router, spark, paths):
                return k + 1
        else:
            router.awaitTermination()
    return chunks


def new_paths(spark: SparkSession, name: str) -> RouterPaths:
    base = checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return RouterPaths(os.path.join(base, f"{name}-{uuid.uuid4().hex}"))
