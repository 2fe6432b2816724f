"""Keyed call-context state: registrations, as-of lookups, the expiring fold.

The state maps a resource id to a call context. Writes come from creating
commands (J1), from StasisStart events carrying a CALL_CONTEXT channel
variable, and from StasisStart events that create a context when none is
live. Reads come from every addressed event.

Scale design (no resource id is ever gathered into one group):

* Ops are bucketed by ``(resource_id, floor(ts / ttl))``. Inside one bucket any
  two ops are less than ``ttl`` apart, so after the first write of a bucket
  every later op resolves against the latest in-bucket write, and before it
  only the state carried in from bucket ``b-1`` can still be live.
* A bucket of more than ``SLICE_ROWS`` ops is cut into slices of time, up to
  ``SLICES``. A slice's effect is one row (its first and last put, its first
  create); what enters a slice is a running composition of the rows before it.
  All work on ops is by ``(resource_id, bucket, slice)``, so a hot id spreads
  over as many tasks as it has slices.
* The only sequential dependency left is the chain of *effective* creates
  through consecutive create-only buckets (a create is effective when the
  previous write has expired, which depends on the previous effective
  create). It is resolved by pointer doubling over buckets: ``log2(run
  length)`` rounds of joins, each linear in the number of candidate creates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callroute.functions.ids import generated_context, namespaced_key
from callroute.operators.events import CREATE_TYPE
from callroute.session import materialize

DEFAULT_TTL = "6 hours"
_UNITS = {"micro": 1, "milli": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
SLICE_ROWS = 200_000  # ops of one id in one bucket that a task takes whole
SLICES = 4_096  # slices of a bucket at most
HOT_BROADCAST = 100_000  # split buckets (some 40 bytes each) up to which their table is broadcast
P_NODE = -1  # path node of a bucket with explicit writes
N_NODE = -2  # path node of a bucket without any write


def ttl_micros(ttl) -> int:
    """``'6 hours'`` / ``timedelta`` / int micros -> micros."""
    if isinstance(ttl, timedelta):
        return int(ttl.total_seconds() * 1_000_000)
    if isinstance(ttl, int):
        return ttl
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", str(ttl).lower())
    if not m or m.group(2) not in _UNITS:
        raise ValueError(f"bad ttl: {ttl!r}")
    return int(m.group(1)) * _UNITS[m.group(2)]


def micros(ts: Column) -> Column:
    """TIMESTAMP_NTZ -> microseconds since 1970, time-zone free."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), ts)


def ntz_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal from a naive datetime (or text), time-zone free."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if value is None:
        return F.lit(None).cast("timestamp_ntz")
    return F.lit(str(value)).cast("timestamp_ntz")


def bucket_of(t: Column, width: int) -> Column:
    """floor(t / width) for any sign of t."""
    return ((t - F.pmod(t, F.lit(width))) / F.lit(width)).cast("long")


# ---------------------------------------------------------------------------
# Ops


def event_ops(events: DataFrame, keep: dict[str, str] | None = None) -> DataFrame:
    """State ops of addressed events: ``put`` (StasisStart with channel variable),
    ``create`` (StasisStart without), ``lookup`` (everything else).

    ``keep``: columns of the events, and the names under which they are carried along."""
    k = (
        F.when((F.col("type") == CREATE_TYPE) & F.col("channel_var").isNotNull(), F.lit("put"))
        .when(F.col("type") == CREATE_TYPE, F.lit("create"))
        .otherwise(F.lit("lookup"))
    )
    return events.filter(F.col("resource_id").isNotNull()).select(
        F.col("resource_id").alias("rid"),
        F.col("ts"),
        F.lit(1).alias("src"),
        F.col("seq"),
        k.alias("k"),
        F.when(k == "put", F.col("channel_var")).alias("ctx"),
        *(F.col(c).alias(name) for c, name in (keep or {}).items()),
    )


def registration_ops(registrations: DataFrame) -> DataFrame:
    """State ops of command registrations (J1 output): always ``put``."""
    return registrations.select(
        F.col("resource_id").alias("rid"),
        F.col("ts"),
        F.col("src").cast("int").alias("src"),
        F.col("seq"),
        F.lit("put").alias("k"),
        F.col("call_context").alias("ctx"),
    )


def state_ops(state: DataFrame) -> DataFrame:
    """Stored state entries re-enter as ``put`` ops at their write time (ordered first)."""
    return state.select(
        F.col("resource_id").alias("rid"),
        F.col("written_at").alias("ts"),
        F.lit(-1).alias("src"),
        F.lit(0).cast("long").alias("seq"),
        F.lit("put").alias("k"),
        F.col("call_context").alias("ctx"),
    )


# ---------------------------------------------------------------------------
# J3


def slices_of(counts: DataFrame, width: int, slice_rows: int) -> DataFrame | None:
    """``rid, b, n``: the buckets of more than ``slice_rows`` rows and how many slices of time each gets; None if there is none.

    ``counts``: ``rid, b, rows``, best computed already.
    """
    n = F.least(F.ceil(F.col("rows") / slice_rows) * 4, F.lit(min(SLICES, width)))
    hot = counts.filter(F.col("rows") > slice_rows).select("rid", "b", n.cast("long").alias("n"))
    found = hot.count()  # at most rows / slice_rows
    if not found:
        return None
    hot = materialize(hot)
    return F.broadcast(hot) if found <= HOT_BROADCAST else hot


def with_slice(rows: DataFrame, hot: DataFrame | None, width: int) -> DataFrame:
    """Adds ``slice``: the part of its bucket's time that ``t`` lies in, 0 in buckets that are not split."""
    if hot is None:
        return rows.withColumn("slice", F.lit(0).cast("long"))
    inside = F.col("t") - F.col("b") * F.lit(width)
    each = F.ceil(F.lit(width) / F.col("n"))  # slices of equal length, the last one shorter
    return rows.join(hot, ["rid", "b"], "left").withColumn("slice", F.coalesce(F.floor(inside / each), F.lit(0)).cast("long")).drop("n")


@dataclass
class Fold:
    """What every slice of every bucket needs to know of the rest: see ``fold``."""

    ops: DataFrame  # rid, ts, src, seq, k, ctx, t, b
    known: DataFrame  # per (rid, b, slice): w_in, ctx_in, eff_seq, carry
    hot: DataFrame | None
    width: int

    def resolve(self, rows: DataFrame) -> DataFrame:
        """``call_context`` and ``written`` of ``rows``: those of ``ops``, in any columns beside ``rid, t, b, src, seq, k, ctx``.

        One exchange by (id, bucket, slice) serves the join and the window.
        """
        res = with_slice(rows, self.hot, self.width).join(self.known, ["rid", "b", "slice"], "left")
        is_put = F.col("k") == "put"
        is_write = is_put | ((F.col("k") == "create") & (F.col("seq") == F.col("eff_seq")))
        res = res.withColumn("written", F.coalesce(is_write, F.lit(False)))
        write_ctx = F.when(is_put, F.col("ctx")).when(F.col("written"), generated_context(F.col("rid"), F.col("seq")))
        here = Window.partitionBy("rid", "b", "slice").orderBy("t", "src", "seq").rowsBetween(Window.unboundedPreceding, 0)
        latest = F.last("_wctx", ignorenulls=True).over(here)
        live_in = F.col("t") < F.col("w_in") + F.lit(self.width)
        res = res.withColumn("_wctx", write_ctx)
        res = res.withColumn("call_context", F.coalesce(latest, F.col("carry"), F.when(live_in, F.col("ctx_in"))))
        return res.drop("_wctx", "w_in", "ctx_in", "eff_seq", "carry", "slice")


def with_bucket(rows: DataFrame, width: int) -> DataFrame:
    return rows.withColumn("t", micros(F.col("ts"))).withColumn("b", bucket_of(F.col("t"), width))


def resolve_contexts(ops: DataFrame, ttl=DEFAULT_TTL, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Call context of every op under the full policy, with expiry.

    ``ops``: ``rid, ts, src, seq, k in (put, create, lookup), ctx`` (ctx for puts).
    A put writes its context. A create reuses a live context, else writes a new
    one (J4). A lookup reads a live context, else gets NULL. An entry written
    at ``w`` is live for ops with ``ts < w + ttl``; create-if-missing does not
    refresh it. Order is ``(ts, src, seq)`` per resource id.

    Returns ``rid, ts, src, seq, k, call_context, written`` (``written``: this
    op wrote the state).
    """
    done = fold(ops, ttl, slice_rows)
    return done.resolve(done.ops).select("rid", "ts", "src", "seq", "k", "call_context", "written")


def fold(ops: DataFrame, ttl=DEFAULT_TTL, slice_rows: int = SLICE_ROWS) -> Fold:
    """J3 up to the last step: what is carried into each slice of each ``(id, bucket)``.

    A bucket of more than ``slice_rows`` ops is cut into slices of time. The
    effect of a slice is summed up in one row (first and last write named in
    it, first create); what enters a slice is a running sum of those before
    it, so no task needs more than one slice of an id.
    """
    T = ttl_micros(ttl)
    o = materialize(with_bucket(ops.select("rid", "ts", "src", "seq", "k", "ctx"), T))
    is_put, is_create = F.col("k") == "put", F.col("k") == "create"
    at = F.struct("t", "src", "seq")

    def summed(rows: DataFrame) -> DataFrame:
        return materialize(
            rows.groupBy("rid", "b", "slice").agg(
                F.count(F.lit(1)).alias("rows"),
                F.min(F.when(is_put, at)).alias("first_put"),
                F.max_by(F.struct("t", "ctx"), F.when(is_put, at)).alias("last_put"),
                F.min(F.when(is_create, at)).alias("first_create"),
            )
        )

    # whole buckets first: where none is too large, they are the slices
    slices = summed(with_slice(o, None, T))
    hot = slices_of(slices, T, slice_rows)
    sliced = with_slice(o, hot, T)
    if hot is not None:
        slices = summed(sliced)

    # one row per (rid, bucket)
    summary = slices.groupBy("rid", "b").agg(
        F.min("first_put").alias("first_put"),
        F.max_by("last_put", F.when(F.col("last_put").isNotNull(), F.col("slice"))).alias("last_put"),
        F.min("first_create").alias("first_create"),
    )
    # a create counts as long as no put of its bucket came before
    counts = F.col("first_put").isNull() | (F.col("first_create") < F.col("first_put"))
    summary = summary.withColumn("has_put", F.col("first_put").isNotNull()).withColumn("first_cand", F.when(counts, F.col("first_create")))
    wr = Window.partitionBy("rid").orderBy("b")
    buckets = (
        summary.withColumn("prev_b", F.lag("b").over(wr))
        .withColumn("restart", F.col("has_put") | F.col("prev_b").isNull() | (F.col("prev_b") != F.col("b") - 1))
        .withColumn(
            "run_start",
            F.max(F.when(F.col("restart"), F.col("b"))).over(wr.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .withColumn("next_b", F.lead("b").over(wr))
        .withColumn("next_has_put", F.lead("has_put").over(wr))
    )
    # the next bucket continues the run: present, consecutive and without puts
    buckets = buckets.withColumn(
        "continues", F.coalesce((F.col("next_b") == F.col("b") + 1) & ~F.col("next_has_put"), F.lit(False))
    )
    buckets = materialize(buckets)
    run_len = buckets.groupBy("rid", "run_start").agg((F.max("b") - F.col("run_start") + 1).alias("n"))
    max_run = run_len.agg(F.max("n")).collect()[0][0] or 1

    # path node at the first bucket of every run: its number and the time it was written
    restart_node = F.when(F.col("has_put"), F.lit(P_NODE)).otherwise(
        F.coalesce(F.col("first_cand.seq"), F.lit(N_NODE))
    )
    restart_time = F.when(F.col("has_put"), F.col("last_put.t")).otherwise(F.col("first_cand.t"))
    known = buckets.filter(F.col("restart")).select("rid", "b", restart_node.alias("nseq"), restart_time.alias("nt"))

    if max_run > 1:
        jump = _first_jumps(sliced.filter(is_create), slices, buckets, hot, T)
        k = 0
        while (1 << k) < max_run:
            ext = (
                known.drop("nt").join(jump, ["rid", "b", "nseq"])
                .select("rid", F.col("to_b").alias("b"), F.col("to_nseq").alias("nseq"), F.col("to_t").alias("nt"))
            )
            known = known.unionByName(ext)
            if (2 << k) < max_run:
                nxt = jump.alias("j1").join(
                    jump.alias("j2"),
                    (F.col("j1.rid") == F.col("j2.rid"))
                    & (F.col("j1.to_b") == F.col("j2.b"))
                    & (F.col("j1.to_nseq") == F.col("j2.nseq")),
                )
                jump = nxt.select(
                    F.col("j1.rid").alias("rid"),
                    F.col("j1.b").alias("b"),
                    F.col("j1.nseq").alias("nseq"),
                    F.col("j2.to_b").alias("to_b"),
                    F.col("j2.to_nseq").alias("to_nseq"),
                    F.col("j2.to_t").alias("to_t"),
                )
                jump = materialize(jump)
            # dealt anew: a union keeps the partitions of both sides, so they would double each round
            known = materialize(known.repartition("rid", "b"))
            k += 1

    # write carried into every bucket: the path node of bucket b-1
    node_w = known.join(buckets.select("rid", "b", "last_put"), ["rid", "b"])
    carried = node_w.filter(F.col("nt").isNotNull()).select(
        "rid",
        (F.col("b") + 1).alias("b"),
        F.col("nt").alias("w_in"),
        F.when(F.col("nseq") == P_NODE, F.col("last_put.ctx"))
        .otherwise(generated_context(F.col("rid"), F.col("nseq")))
        .alias("ctx_in"),
    )
    bucket_in = buckets.select("rid", "b", "first_put", "first_cand").join(carried, ["rid", "b"], "left")
    into = slices.select("rid", "b", "slice").join(bucket_in, ["rid", "b"])

    # effective create of every bucket: first candidate at or after w_in + ttl
    counts = F.col("first_put").isNull() | (at < F.col("first_put"))
    entered = into.filter(F.col("w_in").isNotNull() & F.col("first_cand").isNotNull()).select("rid", "b", "slice", "w_in", "first_put")
    later = sliced.filter(is_create).join(entered, ["rid", "b", "slice"]).filter(counts & (F.col("t") >= F.col("w_in") + F.lit(T)))
    eff = later.groupBy("rid", "b").agg(F.min(F.struct("t", "seq", "slice")).alias("eff"))
    free = F.col("w_in").isNull() & F.col("first_cand").isNotNull()
    first = bucket_in.filter(free).select("rid", "b", F.col("first_cand.t").alias("t"), F.col("first_cand.seq").alias("seq"))
    eff = eff.select("rid", "b", "eff.seq", "eff.slice").unionByName(with_slice(first, hot, T).select("rid", "b", "seq", "slice"))
    eff = eff.withColumnsRenamed({"seq": "eff_seq", "slice": "eff_slice"})

    # what enters a slice: the last put of the slices before it, else the effective create if it lies there
    before = Window.partitionBy("rid", "b").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    puts = slices.select("rid", "b", "slice", F.last("last_put.ctx", ignorenulls=True).over(before).alias("put_before"))
    into = into.select("rid", "b", "slice", "w_in", "ctx_in").join(puts, ["rid", "b", "slice"]).join(eff, ["rid", "b"], "left")
    made = F.when(F.col("eff_slice") < F.col("slice"), generated_context(F.col("rid"), F.col("eff_seq")))
    into = into.select("rid", "b", "slice", "w_in", "ctx_in", "eff_seq", F.coalesce("put_before", made).alias("carry"))
    return Fold(o, into, hot, T)


def _first_jumps(creates: DataFrame, slices: DataFrame, buckets: DataFrame, hot: DataFrame | None, T: int) -> DataFrame:
    """J_0: for every possible path node of a bucket whose run continues into
    ``b+1``, the path node of ``b+1`` (an as-of lookup per slice of ``(rid, b+1)``)."""
    cont = buckets.filter("continues").select("rid", "b", "has_put", "last_put")
    here = lambda keys: creates.join(slices.select("rid", "b", "slice").join(keys, ["rid", "b"], "left_semi"), ["rid", "b", "slice"], "left_semi")
    # nodes with a write time: the put node, or any create of a create-only bucket
    put_nodes = cont.filter("has_put").select(
        "rid", "b", F.lit(P_NODE).cast("long").alias("nseq"), F.col("last_put.t").alias("w")
    )
    cand_nodes = here(cont.filter(~F.col("has_put"))).select("rid", "b", F.col("seq").alias("nseq"), F.col("t").alias("w"))
    none_nodes = cont.filter(~F.col("has_put")).select(
        "rid", "b", F.lit(N_NODE).cast("long").alias("nseq"), F.lit(None).cast("long").alias("w")
    )
    nodes = put_nodes.unionByName(cand_nodes).unionByName(none_nodes)
    # a node of bucket b expires in bucket b+1: the first create there, at that time or later, follows it
    probes = with_slice(
        nodes.select(
            "rid",
            (F.col("b") + 1).alias("b"),
            F.coalesce(F.col("w"), F.col("b") * F.lit(T)).alias("w"),
            F.col("w").isNull().alias("any"),
            F.col("nseq").alias("from_nseq"),
        ).withColumn("t", F.col("w") + F.lit(T)),
        hot,
        T,
    ).select("rid", "b", "slice", "t", F.lit(0).alias("kind"), F.lit(None).cast("struct<seq:bigint,t:bigint>").alias("node"), "from_nseq")
    targets = buckets.filter("continues").select("rid", (F.col("b") + 1).alias("b"))
    cands = here(targets).select(
        "rid", "b", "slice", "t", F.lit(1).alias("kind"), F.struct("seq", "t").alias("node"), F.lit(None).cast("long").alias("from_nseq")
    )
    w = Window.partitionBy("rid", "b", "slice").orderBy("t", "kind", "node.seq").rowsBetween(
        Window.currentRow, Window.unboundedFollowing
    )
    found = probes.unionByName(cands).withColumn("succ", F.first("node", ignorenulls=True).over(w)).filter(F.col("kind") == 0)
    if hot is not None:  # none in the probe's own slice: the first of the slices after it
        after = Window.partitionBy("rid", "b").orderBy("slice").rowsBetween(1, Window.unboundedFollowing)
        firsts = slices.select("rid", "b", "slice", F.struct(F.col("first_create.seq").alias("seq"), F.col("first_create.t").alias("t")).alias("s"), F.col("first_create").isNotNull().alias("is"))
        firsts = firsts.select("rid", "b", "slice", F.when(F.col("is"), F.col("s")).alias("s"))
        places = firsts.unionByName(probes.select("rid", "b", "slice").distinct().withColumn("s", F.lit(None).cast("struct<seq:bigint,t:bigint>")))
        places = places.groupBy("rid", "b", "slice").agg(F.max("s").alias("s"))
        following = places.select("rid", "b", "slice", F.first("s", ignorenulls=True).over(after).alias("next"))
        found = found.join(following, ["rid", "b", "slice"], "left").withColumn("succ", F.coalesce("succ", "next"))
    jump = found.select(
        "rid",
        (F.col("b") - 1).alias("b"),
        F.col("from_nseq").alias("nseq"),
        F.col("b").alias("to_b"),
        F.coalesce(F.col("succ.seq"), F.lit(N_NODE).cast("long")).alias("to_nseq"),
        F.col("succ.t").alias("to_t"),
    )
    return materialize(jump)


# ---------------------------------------------------------------------------
# J2 and the re-aimed store operations


def lookup_contexts(lookups: DataFrame, writes: DataFrame, bucket: str = "1 day", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """As-of left join, no expiry: latest write at or before each lookup.

    ``lookups``: ``rid, ts, src, seq``; ``writes``: ``rid, ts, src, seq, ctx``.
    Order is ``(ts, src, seq)``. Work is split by ``(rid, day)``, and a day of
    more than ``slice_rows`` rows into slices of time: the latest write inside
    comes from a window per slice; older writes come from a summary of one row
    per slice, carried forward.
    """
    W = ttl_micros(bucket)
    both = with_bucket(
        lookups.select("rid", "ts", "src", "seq", F.lit(None).cast("string").alias("ctx"), F.lit(False).alias("is_w"))
        .unionByName(writes.select("rid", "ts", "src", "seq", "ctx", F.lit(True).alias("is_w"))),
        W,
    )
    both = materialize(both)
    counts = both.groupBy("rid", "b").agg(F.count(F.lit(1)).alias("rows"))
    both = with_slice(both, slices_of(counts, W, slice_rows), W)
    part = ["rid", "b", "slice"]
    summary = both.groupBy(*part).agg(F.max_by("ctx", F.when(F.col("is_w"), F.struct("t", "src", "seq"))).alias("last_ctx"))
    before = Window.partitionBy("rid").orderBy("b", "slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*part, F.last("last_ctx", ignorenulls=True).over(before).alias("carry"))
    inside = Window.partitionBy(*part).orderBy("t", "src", "seq").rowsBetween(Window.unboundedPreceding, 0)
    res = both.join(carry, part, "left").withColumn("here", F.last(F.when(F.col("is_w"), F.col("ctx")), ignorenulls=True).over(inside))
    return res.filter(~F.col("is_w")).select("rid", "ts", "src", "seq", F.coalesce("here", "carry").alias("call_context"))


def upsert_latest(state: DataFrame | None, writes: DataFrame) -> DataFrame:
    """Insert-or-overwrite by resource id, last write wins.

    ``writes``: ``resource_id, call_context, ts, src, seq``; ``state``:
    ``resource_id, call_context, written_at`` (entries order before writes at
    the same instant). Result has the state schema.
    """
    w = writes.select(
        "resource_id", "call_context", F.col("ts").alias("written_at"), F.col("src").cast("int").alias("src"), "seq"
    )
    if state is not None:
        w = state.select(
            "resource_id", "call_context", "written_at", F.lit(-1).alias("src"), F.lit(0).cast("long").alias("seq")
        ).unionByName(w)
    latest = w.groupBy("resource_id").agg(
        F.max_by(F.struct("call_context", "written_at"), F.struct("written_at", "src", "seq")).alias("e")
    )
    return latest.select("resource_id", "e.call_context", "e.written_at")


def expire_state(state: DataFrame, now, ttl=DEFAULT_TTL) -> DataFrame:
    """Drop entries older than ``ttl`` at ``now`` (an entry exactly ``ttl`` old is kept)."""
    T = ttl_micros(ttl)
    now_col = ntz_lit(now)
    return state.filter(micros(F.col("written_at")) >= micros(now_col) - F.lit(T))


def lay_out(state: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """Store a state as a table bucketed and sorted by id (``path`` in shared storage), for lookups that leave it where it is.

    ``buckets`` should not be below ``spark.sql.shuffle.partitions``.
    """
    spark = state.sparkSession
    state.repartition(buckets, "resource_id").write.bucketBy(buckets, "resource_id").sortBy("resource_id").mode("overwrite").option("path", path).saveAsTable(name)
    return spark.table(name)


def layers(base: DataFrame, recent: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """Two layers laid out as one table: an id's recent entry, else its base entry, and which it is (``layer``)."""
    layer = lambda df, rank, kind: df.filter(F.col("call_context").isNotNull()).select(
        "resource_id", F.lit(rank).alias("_rank"), "call_context", "written_at", F.lit(kind).alias("layer")
    )
    both = layer(recent, 2, "recent").unionByName(layer(base, 1, "base"))
    top = both.groupBy("resource_id").agg(F.max_by(F.struct("call_context", "written_at", "layer"), "_rank").alias("_top"))
    return lay_out(top.select("resource_id", "_top.*"), name, path, buckets)


def lookup_laid_out(keys: DataFrame, table: DataFrame, key: str = "resource_id") -> DataFrame:
    """J7/J8 on a table of ``lay_out`` or ``layers``: only the keys are exchanged, to the buckets; absent -> NULL."""
    found = table.withColumnRenamed("resource_id", "_id")
    return keys.join(found.hint("merge"), F.col(key) == F.col("_id"), "left").drop("_id")


def lookup_state(keys: DataFrame, state: DataFrame, key: str = "resource_id") -> DataFrame:
    """Bulk point lookup, absent -> NULL. AQE broadcasts the state when it is small."""
    return keys.join(state.select(F.col("resource_id").alias(key), "call_context", "written_at"), key, "left")


def lookup_layered(keys: DataFrame, recent: DataFrame, base: DataFrame, key: str = "resource_id") -> DataFrame:
    """Read-through: the recent layer answers first, then the base layer.

    ``layer`` says which answered (``recent``, ``base`` or NULL on a miss).
    """
    layer = lambda df, rank, name: df.filter(F.col("call_context").isNotNull()).select(
        F.col("resource_id").alias(key), F.lit(rank).alias("_rank"), "call_context", F.lit(name).alias("layer")
    )
    both = layer(recent, 2, "recent").unionByName(layer(base, 1, "base"))
    # the layers meet first, one row per id, so the keys are joined once
    top = both.groupBy(key).agg(F.max_by(F.struct("call_context", "layer"), "_rank").alias("_top"))
    return keys.join(top, key, "left").select(*keys.columns, "_top.call_context", "_top.layer")


def with_state_key(df: DataFrame, col: str = "resource_id") -> DataFrame:
    """P22 as an operator: adds ``state_key``."""
    return df.withColumn("state_key", namespaced_key(F.col(col)))


__all__ = [
    "event_ops",
    "registration_ops",
    "state_ops",
    "fold",
    "resolve_contexts",
    "lookup_contexts",
    "upsert_latest",
    "expire_state",
    "lay_out",
    "layers",
    "lookup_laid_out",
    "lookup_state",
    "lookup_layered",
    "with_state_key",
    "ttl_micros",
]
