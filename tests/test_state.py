"""The call-context policy: distributed J3 against the sequential brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import bruteforce
from callroute.operators import state as st

SCHEMA = "rid string, ts timestamp_ntz, src int, seq long, k string, ctx string"
T0 = datetime(2024, 1, 1)
TTL = timedelta(hours=6)


def _run(spark, ops, ttl="6 hours", slice_rows=st.SLICE_ROWS):
    df = spark.createDataFrame(ops, SCHEMA)
    got = {(r.rid, r.src, r.seq): (r.call_context, r.written) for r in st.resolve_contexts(df, ttl, slice_rows).collect()}
    return got


def _ops(rng, n, rids, span_h, p_put=0.15, p_create=0.35, tick_min=1):
    out = []
    for i in range(n):
        k = rng.random()
        kind = "put" if k < p_put else ("create" if k < p_put + p_create else "lookup")
        ts = T0 + timedelta(minutes=tick_min * rng.randrange(int(span_h * 60 / tick_min)))
        src = 0 if (kind == "put" and rng.random() < 0.5) else 1
        out.append((rng.choice(rids), ts, src, i, kind, f"c{i}" if kind == "put" else None))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_bruteforce_random(spark, seed):
    rng = random.Random(seed)
    ops = _ops(rng, 600, ["a", "b", "c", "d"], span_h=96, tick_min=30)  # many ties on ts
    assert _run(spark, ops) == bruteforce.fold(ops, TTL)


def test_long_create_chains_need_doubling(spark):
    # one hot id: creates every 50 minutes for 10 days, no explicit writes
    ops = [("hot", T0 + timedelta(minutes=50 * i), 1, i, "create", None) for i in range(300)]
    ops += [("hot", T0 + timedelta(minutes=50 * i + 7), 1, 10_000 + i, "lookup", None) for i in range(300)]
    assert _run(spark, ops) == bruteforce.fold(ops, TTL)


@pytest.mark.parametrize(("seed", "slice_rows", "p_put"), [(4, 3, 0.15), (5, 10, 0.02), (6, 1, 0.0)])
def test_split_buckets_match_bruteforce(spark, seed, slice_rows, p_put):
    rng = random.Random(seed)
    ops = _ops(rng, 500, ["a", "b", "hot", "hot", "hot"], span_h=60, p_put=p_put, tick_min=7)
    assert _run(spark, ops, slice_rows=slice_rows) == bruteforce.fold(ops, TTL)


def test_one_hot_id_inside_one_ttl_spreads(spark):
    """A third of all ops are one id's, within one bucket: no group of the split work holds more than some slices' worth."""
    rng = random.Random(9)
    ops = [("hot", T0 + timedelta(seconds=rng.randrange(6 * 3600)), 1, i, rng.choice(["lookup", "create"]), None) for i in range(3000)]
    ops += [("hot", T0 + timedelta(seconds=9000), 0, 50_000, "put", "mid")]
    ops += [(f"r{i % 900}", T0 + timedelta(minutes=i % 700), 1, 10_000 + i, "create", None) for i in range(6000)]
    df = spark.createDataFrame(ops, SCHEMA)
    done = st.fold(df, "6 hours", slice_rows=100)
    sizes = st.with_slice(done.ops, done.hot, done.width).groupBy("rid", "b", "slice").count().collect()
    assert max(r["count"] for r in sizes) < 100 and len([r for r in sizes if r.rid == "hot"]) > 50
    assert _run(spark, ops, slice_rows=100) == bruteforce.fold(ops, TTL)


@pytest.mark.parametrize("slice_rows", [2, 200_000])
def test_lookups_match_bruteforce(spark, slice_rows):
    rng = random.Random(11)
    at = lambda: T0 + timedelta(hours=rng.randrange(60))
    writes = [(rng.choice("ab"), at(), rng.randrange(2), i, f"c{i}") for i in range(60)]
    asked = [(rng.choice("abc"), at(), 1, 1000 + i) for i in range(200)]
    lookups = spark.createDataFrame(asked, "rid string, ts timestamp_ntz, src int, seq long")
    written = spark.createDataFrame(writes, "rid string, ts timestamp_ntz, src int, seq long, ctx string")
    got = {r.seq: r.call_context for r in st.lookup_contexts(lookups, written, slice_rows=slice_rows).collect()}
    latest = lambda a: max((w for w in writes if w[0] == a[0] and w[1:4] <= a[1:4]), key=lambda w: w[1:4], default=(None,) * 5)[4]
    assert got == {a[3]: latest(a) for a in asked}


def test_policy_edges(spark):
    h = lambda x: T0 + timedelta(hours=x)
    ops = [
        ("x", h(0), 0, 1, "put", "reg"),          # registration
        ("x", h(0), 1, 2, "lookup", None),         # same instant: command first
        ("x", h(6), 1, 3, "lookup", None),         # exactly ttl old: expired
        ("x", h(6), 1, 4, "create", None),         # expired -> new context
        ("x", h(7), 1, 5, "create", None),         # live -> reuse, no refresh
        ("x", h(12), 1, 6, "lookup", None),        # 6 h after the create: expired
        ("y", h(0), 1, 7, "create", None),
        ("y", h(1), 1, 8, "put", "var"),           # channel variable overwrites a live entry
        ("y", h(2), 1, 9, "lookup", None),
        ("z", h(0), 0, 10, "put", "one"),
        ("z", h(1), 0, 11, "put", "two"),          # last write wins
        ("z", h(2), 1, 12, "lookup", None),
    ]
    got = _run(spark, ops)
    assert got == bruteforce.fold(ops, TTL)
    assert got[("x", 1, 2)][0] == "reg"
    assert got[("x", 1, 3)][0] is None
    assert got[("x", 1, 4)] == (bruteforce.generated("x", 4), True)
    assert got[("x", 1, 5)] == (bruteforce.generated("x", 4), False)
    assert got[("x", 1, 6)][0] is None
    assert got[("y", 1, 9)][0] == "var"
    assert got[("z", 1, 12)][0] == "two"


def test_empty_input(spark):
    assert _run(spark, []) == {}


def test_store_operations(spark):
    w = spark.createDataFrame(
        [("a", "c1", T0, 0, 1), ("a", "c2", T0 + TTL, 1, 2), ("b", "c3", T0, 0, 3)],
        "resource_id string, call_context string, ts timestamp_ntz, src int, seq long",
    )
    state = st.upsert_latest(None, w)
    assert {r.resource_id: r.call_context for r in state.collect()} == {"a": "c2", "b": "c3"}
    kept = st.expire_state(state, T0 + TTL, "6 hours").collect()
    assert {r.resource_id for r in kept} == {"a", "b"}  # exactly ttl old is kept
    kept = st.expire_state(state, T0 + TTL + timedelta(seconds=1), "6 hours").collect()
    assert {r.resource_id for r in kept} == {"a"}
    keys = spark.createDataFrame([("a",), ("zz",)], "resource_id string")
    got = {r.resource_id: r.call_context for r in st.lookup_state(keys, state).collect()}
    assert got == {"a": "c2", "zz": None}
    recent = state.filter(F.col("resource_id") == "a")
    lay = {r.resource_id: r.layer for r in st.lookup_layered(keys.union(spark.createDataFrame([("b",)], "resource_id string")), recent, state).collect()}
    assert lay == {"a": "recent", "b": "base", "zz": None}


def test_lookup_contexts_asof(spark):
    writes = spark.createDataFrame(
        [("a", T0, 0, 1, "c1"), ("a", T0 + timedelta(days=3), 0, 2, "c2")],
        "rid string, ts timestamp_ntz, src int, seq long, ctx string",
    )
    lookups = spark.createDataFrame(
        [("a", T0, 1, 10), ("a", T0 + timedelta(days=2), 1, 11), ("a", T0 + timedelta(days=5), 1, 12), ("b", T0, 1, 13)],
        "rid string, ts timestamp_ntz, src int, seq long",
    )
    got = {r.seq: r.call_context for r in st.lookup_contexts(lookups, writes).collect()}
    assert got == {10: "c1", 11: "c1", 12: "c2", 13: None}


def test_path_nodes_keep_their_partitions(spark, monkeypatch):
    """A long run of create-only buckets: the rounds of doubling must not double the partitions too."""
    start = datetime(2024, 1, 1)
    rows = [(f"r{i % 3}", start + timedelta(hours=5 * (i // 3)), 1, i, "create", None) for i in range(120)]
    ops = spark.createDataFrame(rows, "rid string, ts timestamp_ntz, src int, seq long, k string, ctx string")
    seen = []

    def counted(df):
        out = materialize(df)
        seen.append(out.rdd.getNumPartitions())
        return out

    materialize = st.materialize
    monkeypatch.setattr(st, "materialize", counted)
    out = st.resolve_contexts(ops).collect()
    assert len(out) == 120 and all(r.call_context for r in out)
    assert max(seen) <= max(8, spark.sparkContext.defaultParallelism), seen
