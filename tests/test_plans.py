"""Plan shapes, metrics and the driver contract on the smallest test tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_dimension_joins_are_broadcast(spark):
    from callroute.operators import commands as cm
    from callroute.operators import events as ev
    from callroute.sources import fixtures as fx

    p1 = _plan(ev.classify_events(fx.ari_events(spark, SF)))
    p2 = _plan(cm.classify_commands(cm.parse_commands(fx.ari_commands(spark, SF))))
    for p in (p1, p2):
        assert "BroadcastHashJoin" in p
        assert "NestedLoop" not in p and "Cartesian" not in p


@needs_data
def test_scan_prunes_columns(spark):
    from callroute.operators import events as ev
    from callroute.sources import fixtures as fx

    p = _plan(ev.classify_events(fx.ari_events(spark, SF)).select("seq", "type"))
    assert set(re.findall(r"(\w+):", p.split("ReadSchema: struct<")[1].split(">")[0])) == {"event_id", "user_id", "event_type"}
    assert "props" not in p and "value:double" not in p


def _exchanges(node, leaf, seen=()):
    """For every scan whose text has ``leaf``: the exchanges between it and the root."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return _exchanges(node.initialPlan(), leaf, seen)
    if name == "Exchange":
        seen = (*seen, node.outputPartitioning().toString())
    children = node.children()
    if not children.size():
        return [seen] if leaf in node.simpleString(10_000) else []
    return [x for i in range(children.size()) for x in _exchanges(children.apply(i), leaf, seen)]


@needs_data
def test_payload_is_exchanged_twice(spark):
    """Q1: each event's text goes to its slice and then to its key, in one pass over the events."""
    from callroute.plans import jobs
    from callroute.sources import fixtures as fx

    out = jobs.route_events(fx.ari_events(spark, SF), fx.ari_commands(spark, SF))
    paths = _exchanges(out._jdf.queryExecution().executedPlan(), "events.parquet")
    assert len(paths) == 1 and len(paths[0]) == 2, paths
    assert paths[0][0].startswith("hashpartitioning(key") and "slice" in paths[0][1]


def test_lookups_leave_the_state_where_it_is(spark):
    from callroute.operators import state as st
    from callroute.session import scratch_path

    path = scratch_path(spark, "laid-out")
    entry = lambda i, c: (f"r{i}", c, None)
    schema = "resource_id string, call_context string, written_at timestamp_ntz"
    base = spark.createDataFrame([entry(i, f"b{i}") for i in range(30)] + [entry(99, None)], schema)
    recent = spark.createDataFrame([entry(i, f"n{i}") for i in range(10)], schema)
    table = st.layers(base, recent, "test_layers_" + path.rsplit("-", 1)[1].replace("_", "u").lower(), f"{path}/table")
    keys = spark.createDataFrame([(f"r{i}",) for i in (1, 1, 20, 99, 500)], "resource_id string")
    out = st.lookup_laid_out(keys, table)
    assert sorted((r.resource_id, r.call_context, r.layer) for r in out.collect()) == [("r1", "n1", "recent"), ("r1", "n1", "recent"), ("r20", "b20", "base"), ("r500", None, None), ("r99", None, None)]
    assert _exchanges(out._jdf.queryExecution().executedPlan(), "test_layers_") == [()]


@needs_data
def test_payload_text_is_untouched(spark):
    import json

    from callroute.operators import events as ev

    raw = ' {"type":"StasisStart","big":123456789012345678901234567890123456789012345678901,"a":1,"a":2.50,"channel":{"id":"c\\u00e9\\"x"}} '
    row = spark.createDataFrame([(1, raw)], "seq long, raw string").withColumn("call_context", F.lit('k"\\'))
    out = ev.event_envelopes(ev.prepare_events(row), "t").first()
    assert raw in out.value
    value = json.loads(out.value)
    assert list(value) == ["type", "commandsTopic", "payload", "callContext", "resources", "commandId", "commandRequest"]
    assert value["callContext"] == 'k"\\' and value["resources"] == [{"type": "CHANNEL", "id": 'cé"x'}] and value["commandId"] is None
    assert value["payload"]["big"] == 123456789012345678901234567890123456789012345678901


@needs_data
def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert set(df.columns) >= {"seq", "key", "type", "key_seq"}
    assert df.count() > 0
    qs, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(qs)
    assert len(qs) >= 50


@needs_data
def test_metrics_shapes(spark):
    from callroute.plans import catalog

    d = catalog.q_request_durations(spark, SF).collect()
    for r in d:
        assert r["le_10000"] <= r["count"] and r["p50"] <= r["p99"] <= r["max"]
    m = catalog.q_merge_reports(spark, SF).collect()
    assert all(r.is_ok == (r.n_errors == 0) for r in m)
    av = {r.service: r.value for r in catalog.q_availability(spark, SF).collect()}
    assert set(av.values()) <= {0, 1}


@needs_data
def test_stream_equals_batch(spark):
    """Split into arrivals, the streamed router gives the batch answer."""
    from callroute.plans import catalog, jobs
    from callroute.sources import fixtures as fx
    from callroute.streaming import stream as sm

    paths = sm.new_paths(spark, "test-router")
    events, commands, results = fx.ari_events(spark, SF), fx.ari_commands(spark, SF), fx.ari_result_messages(spark, SF)
    sm.feed_in_chunks(spark, events, commands, paths, results, chunks=2, result_timeout="48 hours")
    streamed = sm.read_output(spark, paths.events_out).select("seq", "key").collect()
    batch = jobs.route_events(events, commands).select("seq", "key").collect()
    assert sorted(streamed) == sorted(batch)
    counts = {(r.type): r.n for r in sm.tap_counts(spark, paths).collect()}
    batch_counts = {(r.type): r.n for r in catalog.q_event_counts(spark, SF).collect()}
    assert counts == batch_counts
    answered = sm.read_output(spark, paths.responses_out).select("request_id", "status_code").collect()
    expected = jobs.route_responses(commands, results.drop("seq", "ts")).select("request_id", "status_code").collect()
    assert sorted(answered) == sorted(expected)


def test_quantiles_are_those_of_percentile(spark):
    from callroute.operators import metrics as mt

    rows = [("a", float(i % 17)) for i in range(100)] + [(None, 3.5), (None, -1.0), ("b", None), ("c", 2.0)] + [("d", i * 0.37) for i in range(501)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    want = {r.k: (r.p50, r.p95, r.p99) for r in df.groupBy("k").agg(*(F.percentile("v", q).alias(n) for n, q in mt.QUANTILES.items())).collect()}
    got = {r.k: (r.p50, r.p95, r.p99) for r in mt.exact_quantiles(df, ["k"], "v", mt.QUANTILES).collect()}
    assert got.keys() == want.keys() - {"b"}
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in got)
    one = mt._histogram(df, [], "v", [10], True).first()
    assert one["p95"] == pytest.approx(df.select(F.percentile("v", 0.95)).first()[0]) and one["count"] == 604
    assert mt._histogram(df.limit(0), [], "v", [10], True).first()["p50"] is None
    assert "percentile" not in _plan(mt._histogram(df, ["k"], "v", [10], True))


def test_a_million_distinct_durations_in_one_group(spark):
    """Each partition of the selection holds a share of the group, none all of it."""
    from callroute.operators import metrics as mt

    n = 1_000_000
    df = spark.range(n).select(F.lit("POST").alias("method"), F.lit("p").alias("metric_path"), (F.col("id") * 0.5).alias("duration_ms"))
    row = mt.request_durations(df).first()
    assert (row["p50"], row["p95"], row["max"]) == (pytest.approx((n - 1) / 4), pytest.approx(0.95 * (n - 1) / 2), (n - 1) / 2)
    held = df.repartitionByRange(8, "method", "metric_path", "duration_ms").groupBy(F.spark_partition_id()).count().collect()
    assert len(held) == 8 and max(r["count"] for r in held) < n / 4


@pytest.mark.parametrize("absent", ["callroute.llm", "corpus_pipeline", "xxhash", "public_tokenizers"])
def test_engine_loads_without_the_optional_part(absent):
    """Whatever the training-data operators need may be missing: the engine's own queries are there."""
    import subprocess
    import sys

    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) >= 58


@needs_data
@pytest.mark.parametrize(("query", "scans"), [("drop_counts", 0), ("quarantine", 0), ("event_envelopes", 1), ("lookup_laid_out", 0), ("lookup_layered", 0)])
def test_messages_are_not_parsed_anew_for_the_result(spark, query, scans):
    """What the result reads again of the messages is stored; only envelopes read the events again, once, for their payload."""
    from callroute.plans.catalog import QUERIES

    plan = QUERIES[query](spark, SF)._jdf.queryExecution().executedPlan()
    assert len(_exchanges(plan, "events.parquet")) == scans and not _exchanges(plan, "orders.parquet")
