"""Where the answering query keeps commands and results that wait."""

from datetime import timedelta

from test_stream import T0, answers, arrive, command, quarantine, result

from callroute.streaming import stream as sm

DEFAULT = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


def kept(router):
    """Rows that wait after each batch, and whether they lie in files instead of a map in memory."""
    states = [p.stateOperators[0] for p in router.queries[1].recentProgress]
    return max(s.numRowsTotal for s in states), all("rocksdbTotalBytesWritten" in s.customMetrics for s in states)


def test_waiting_rows_lie_on_disk(spark):
    paths = sm.new_paths(spark, "test-stream")
    router = arrive(spark, paths, [command(1, 0), command(2, 0), result(3, 0, 204)])
    assert kept(router) == (3, True)
    assert all(spark.conf.get(k, None) is None for k in sm.STATE_STORE)  # the session is as it was
    router = arrive(spark, paths, [result(1, 1), command(3, 1)])
    assert kept(router)[1]
    assert answers(spark, paths) == [(1, 200), (3, 204)]


def test_a_session_may_name_its_store_and_a_state_stays_where_it_is(spark):
    paths = sm.new_paths(spark, "test-stream")
    spark.conf.set(sm.STATE_PROVIDER, DEFAULT)
    try:
        assert kept(arrive(spark, paths, [command(1, 0), result(3, 0, 204)])) == (2, False)
        assert spark.conf.get(sm.STATE_PROVIDER) == DEFAULT
    finally:
        spark.conf.unset(sm.STATE_PROVIDER)
    # a router that began with another store goes on with it
    assert kept(arrive(spark, paths, [result(1, 1), command(3, 1)])) == (4, False)
    assert answers(spark, paths) == [(1, 200), (3, 204)]


def test_results_that_nothing_claims_wait_on_disk_before_the_quarantine(spark):
    paths = sm.new_paths(spark, "test-stream")
    assert kept(arrive(spark, paths, [command(1, 0), result(1, 1), result(70, 1)])) == (3, True)
    assert quarantine(spark, paths) == []
    assert kept(arrive(spark, paths, [T0 + timedelta(days=1)]))[1]
    assert quarantine(spark, paths) == [("commandResponse", "unclaimed_result", 70)]
    assert answers(spark, paths) == [(1, 200)]
