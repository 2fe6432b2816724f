"""Measurements and audits as grouped aggregates (A1-A9) plus the topic audit.

Every aggregate is a plain ``groupBy().agg()`` with map-side partial
aggregation; outputs are small (one row per tag combination). Nothing is
collected into a single group: error lists are counted, not concatenated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callroute.operators.events import resource_type_label
from callroute.session import materialize
from callroute.sources.dims import MESSAGE_TYPES, message_types

# Upper bounds (ms) of the duration histogram buckets; the last is the 10 s
# maximum expected duration.
DURATION_BUCKETS_MS = [5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000]
TYPES = [row[0] for row in MESSAGE_TYPES]
QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def event_counts(events: DataFrame) -> DataFrame:
    """A1: count per (message type, resource type), every type present, zero-filled.

    Counted before any drop: malformed and typeless messages count as UNKNOWN.
    """
    counts = events.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    dim = message_types(events.sparkSession).select(
        "type", resource_type_label(F.col("resource_type")).alias("resource_type")
    )
    return dim.join(counts, "type", "left").select(
        "type", "resource_type", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")
    )


def counts_by_type(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """A1's rows from the counts that a batch's survey brought along; types without a count have none."""
    known = F.create_map(*(F.lit(x) for t in TYPES for x in (t, counts.get(t, 0))))
    return message_types(spark).select("type", resource_type_label(F.col("resource_type")).alias("resource_type"), known[F.col("type")].cast("long").alias("n"))


def request_counts(requests: DataFrame) -> DataFrame:
    """A2: requests and transport errors per (method, path label)."""
    return requests.groupBy(F.col("method"), F.col("metric_path").alias("path")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("is_error")).alias("errors")
    )


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys, null being one key; a join on nothing is with a single row."""
    return reduce(lambda x, k: x & left[k].eqNullSafe(right[f"_{k}"]), keys, F.lit(True))


def exact_quantiles(values: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear between neighbours, as ``percentile``) per key; one column each.

    Distributed selection: rows become counts per distinct value, the counts
    are range-partitioned by key and value, and a value's rank is the sum of
    the partitions before it plus a running sum within its own. No task holds
    more than a partition of one key's values, however many there are.
    """
    counts = values.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    dealt = materialize(counts.repartitionByRange(*keys, "_v").withColumn("_slice", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_m"))  # a row per key and partition that holds it
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *(F.col(k).alias(f"_{k}") for k in keys),
        F.col("_slice").alias("_s"),
        F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"),
        F.sum("_m").over(whole).alias("_total"),
    )
    placed = dealt.join(sums, _same(dealt, sums, keys) & (F.col("_slice") == F.col("_s"))).drop(*(f"_{k}" for k in keys), "_s")
    inside = Window.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_end", F.col("_before") + F.sum("_n").over(inside)).withColumn("_first", F.col("_end") - F.col("_n"))
    at = {name: F.lit(q) * (F.col("_total") - 1) for name, q in quantiles.items()}
    holds = lambda rank: (F.col("_first") <= rank) & (rank < F.col("_end"))
    found = placed.filter(reduce(lambda x, y: x | y, [holds(f(p)) for p in at.values() for f in (F.floor, F.ceil)], F.lit(False)))
    ends = [F.max(F.when(holds(f(p)), F.col("_v"))).alias(f"{name}_{side}") for name, p in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))]
    found = found.groupBy(*keys).agg(*ends, F.first("_total").alias("_total"))
    between = lambda name, p: F.when(F.floor(p) == F.ceil(p), F.col(f"{name}_lo")).otherwise((F.ceil(p) - p) * F.col(f"{name}_lo") + (p - F.floor(p)) * F.col(f"{name}_hi"))
    return found.select(*keys, *(between(name, p).alias(name) for name, p in at.items()))


def _histogram(df: DataFrame, keys: list[str], col: str, buckets, exact: bool) -> DataFrame:
    d = F.col(col)
    head = [F.count(d).alias("count"), F.sum(d).alias("sum"), F.max(d).alias("max")]
    below = [F.count_if(d <= F.lit(b)).alias(f"le_{b}") for b in buckets]
    names = [*keys, "count", "sum", "max", *QUANTILES, *(f"le_{b}" for b in buckets)]
    if not exact:
        sketched = [F.percentile_approx(d, q, 10000).cast("double").alias(name) for name, q in QUANTILES.items()]
        return df.groupBy(*keys).agg(*head, *sketched, *below).select(*names)
    grouped = df.groupBy(*keys).agg(*head, *below)
    quantiles = exact_quantiles(df, keys, col, QUANTILES).withColumnsRenamed({k: f"_{k}" for k in keys})
    return grouped.join(quantiles, _same(grouped, quantiles, keys), "left").select(*names)


def request_durations(requests: DataFrame, buckets=DURATION_BUCKETS_MS, exact: bool = True) -> DataFrame:
    """A3: duration histogram per (method, path): cumulative buckets, count, sum, max, quantiles.

    ``exact=True``: quantiles by distributed selection (``exact_quantiles``);
    ``exact=False`` uses a bounded sketch (``percentile_approx``) in one pass.
    """
    df = requests.withColumn("path", F.col("metric_path"))
    return _histogram(df, ["method", "path"], "duration_ms", buckets, exact)


def lookup_stats(lookups: DataFrame) -> DataFrame:
    """A4: lookup attempts, misses and which layer answered (J8 output)."""
    return lookups.agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("layer").isNull()).alias("misses"),
        F.count_if(F.col("layer") == "recent").alias("recent_hits"),
        F.count_if(F.col("layer") == "base").alias("base_hits"),
    )


def context_lookups(resolved: DataFrame) -> DataFrame:
    """A4 of the router itself (J3 output): lookups of a call context, those that found none, and contexts created for want of one."""
    asked = resolved.filter(F.col("k") != "put")
    return asked.groupBy("k").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("call_context").isNull() | F.col("written")).alias("misses"),
        F.count_if("written").alias("created"),
    )


def write_durations(writes: DataFrame, buckets=DURATION_BUCKETS_MS, exact: bool = True) -> DataFrame:
    """A5: the duration histogram of state writes (one row)."""
    return _histogram(writes, [], "duration_ms", buckets, exact)


def drop_counts(dropped: DataFrame) -> DataFrame:
    """Dropped messages per processor and reason."""
    return dropped.groupBy("processor", "reason").agg(F.count(F.lit(1)).alias("n"))


def merge_reports(probes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Merge the error lists of many reports; a merged report is ok iff it has none.

    Errors are counted per group (never concatenated into one array); use
    ``report_errors`` for the error rows themselves.
    """
    by = by or []
    grouped = probes.groupBy(*by) if by else probes.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("reports"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("long").alias("n_errors"),
    ).withColumn("is_ok", F.col("n_errors") == 0)


def report_errors(probes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The merged error list as rows: ``by..., error, n``."""
    by = by or []
    return probes.select(*by, F.explode("errors").alias("error")).groupBy(*by, "error").agg(
        F.count(F.lit(1)).alias("n")
    )


def availability(probes: DataFrame) -> DataFrame:
    """1/0 per backing service from its latest probe (a failed probe is 0)."""
    value = (F.size("errors") == 0).cast("int")
    return probes.groupBy("service").agg(
        F.max_by(value, F.struct(F.col("ts"), value)).alias("value")
    )


def with_common_tags(df: DataFrame, tags: dict[str, str]) -> DataFrame:
    """Constant label columns on every measurement row."""
    return df.withColumns({k: F.lit(v) for k, v in tags.items()})


def missing_required(required: DataFrame, present: DataFrame, name: str = "name") -> DataFrame:
    """Required names that are not present (left anti join)."""
    return required.select(name).distinct().join(present.select(name).distinct(), name, "left_anti")


def as_long(df: DataFrame, metric: str, tags: list[str], values: dict[str, Column | str]) -> DataFrame:
    """Measurement rows ``metric, tags, value`` from a wide aggregate."""
    tag_text = (
        F.concat_ws(",", *[F.concat(F.lit(f"{t}="), F.coalesce(F.col(t).cast("string"), F.lit(""))) for t in tags])
        if tags
        else F.lit("")
    )
    cells = [
        F.struct(F.lit(metric + suffix).alias("metric"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("value"))
        for suffix, v in values.items()
    ]
    return df.select(tag_text.alias("tags"), F.explode(F.array(*cells)).alias("_cell")).select("_cell.metric", "tags", "_cell.value")
