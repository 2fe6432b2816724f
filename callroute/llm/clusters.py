"""Centroid clustering of whole-number vectors by equal-average equal-variance search.

Two inequalities bound the squared distance of a vector x and a centroid c of
n components from below, with component sums S and deviations V (the norm of
what is left when the mean is taken away):

    n * D >= (Sx - Sc)**2               equal average
    n * D >= (Sx - Sc)**2 + n * (Vx - Vc)**2    equal variance

Centroids are sorted by sum, which is by mean. A vector starts at its own place among
them and scans outward on both sides, nearer mean first. A side is closed by
the first inequality, a single centroid is passed over by the second; what is
left is measured in whole numbers. The bounds are taken in double precision
with a margin, so only a centroid that is surely farther is rejected.

A round is one pass over the vectors: each task returns its clusters' counts
and sums, and the driver gets one row per centroid and component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .topk import usable

LIMIT = (1 << 27) - 1  # of a whole-number component: squared distances stay below 2**63 up to 128 components
_MARGIN = 1 - 1e-9
_ROWS = 8_192  # vectors searched together


class Centroids:
    """Centroids as a search needs them: by ascending component sum, ties by number."""

    def __init__(self, rows: np.ndarray):
        self.count, self.width = rows.shape
        sums = rows.sum(axis=1)
        self.number = np.lexsort([np.arange(self.count), sums])
        self.rows, self.sums = rows[self.number], sums[self.number].astype(np.float64)
        self.deviations = deviations(self.rows)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, squared distance, distances measured) for the rows of ``x``; ties to the smaller number."""
        n = len(x)
        sums, spread = x.sum(axis=1).astype(np.float64), deviations(x)
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, self.count, np.int64)
        right = np.searchsorted(self.sums, sums)  # the next centroid of a mean not below
        left = right - 1
        alive = np.arange(n)
        measured = 0
        while len(alive):
            up, down = right[alive], left[alive]
            far = np.full(len(alive), np.inf)
            above = np.where(up < self.count, np.abs(self.sums[np.minimum(up, self.count - 1)] - sums[alive]), far)
            below = np.where(down >= 0, np.abs(self.sums[np.maximum(down, 0)] - sums[alive]), far)
            gap = np.minimum(above, below)
            # the nearer mean of both sides decides: beyond it every centroid left is farther
            open_ = (gap < np.inf) & (gap * gap * _MARGIN <= self.width * best[alive].astype(np.float64))
            alive, up, down = alive[open_], up[open_], down[open_]
            gap, side = gap[open_], (above <= below)[open_]
            at = np.where(side, up, down)
            right[alive[side]] += 1
            left[alive[~side]] -= 1
            bound = gap * gap + self.width * (spread[alive] - self.deviations[at]) ** 2
            close = bound * _MARGIN - 1e-6 <= self.width * best[alive].astype(np.float64)
            rows, at = alive[close], at[close]
            difference = x[rows] - self.rows[at]
            distance = np.einsum("ij,ij->i", difference, difference)
            measured += len(rows)
            number = self.number[at]
            better = (distance < best[rows]) | ((distance == best[rows]) & (number < who[rows]))
            best[rows[better]], who[rows[better]] = distance[better], number[better]
        return who, best, measured


def deviations(x: np.ndarray) -> np.ndarray:
    """The norm of each row less its mean, from differences, so it never cancels."""
    y = x.astype(np.float64)
    return np.linalg.norm(y - y.mean(axis=1, keepdims=True), axis=1) if x.shape[1] else np.zeros(len(x))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _parts(batches, width: int):
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part, _matrix(part, width)


def _sums(centroids):
    """Per task: how many vectors are nearest to each centroid, and their component sums."""

    def run(batches):
        c = centroids.value
        total, count = np.zeros((c.count, c.width), np.int64), np.zeros(c.count, np.int64)
        for _part, x in _parts(batches, c.width):
            who, _distance, _measured = c.nearest(x)
            count += np.bincount(who, minlength=c.count)
            order = np.argsort(who, kind="stable")
            here, start = np.unique(who[order], return_index=True)
            if len(here):
                total[here] += np.add.reduceat(x[order], start, axis=0)
        full = np.flatnonzero(count)
        cells = np.repeat(full, c.width), np.tile(np.arange(c.width), len(full)), np.repeat(count[full], c.width), total[full].ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in cells], ["cluster", "i", "n", "x"])

    return run


def _assign(centroids, names: list[str]):
    def run(batches):
        c = centroids.value
        for part, x in _parts(batches, c.width):
            who, distance, _measured = c.nearest(x)
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(who.astype(np.int32)), pa.array(distance)], [*names, "_cluster", "_distance"])

    return run


def whole_vectors(vectors: DataFrame, vector: str, width: int, scale: int) -> DataFrame:
    """Rows that take part, all columns and ``v``, the components as floor(scale * x)."""
    fit = usable(vector) & (F.size(vector) == width)
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    small = F.forall("v", lambda x: x.between(-LIMIT, LIMIT))
    error = F.raise_error(F.lit(f"a component times {scale} is beyond {LIMIT}: distances would not be exact"))
    out = vectors.where(fit).withColumn("v", v)
    return out.withColumn("v", F.when(small, F.col("v")).otherwise(error))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest sha256 of ``seed:id`` (ties by components, null ids last), one row each."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")).cast("binary"), 256)
    return np.array([r.v for r in rows.select(order.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()], np.int64)


def cluster(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    seed: int = 3,
    scale: int = 1024,
    width: int = 64,
    vector: str = "embedding",
    vec_id: str = "vec_id",
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per vector that takes part: the columns ``keep`` (``vec_id``, if not named), ``_cluster`` int,
    ``_distance`` (squared, to its centroid), ``_cluster_inertia``, ``_inertia`` long, ``_centroid`` array of long.

    Vectors with exactly ``width`` components, none null, NaN or infinite, take
    part, as whole numbers floor(scale * x). Each of ``rounds`` rounds assigns
    every vector to its nearest centroid (ties: the smaller number) and moves
    each centroid that has vectors to floor(sum / count) of them; then vectors
    are assigned once more. Fewer vectors than ``k``: each is a centroid. No
    vectors: no rows. Repeated rows count each; rows of one id are rows of
    their own, a null id takes part and is the last choice for a first
    centroid. Extra columns are ignored unless kept; a kept column named like
    an added one, ``v``, ``_v``, ``_id`` or ``_number``, is refused. A whole-number component of 2**27 or more stops the
    job with a message, as its distance would not fit a long.

    The driver holds k * width numbers a round, never a vector of the table
    but the first k.
    """
    if not 1 <= width <= 128:
        raise ValueError("1 to 128 components: squared distances must fit a long")
    spark = common.ship(vectors.sparkSession)
    names = [vec_id] if keep is None else keep
    if clash := {"v", "_v", "_id", "_number", "_cluster", "_distance", "_cluster_inertia", "_inertia", "_centroid"} & set(names):
        raise ValueError(f"reserved column names: {sorted(clash)}")
    used = whole_vectors(vectors.select(*names, F.col(vec_id).alias("_id"), F.col(vector).alias("_v")), "_v", width, scale)
    rows = common.cut(used.drop("_v"), "vectors")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields)
    centroids = first_centroids(rows, k, seed)
    added = "_cluster int, _distance long"
    if not len(centroids):
        return spark.createDataFrame([], f"{fields}, {added}, _cluster_inertia long, _inertia long, _centroid array<long>")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(Centroids(centroids))
        moved = rows.select("v").mapInArrow(_sums(sent), "cluster long, i long, n long, x long")
        exact = F.sum(F.col("x").cast("decimal(38,0)"))
        for r in moved.groupBy("cluster", "i").agg(F.sum("n").alias("n"), exact.alias("x")).collect():
            centroids[r.cluster, r.i] = int(r.x) // r.n
        sent.unpersist()
    sent = spark.sparkContext.broadcast(Centroids(centroids))
    assigned = common.cut(rows.select(*names, "v").mapInArrow(_assign(sent, names), f"{fields}, {added}"), "assigned")
    inertia = {r["_cluster"]: r.d for r in assigned.groupBy("_cluster").agg(F.sum("_distance").alias("d")).collect()}
    total = sum(inertia.values())
    known = [(i, inertia.get(i, 0), total, c.tolist()) for i, c in enumerate(centroids)]
    of = spark.createDataFrame(known, "_number int, _cluster_inertia long, _inertia long, _centroid array<long>")
    # k rows: the size of the broadcast side is a parameter
    return assigned.join(F.broadcast(of), F.col("_cluster") == F.col("_number")).drop("_number")


def oracle_sql(k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024, width: int = 64) -> str:
    """The registered query in DuckDB SQL, one pair of expressions a round."""
    parts = [
        f"""
v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as q from embeddings
  where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id) nulls last, q) - 1 as c, q from v qualify c < {k})"""
    ]
    nearest = """
a{i} as materialized (select r, arg_min(c, (d, c)) as c, min(d) as d from (select v.r, c.c,
  list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from v cross join c{i} c) group by r)"""
    moved = """
m{i} as materialized (select c, list(((s - (((s % n) + n) % n)) // n)::bigint order by j) as q from (select c, j, sum(x)::hugeint as s, count(*) as n
  from (select a.c, unnest(v.q) as x, generate_subscripts(v.q, 1) as j from a{i} a join v using (r)) group by c, j) group by c),
c{j} as materialized (select c.c, coalesce(m.q, c.q) as q from c{i} c left join m{i} m using (c))"""
    for i in range(rounds):
        parts += [nearest.format(i=i), moved.format(i=i, j=i + 1)]
    parts.append(nearest.format(i=rounds))
    return f"""with {",".join(parts)}
select v.vec_id, a.c::int as cluster, a.d::bigint as distance, (sum(a.d) over (partition by a.c))::bigint as cluster_inertia,
  (sum(a.d) over ())::bigint as inertia, sha256(array_to_string(c.q, ',')) as centroid_sha256
from a{rounds} a join v using (r) join c{rounds} c on c.c = a.c
"""
