"""Embedding near-dedup: cosine links within a label by PCA-ordered tiled comparison.

Vectors are turned into the principal axes of all of them, put in order of
their cells on the leading axes, and cut into tiles. A tile has a box: its range
on each of these axes. Unit vectors of two tiles are at least as far apart as
the boxes, so pairs of tiles that can hold no link are left before any vector
of theirs is moved.
Within a pair of tiles products are accumulated from the leading axes; what
the rest can add is bounded by suffix norms, and a pair of vectors is left as
soon as it cannot reach the threshold. What remains is checked by its cosine
in double precision.

Equal vectors of a label are one node with a multiplicity, and a tile pair
returns counts of links and a spanning set of them, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .topk import usable

TILE = 1_024
BOX = 8  # axes that tiles have a range on
CELL_AXES = 3  # axes whose cells tiles are cut along
AXES = (8, 24)  # after how many axes the bound is tested
_PAIRS = 1 << 16


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(name)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()


def _padded(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    flat, offsets = _flat(batch, name)
    out = np.zeros((batch.num_rows, width))
    size = np.diff(offsets)
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)  # norms of huge or tiny components stay finite
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _moments(width: int):
    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            u = _unit(_padded(batch, "v", width))
            total += u.T @ u
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "x"])

    return run


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Axes of the unit vectors ``v`` by falling second moment, as columns; the driver gets width squared numbers."""
    rows = vectors.mapInArrow(_moments(width), "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((width, width))
    for r in rows:
        total[r.i, r.j] = r.x
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1].copy()


def _leading(axes, width: int, side: float):
    """Adds ``y``, the place on the first axes, and ``cell``, the numbers of its cells of that side, in an order that keeps near ones near."""

    def run(batches):
        for batch in batches:
            y = _unit(_padded(batch, "v", width)) @ axes.value[:, :BOX]
            cell = np.floor(y[:, :CELL_AXES] / side).astype(np.int32)
            places = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.from_numpy_dtype(x.dtype))) for x in (y, cell)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("label", "dims", "gid", "n", "v")] + places, ["label", "dims", "gid", "n", "v", "y", "cell"])

    return run


def _tiles(width: int, most: int):
    """Rows sorted by label, dims and cell to tiles of one label: the ranges of y, ids, multiplicities and vectors."""

    def tile(rows: pa.RecordBatch):
        y = _flat(rows, "y")[0].reshape(rows.num_rows, -1)
        gid = rows.column("gid").to_numpy()
        columns = [rows.column("label").slice(0, 1), rows.column("dims").slice(0, 1), pa.array([int(gid[0])]), pa.array([y.min(axis=0)]), pa.array([y.max(axis=0)])]
        blobs = [gid, rows.column("n").to_numpy(), _padded(rows, "v", width)]
        return pa.RecordBatch.from_arrays(columns + [pa.array([x.tobytes()]) for x in blobs], ["label", "dims", "tile", "low", "high", "gids", "ns", "vs"])

    def run(batches):
        held = None
        for batch in batches:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            label, dims = rows.column("label").to_numpy(zero_copy_only=False), rows.column("dims").to_numpy(zero_copy_only=False)
            edge = np.flatnonzero((label[1:] != label[:-1]) | (dims[1:] != dims[:-1])) + 1
            starts = np.concatenate([[0], edge])
            cuts = [x for a, b in zip(starts, [*edge, len(label)], strict=True) for x in range(a, b, most)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield tile(rows.slice(a, b - a))
            held = rows.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield tile(held)

    return run


def near_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of all vectors whose cosine is at least the threshold; within one tile each pair once."""
    ua, ub = _unit(a) @ axes, _unit(b) @ axes
    stops = [x for x in AXES if x < ua.shape[1]] or [ua.shape[1]]
    first = stops[0]
    score = ua[:, :first] @ ub[:, :first].T

    def suffix(u: np.ndarray, x: int) -> np.ndarray:
        return np.linalg.norm(u[:, x:], axis=1)

    hope = score + np.outer(suffix(ua, first), suffix(ub, first)) >= threshold - 1e-9
    if same:
        hope &= np.triu(np.ones(hope.shape, bool), 1)
    i, j = np.nonzero(hope)
    score = score[i, j]
    for start, stop in zip(stops, [*stops[1:], ua.shape[1]], strict=True):
        rest_a, rest_b = suffix(ua, stop), suffix(ub, stop)
        keep = []
        for at in range(0, len(i), _PAIRS):
            p, q = i[at : at + _PAIRS], j[at : at + _PAIRS]
            score[at : at + _PAIRS] += np.einsum("ij,ij->i", ua[p, start:stop], ub[q, start:stop])
            keep.append(score[at : at + _PAIRS] + rest_a[p] * rest_b[q] >= threshold - 1e-9)
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        i, j, score = i[keep], j[keep], score[keep]
    norm_a, norm_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    sure = np.zeros(len(i), bool)
    for at in range(0, len(i), _PAIRS):
        p, q = i[at : at + _PAIRS], j[at : at + _PAIRS]
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            cosine = np.einsum("ij,ij->i", a[p], b[q]) / (norm_a[p] * norm_b[q])
        odd = ~np.isfinite(cosine)  # the squares overflow or vanish: take the scaled vectors
        if odd.any():
            cosine[odd] = score[at : at + _PAIRS][odd]
        sure[at : at + _PAIRS] = cosine >= threshold
    return i[sure], j[sure]


def _compare(axes, width: int, threshold: float):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                side = []
                for s in "ab":
                    gid, n = (np.frombuffer(batch.column(s + c)[r].as_buffer(), np.int64) for c in ("gids", "ns"))
                    side.append((gid, n, np.frombuffer(batch.column(s + "vs")[r].as_buffer()).reshape(-1, width)))
                (ga, na, va), (gb, nb, vb) = side
                same = batch.column("same")[r].as_py()
                i, j = near_pairs(va, vb, axes.value, threshold, same)
                if not len(i):
                    continue
                to_a, to_b = np.bincount(i, nb[j], len(ga)), np.bincount(j, na[i], len(gb))
                node = np.concatenate([ga[to_a > 0], gb[to_b > 0]])
                links = np.concatenate([to_a[to_a > 0], to_b[to_b > 0]]).astype(np.int64)
                x, root = common.contract(ga[i], gb[j])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(links)], ["a", "b", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(root), pa.nulls(len(x), pa.int64())], ["a", "b", "n"])
            common.release()

    return run


def near_tiles(tiles: DataFrame, reach: float) -> DataFrame:
    """Pairs ``(a, b)``, a <= b, of tiles of one label and width whose boxes ``low`` to ``high`` are at most ``reach`` apart.

    Tiles meet in steps of the first two axes; what meets is judged by the distance of the boxes on all their axes.
    """
    axes = (0, 1)
    step = max(reach, 0.125)  # a tile's range is 2 at most, so it has some 300 places at most

    def side(name: str, margin: float) -> DataFrame:
        out = tiles.select("label", "dims", F.col("tile").alias(name), F.col("low").alias(f"{name}low"), F.col("high").alias(f"{name}high"))
        for i in axes:  # with one axis only the second place is 0
            at = lambda c, m, i=i: F.floor((F.coalesce(F.get(c, F.lit(i)), F.lit(0.0)) + m) / step)
            out = out.withColumn(f"at{i}", F.explode(F.sequence(at(F.col(f"{name}low"), -margin), at(F.col(f"{name}high"), margin))))
        return out

    met = side("a", 0.0).join(side("b", reach), ["label", "dims", *(f"at{i}" for i in axes)]).where("a <= b")
    gap = lambda i: F.greatest(F.lit(0.0), F.col("alow")[i] - F.col("bhigh")[i], F.col("blow")[i] - F.col("ahigh")[i])
    apart = F.aggregate(F.sequence(F.lit(0), F.size("alow") - 1), F.lit(0.0), lambda total, i: total + gap(i) * gap(i))
    return met.where(apart <= reach * reach + 1e-9).select("a", "b").distinct()


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """One row per row: ``vec_id``, ``n_links`` (other rows linked directly), ``component_id``, ``kept``.

    Rows are compared if their labels are equal and not null and their vectors
    have as many components. Vectors that are null, zero, or hold a null or
    non-finite component, and rows of null label, link with nothing and are
    their own component. Labels of any type are compared as they are. Equal rows are linked rows of their own. A null id is
    never the smallest; a component of null ids only has a null id and is not
    kept. Extra columns are ignored. An empty table gives an empty table.
    """
    spark = common.ship(vectors.sparkSession)
    zero = ~F.exists(vector, lambda x: x != 0)
    fit = usable(vector) & F.col(label).isNotNull() & ~F.coalesce(zero, F.lit(True))
    # -0.0 and 0.0 are one value, as they are for a cosine
    plain = F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))
    kind = vectors.schema[label].dataType
    nested = isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType))
    marked = F.to_json(F.struct(F.col(label))) if nested else F.col(label)
    of = "string" if nested else kind.simpleString()
    rows = vectors.select(F.col(vec_id).alias("id"), F.when(fit, marked).alias("label"), F.when(fit, plain).alias("v"))
    rows = rows.withColumn("gid", F.when(F.col("label").isNotNull(), F.xxhash64("label", "v")))
    used = rows.where("gid is not null")
    nodes = common.cut(used.groupBy("gid").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n"), F.min("id").alias("least")).withColumn("dims", F.size("v")), "vectors")
    width = nodes.agg(F.max("dims")).first()[0] or 1
    axes = spark.sparkContext.broadcast(principal_axes(nodes, width))
    # unit vectors of that cosine are at most this far apart
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    led = nodes.mapInArrow(_leading(axes, width, max(reach, 1e-3) / 4), f"label {of}, dims int, gid long, n long, v array<double>, y array<double>, cell array<int>")
    dealt = common.cut(led, "led").repartitionByRange("label", "dims", "cell", F.col("y")[0], "gid").sortWithinPartitions("label", "dims", "cell", F.col("y")[0], "gid")
    tiles = common.cut(dealt.mapInArrow(_tiles(width, TILE), f"label {of}, dims int, tile long, low array<double>, high array<double>, gids binary, ns binary, vs binary"), "tiles")
    pairs = common.cut(near_tiles(tiles, reach), "pairs")
    body = lambda s: tiles.select(F.col("tile").alias(s), *(F.col(c).alias(s + c) for c in ("gids", "ns", "vs")))
    both = pairs.join(body("a"), "a").join(body("b"), "b").select((F.col("a") == F.col("b")).alias("same"), *(s + c for s in "ab" for c in ("gids", "ns", "vs")))
    found = common.cut(both.mapInArrow(_compare(axes, width, threshold), "a long, b long, n long"), "found")
    roots = common.components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    marked = nodes.select("gid", "n", "least").join(roots, F.col("gid") == F.col("node"), "left").join(links, F.col("gid") == F.col("a"), "left")
    marked = marked.select("gid", "least", F.coalesce("root", "gid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    named = marked.groupBy("root").agg(F.min("least").alias("component"))
    classes = marked.join(named, "root").select("gid", "links", "component")
    out = rows.select("id", "gid").join(classes, "gid", "left")
    component = F.when(F.col("gid").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(vec_id), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col(vec_id) == F.col("component_id"), F.lit(False)))
