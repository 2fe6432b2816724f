"""Helpers shared by the operators: slices of text, shared arrays, written tables, components."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callroute.session import scratch_path

SLICE_BYTES = 4 << 20  # text that one numpy step holds


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, if it isn't installed there."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark


def cut(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: computed once, and it survives lost executors.

    ``options`` as of the writer.
    """
    path = f"{scratch_path(df.sparkSession, name)}/table"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that every worker can open by path, below ``spark.checkpoint.dir``.

    Memory-mapped arrays need a mounted shared file system there.
    """
    path = scratch_path(spark, name)
    if "://" in path:
        raise ValueError(f"memory-mapped arrays need spark.checkpoint.dir on a mounted file system, not {path}")
    return path


def bits_for(count: float, each: float) -> int:
    """Leading hash bits that deal ``count`` entries into shards of about ``each``, 16 shards at least."""
    return max(4, int(np.ceil(np.log2(max(1.0, count / each)))))


def shard_rows(kind: int, bits: int, keys: np.ndarray, *more: np.ndarray) -> list[tuple[int, list[bytes]]]:
    """Sorted keys and their companions as one row of buffers for each shard, by the keys' leading bits."""
    at = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
    edges = [0, *at, len(keys)]
    return [
        ((kind << bits) + i, [x[a:b].tobytes() for x in (keys, *more)])
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
        if b > a
    ]


def blobs(rows: list[tuple[int, list[bytes]]], columns: int) -> pa.RecordBatch:
    arrays = [pa.array([r[0] for r in rows], pa.int32())]
    arrays += [pa.array([r[1][i] if i < len(r[1]) else b"" for r in rows], pa.binary()) for i in range(columns)]
    return pa.RecordBatch.from_arrays(arrays, ["shard", *(f"b{i}" for i in range(columns))])


def joined(table: pa.Table, column: str, dtype) -> np.ndarray:
    """All buffers of one column, one after the other."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in table.column(column) if len(x.as_buffer())]
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Put an array in place in one step; a repeated task writes the same bytes again."""
    part = f"{folder}/.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, f"{folder}/{name}.npy")


class Shards:
    """Sorted arrays of 64-bit keys with companions in a shared folder, memory-mapped where looked up.

    A worker maps at most ``OPEN`` shards at a time: a process has a limited
    number of mappings, and those least lately used go.
    """

    OPEN = 4_096

    def __init__(self, folder: str, bits: int, kind: int, *names: str):
        self.folder, self.bits, self.kind, self.names = folder, bits, kind, names
        self.open: dict[int, list] = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def shard(self, i: int) -> list:
        if i in self.open:
            self.open[i] = self.open.pop(i)  # the last one used comes last
        else:
            if len(self.open) >= self.OPEN:
                del self.open[next(iter(self.open))]
            paths = [f"{self.folder}/{n}-{(self.kind << self.bits) + i}.npy" for n in self.names]
            self.open[i] = [np.load(p, mmap_mode="r") for p in paths] if os.path.exists(paths[0]) else []
        return self.open[i]

    def ranges(self, keys: np.ndarray) -> Iterator[tuple[slice, list]]:
        """For sorted keys: the slice of them in each shard, and that shard's arrays."""
        at = np.searchsorted(keys, np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        edges = [0, *at.tolist(), len(keys)]
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if b > a and (arrays := self.shard(i)) and len(arrays[0]):
                yield slice(a, b), arrays

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For keys in any order: which are there, and their companions (0 where not)."""
        order = np.argsort(keys)
        found = np.zeros(len(keys), bool)
        more: list[np.ndarray | None] = [None] * (len(self.names) - 1)
        sorted_keys = keys[order]
        for part, (own, *rest) in self.ranges(sorted_keys):
            q = sorted_keys[part]
            at = np.minimum(np.searchsorted(own, q), len(own) - 1)
            hit = own[at] == q
            found[order[part]] = hit
            for j, x in enumerate(rest):
                if more[j] is None:
                    more[j] = np.zeros(len(keys), x.dtype)
                more[j][order[part]] = np.where(hit, x[at], 0)
        return found, [np.zeros(len(keys), np.int64) if x is None else x for x in more]


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(column).cast(pa.string()), "")


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def release() -> None:
    """Give back what a worker no longer uses: it lives on for other tasks and operators, beside its executor."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows holding about ``most`` bytes of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + most, side="right")))
        yield batch.slice(start, end - start)
        start = end
    release()


def hashes(strings: list[bytes], seed: int) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(x, seed) for x in strings), np.uint64, len(strings))


class Words:
    """Tokens of some texts between ASCII white space: codes into distinct words, and the row of each."""

    def __init__(self, texts: pa.Array, lower: bool):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.dictionary_encode(lists.flatten())
        codes = coded.indices.to_numpy(zero_copy_only=False)
        self.words = coded.dictionary.cast(pa.binary()).to_pylist()
        rows = np.repeat(np.arange(len(texts)), counts)
        if b"" in self.words:  # text begins or ends with white space
            real = codes != self.words.index(b"")
            codes, rows = codes[real], rows[real]
        self.codes, self.rows = codes, rows
        self.counts = np.bincount(rows, minlength=len(texts))

    def hashes(self, seed: int = 0) -> np.ndarray:
        return hashes(self.words, seed)


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join the same nodes as the links (a, b), one for each node but the roots.

    A root is the smallest node of its component.
    """
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        apart = px != py
        if not apart.any():
            break
        low, high = np.minimum(px, py)[apart], np.maximum(px, py)[apart]
        np.minimum.at(parent, high, low)
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    below = parent != np.arange(len(nodes))
    return nodes[below], nodes[parent[below]]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links ``(a, b)`` of longs: rows ``(node, root)``, root the smallest node.

    Alternating large and small stars: every round links each node's larger
    neighbours, then its smaller ones, to the smallest; a round is a grouped
    minimum and a join, written to the shared folder. Nodes are only those in
    links. No links give no rows.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))
        links = cut(small.distinct(), "links")
        after = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
