"""SimHash near-dedup: fingerprints of word shingles, linked by generalised pigeonhole.

Bits that vary together are put into one partition each; how many partitions
there are is chosen by what all fingerprints together would cost. For every
fingerprint a dynamic program deals a threshold to each partition by the
candidates it is estimated to bring, so that two fingerprints within the
distance agree, in one partition at least, up to that threshold. The exact
values of all fingerprints are the index; a fingerprint probes it with all
values within its thresholds, and candidates are verified by their bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 64
SEED = 42
_U = np.uint64
_COARSE = 12  # leading bits of a partition's value that its histogram tells apart
PARTS = (2, 3, 4, 5)  # numbers of partitions to choose from: few make many probes, many bring many candidates
_PROBE_COST = 4.0  # of dealing one probe, in candidates verified
_PAIRS = 1 << 20  # candidates verified in one numpy step


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of the shingles of a lower-cased text; 0 if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(words) - shingle + 1)
    h = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        j = min(n, i + (1 << 16))
        last = np.minimum(np.arange(i, j) + shingle, len(words)) - 1
        hashes = np.array([h(line[a:b], SEED) for a, b in zip(start[i:j].tolist(), end[last].tolist(), strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(names: list[str], shingle: int):
    def run(batches):
        for batch in batches:
            texts = common.texts_of(batch, "_text").cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found.view(np.int64))], [*names, "_fingerprint"])
        common.release()

    return run


def with_fingerprint(docs: DataFrame, text: str, keep: list[str], shingle: int) -> DataFrame:
    """Columns ``keep`` and ``_fingerprint`` (its 64 bits as a long); null text counts as empty."""
    common.ship(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    rows = docs.select(*keep, F.col(text).alias("_text"))
    return rows.mapInArrow(_fingerprints(keep, shingle), f"{fields}, _fingerprint long")


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _bit_counts(batches):
    both, n = np.zeros((BITS, BITS), np.int64), 0
    for batch in batches:
        fp = _column(batch, "fp").astype("<i8")
        bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        both += (bits.T @ bits).astype(np.int64)
        n += len(fp)
    if n:
        i, j = np.indices((BITS, BITS))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(both.ravel())], ["i", "j", "n"])


def group_bits(both: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """Partitions of the bits, as even as can be, each grown by the bit that varies most with those in it."""
    p = np.diag(both) / max(1, total)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    together = np.abs((both / max(1, total) - np.outer(p, p)) / np.outer(spread, spread))
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = (BITS + parts - 1 - k) // parts
        inner = together[np.ix_(free, free)].sum(axis=1)
        group = [free.pop(int(np.argmax(inner)))]
        while len(group) < size:
            group.append(free.pop(int(np.argmax(together[np.ix_(free, group)].sum(axis=1)))))
        groups.append(sorted(group))
    return groups


def part_values(fp: np.ndarray, groups: list[list[int]]) -> list[np.ndarray]:
    return [sum((((fp >> _U(b)) & _U(1)) << _U(i) for i, b in enumerate(g)), np.zeros(len(fp), np.uint64)) for g in groups]


def _coarse(value: np.ndarray, width: int) -> np.ndarray:
    return (value >> _U(max(0, width - _COARSE))).astype(np.int64)


def _histogram(groups: list[list[int]]):
    def run(batches):
        counts = [np.zeros(1 << min(_COARSE, len(g)), np.int64) for g in groups]
        for batch in batches:
            for c, g, v in zip(counts, groups, part_values(_column(batch, "fp").view(np.uint64), groups), strict=True):
                c += np.bincount(_coarse(v, len(g)), minlength=len(c))
        for k, c in enumerate(counts):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(c[at])], ["i", "j", "n"])

    return run


def balls(width: int, radius: int) -> np.ndarray:
    """All values of at most ``radius`` of ``width`` bits, fewest bits first."""
    return np.array([sum(1 << b for b in c) for r in range(min(radius, width) + 1) for c in combinations(range(width), r)], np.uint64)


def deal_thresholds(value: list[np.ndarray], widths: list[int], counts: list[np.ndarray], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Per fingerprint and partition a threshold from -1 (not probed), together distance - parts + 1, of least cost; and that cost.

    Cost: the probes made, and the candidates estimated for them from the
    histogram of each partition's leading bits.
    """
    n, parts = len(value[0]), len(widths)
    budget = distance + 1  # shared out as threshold + 1
    best = np.full((n, budget + 1), np.inf)
    best[:, 0] = 0
    choice = []
    for v, w, c in zip(value, widths, counts, strict=True):
        size = np.concatenate([[0], np.cumsum([len(balls(w, 0)) if r == 0 else _choose(w, r) for r in range(distance + 1)])]).astype(float)
        near = c[_coarse(v, w)] / 2.0 ** max(0, w - _COARSE)
        cost = size[None, : budget + 1] * (_PROBE_COST + near[:, None])
        total = np.full((n, budget + 1), np.inf)
        took = np.zeros((n, budget + 1), np.int8)
        for share in range(budget + 1):
            new = best[:, : budget + 1 - share] + cost[:, share : share + 1]
            better = new < total[:, share:]
            total[:, share:] = np.where(better, new, total[:, share:])
            took[:, share:] = np.where(better, share, took[:, share:])
        best = total
        choice.append(took)
    left, out = np.full(n, budget), np.empty((n, parts), np.int8)
    for k in range(parts - 1, -1, -1):
        share = choice[k][np.arange(n), left]
        out[:, k] = share - 1
        left = left - share
    return out, best[:, budget]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _costs(options: list[list[list[int]]], counts: list[list[np.ndarray]], distance: int):
    """Per task and option what its fingerprints cost."""

    def run(batches):
        total = np.zeros(len(options))
        for batch in batches:
            fp = _column(batch, "fp").view(np.uint64)
            for k, groups in enumerate(options):
                total[k] += deal_thresholds(part_values(fp, groups), [len(g) for g in groups], counts[k], distance)[1].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(options))), pa.array(total)], ["i", "x"])

    return run


def choose_partitions(distinct: DataFrame, distance: int, parts: tuple[int, ...] = PARTS) -> tuple[list[list[int]], list[np.ndarray]]:
    """The partitions of the bits that all fingerprints together cost least with, and the histogram of each.

    Three passes over the distinct fingerprints: how bits vary together, the
    histograms of every option, the least cost of every option. The driver gets
    64 squared numbers, 4,096 for each partition of an option, and one for each option.
    """
    rows = distinct.mapInArrow(_bit_counts, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((BITS, BITS))
    for r in rows:
        both[r.i, r.j] = r.n
    total = distinct.count()
    options = [group_bits(both, total, n) for n in parts]
    flat = [g for groups in options for g in groups]
    found = [np.zeros(1 << min(_COARSE, len(g))) for g in flat]
    for r in distinct.mapInArrow(_histogram(flat), "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        found[r.i][r.j] = r.n
    left = iter(found)
    counts = [[next(left) for _ in groups] for groups in options]
    cost = {r.i: r.x for r in distinct.mapInArrow(_costs(options, counts, distance), "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}
    best = min(range(len(options)), key=lambda k: cost.get(k, 0.0))
    return options[best], counts[best]


def _entries(groups: list[list[int]], counts: list[np.ndarray], distance: int):
    """Index and probe entries ``(key, fp, probe)`` of each fingerprint; key: partition and value."""
    widths = [len(g) for g in groups]

    def out(key: np.ndarray, fp: np.ndarray, probe: bool) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(key), 200_000):
            k = key[at : at + 200_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fp[at : at + 200_000].view(np.int64)), pa.array(np.full(len(k), probe))], ["key", "fp", "probe"])

    def run(batches):
        for batch in batches:
            fp = _column(batch, "fp").view(np.uint64)
            value = part_values(fp, groups)
            threshold, _cost = deal_thresholds(value, widths, counts, distance)
            for k, (v, w) in enumerate(zip(value, widths, strict=True)):
                head = _U(k) << _U(58)
                yield from out(head | v, fp, False)
                for t in np.unique(threshold[:, k]):
                    if t >= 0:
                        mask, use = balls(w, int(t)), threshold[:, k] == t
                        step = max(1, 1_000_000 // len(mask))
                        for at in range(0, use.sum(), step):
                            q = v[use][at : at + step]
                            yield from out((head | (q[:, None] ^ mask[None, :])).ravel(), np.repeat(fp[use][at : at + step], len(mask)), True)

    return run


def _verify(distance: int):
    """Rows sorted by cell: links that join what is within the distance, at most one for each fingerprint and step."""

    def links(cell: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.concatenate([[True], (cell[1:] != cell[:-1]).any(axis=1)])
        group = np.cumsum(new) - 1
        held = np.bincount(group[~probe], minlength=group[-1] + 1)
        first = np.concatenate([[0], np.cumsum(held)])
        index = fp[~probe]
        q, n, at = fp[probe], held[group[probe]], first[group[probe]]
        use = n > 0
        q, n, at = q[use], n[use], at[use]
        upto = np.cumsum(n)
        i = 0
        while i < len(q):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + _PAIRS, side="right")))
            m = n[i:j]
            place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(at[i:j], m)
            a, b = np.repeat(q[i:j], m), index[place]
            near = (np.bitwise_count(a ^ b) <= distance) & (a != b)
            if near.any():
                x, y = common.contract(a[near].view(np.int64), b[near].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
            i = j

    def run(batches):
        held: list[pa.RecordBatch] = []
        n = 0

        def done(rows: list[pa.RecordBatch]):
            t = pa.Table.from_batches(rows)
            cell = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            return links(cell, t.column("fp").to_numpy().view(np.uint64), t.column("probe").to_numpy())

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 200_000:
                cell = np.stack([_column(batch, c) for c in ("key", "i", "j")], axis=1)
                other = np.flatnonzero((cell != cell[-1]).any(axis=1))
                if len(other):
                    stop = int(other[-1]) + 1
                    yield from done([*held[:-1], batch.slice(0, stop)])
                    held, n = [batch.slice(stop)], batch.num_rows - stop
        if held:
            yield from done(held)

    return run


def link(distinct: DataFrame, distance: int, parts: tuple[int, ...] = PARTS, cell: int = 4_000) -> DataFrame:
    """Links ``(a, b)`` that connect all of the distinct ``fp`` longs within ``distance`` bits of each other.

    Not every pair is returned: in each step of the comparison, links that
    already follow from others are left out. A key with more than ``cell``
    index entries becomes a grid of cells, each compared in its own group.
    """
    groups, counts = choose_partitions(distinct, distance, parts)
    entries = distinct.mapInArrow(_entries(groups, counts, distance), "key long, fp long, probe boolean")
    index = distinct.mapInArrow(_entries_index(groups), "key long")
    hot = index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cell)
    hot = hot.select("key", F.ceil(F.col("n") / cell).cast("int").alias("t"))
    tiles = F.sequence(F.lit(0), F.col("t") - 1)
    own = F.array(F.pmod(F.xxhash64("fp"), F.col("t")).cast("int"))
    spread = entries.join(hot, "key", "left").withColumn("t", F.coalesce("t", F.lit(1)))
    spread = spread.select("key", "fp", "probe", F.when(F.col("probe"), tiles).otherwise(own).alias("is"), F.when(F.col("probe"), own).otherwise(tiles).alias("js"))
    cells = spread.select("key", "fp", "probe", F.explode("is").alias("i"), "js").select("key", "fp", "probe", "i", F.explode("js").alias("j"))
    cells = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return cells.mapInArrow(_verify(distance), "a long, b long")


def _entries_index(groups: list[list[int]]):
    def run(batches):
        for batch in batches:
            for k, v in enumerate(part_values(_column(batch, "fp").view(np.uint64), groups)):
                yield pa.RecordBatch.from_arrays([pa.array(((_U(k) << _U(58)) | v).view(np.int64))], ["key"])

    return run


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, distance: int = 4, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``keep`` (by default the id), ``_fingerprint`` long, ``_component`` and ``_root``.

    ``_component`` is the smallest id reachable by links between fingerprints
    of at most ``distance`` differing bits; ``_root``, the smallest fingerprint
    reachable, tells classes apart whatever their ids are. Equal fingerprints are one node,
    so copies cost one row each. Null text counts as empty; texts without a
    word have fingerprint 0 and are linked like any other. Rows with a null
    id are kept; a class of nothing but null ids has a null component. Equal
    rows stay equal rows. An empty table gives an empty table. Columns that
    are not kept don't matter; a kept one named like an added one, or ``_text``,
    is refused.
    """
    keep = keep or [doc_id]
    if clash := {"_fingerprint", "_component", "_root", "_text", "fp", "least", "root"} & set(keep):
        raise ValueError(f"reserved column names: {sorted(clash)}")
    marked = common.cut(with_fingerprint(docs, text, keep, shingle), "fingerprints")
    distinct = common.cut(marked.groupBy(F.col("_fingerprint").alias("fp")).agg(F.min(doc_id).alias("least")), "distinct")
    roots = common.components(link(distinct.select("fp"), distance))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("_component"))
    classes = named.select("fp", "root").join(ids, "root").select(F.col("fp").alias("_fingerprint"), "_component", F.col("root").alias("_root"))
    return marked.join(classes, "_fingerprint", "left")
