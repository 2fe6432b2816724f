"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere.

The collection is built column by column: each round puts one more symbol in
front of every string's suffix and updates the order of the suffixes (the
permuted column is that round's Burrows-Wheeler column) and the common
prefixes of neighbours. Whole texts would take as many rounds as the longest
has bytes, so the strings are the surroundings of content anchors
(``windows``): two equal windows meet at an anchor, in the same column, and a
round need only keep the newest suffixes. What tasks look up later lies in
the shared folder as sorted files that are written once, in order.

Steps, each a pass over the input without a shuffle of its texts:
1. anchors' hashes (whole surroundings; 116 bytes left or right) are dealt by
   hash; those that occur twice go to sorted files;
2. anchors whose halves meet other surroundings send their bytes to their
   group, where the columns are built; found windows go to sorted files;
3. every text looks up what covers it and drops those bytes.
Surroundings that repeat as a whole are known by two independent 64-bit
hashes. Groups of more than ``group_limit`` surroundings are instead resolved
by such hashes of every window in them, which are combined before they are
dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, windows
from .common import Shards

WINDOW = 200
SIDE = WINDOW - windows.GRAM  # most bytes of a window on one side of its anchor
HALF = SIDE // 2
SPAN = HALF + windows.GRAM  # bytes that two windows agree on at least, on one side and the anchor
WIDE = WINDOW + HALF  # surroundings of one half: columns
_U = np.uint64
_CTX, _HALF, _WINDOW, _COVER = range(4)


PIECE = 1 << 20
LAP = 1024


class _Text:
    """Anchors of some texts, or of one piece of a long text, with the hashes around them.

    Positions are those in ``data``; ``begin`` is the place of a piece in its
    text. Pieces overlap by ``LAP`` bytes and an anchor is used in the piece
    where its surroundings are whole, so every anchor comes once.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, key: tuple[np.ndarray, np.ndarray] | None = None, begin: int = 0, last: bool = True):
        self.begin, self.offsets = begin, offsets
        h = self.hashes = windows.Hashes(data)
        a, first, final = windows.anchors(data, h, offsets[:-1], offsets[1:], WINDOW)
        if key is not None:
            use = (a >= (LAP // 2 if begin else 0)) & (a < (len(data) if last else len(data) - LAP // 2))
            a, first, final = a[use], first[use], final[use]
        self.a, self.first, self.final = a, first, final
        self.row = np.searchsorted(offsets, a, side="right") - 1
        self.low, high = offsets[self.row], offsets[self.row + 1]
        self.start, self.end = np.maximum(a - SIDE, self.low), np.minimum(a + WINDOW, high)
        self.high = high
        # what is taken for equal without a look at the bytes is so by two independent hashes of 64 bits
        self.others = windows.Hashes(data, windows.OTHER)
        self.ctx, self.ctx_other = h.of(self.start, self.end), self.others.of(self.start, self.end)
        halves = [(np.maximum(a - HALF, 0), a + windows.GRAM, a - HALF >= self.low), (a, np.minimum(a + SPAN, len(data)), a + SPAN <= high)]
        self.halves = [((h.of(x, y) ^ _U(2 * i + 2)) & ~_U(1), ok) for i, (x, y, ok) in enumerate(halves)]
        #: A name for each text's content, and one for each anchor that only equal rows share.
        self.key, self.key_other = (x.of(offsets[:-1], offsets[1:]) for x in (h, self.others)) if key is None else key
        place = windows.mix((a - self.low + begin).astype(np.uint64) + _U(7))
        self.occ = (windows.mix(self.key[self.row] ^ windows.mix(ids[self.row] + _U(1)) ^ place) >> _U(32)).astype(np.uint32)

    def windows(self, side: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the anchors ``which``, all windows they are picked by that hold the half on ``side``: anchor and start."""
        edge = self.a[which] - HALF
        low = self.first[which] if side == 0 else np.maximum(self.first[which], edge + 1)
        high = np.minimum(self.final[which], edge) if side == 0 else self.final[which]
        n = np.maximum(high - low + 1, 0)
        anchor = np.repeat(which, n)
        return anchor, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[_Text]]]:
    """For each slice of rows: the rows, their bytes, where each begins, and the anchors."""
    for batch in batches:
        for part in common.slices(batch, "_text", PIECE):
            texts = common.texts_of(part, "_text").cast(pa.binary())
            size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            data = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
            ids = pc.fill_null(part.column("_id"), -1).to_numpy(zero_copy_only=False).astype(np.uint64)
            if len(data) <= 2 * PIECE:
                yield part, data, offsets, iter([_Text(data, offsets, ids)])
            else:
                yield part, data, offsets, _pieces(data, ids)


def _pieces(data: np.ndarray, ids: np.ndarray) -> Iterator[_Text]:
    key = tuple(np.array([xxhash.xxh64_intdigest(data, seed)], np.uint64) for seed in (7, 8))
    for begin in range(0, len(data) - LAP, PIECE):
        end = min(len(data), begin + PIECE + LAP)
        yield _Text(data[begin:end], np.array([0, end - begin]), ids, key, begin, end == len(data))


_COLUMNS = 4
_BLOBS = "shard int, b0 binary, b1 binary, b2 binary, b3 binary"
_DONE = "shard int, n long, most long"
_FLUSH = 1 << 20  # entries that a task gathers before it deals them


def _capped(keys: np.ndarray, other: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted pairs of hashes with companions, two entries of a pair at most: enough to tell that it repeats."""
    order = np.lexsort([*more[::-1], other, keys])
    keys, other, *more = (x[order] for x in (keys, other, *more))
    third = np.zeros(len(keys), bool)
    third[2:] = (keys[2:] == keys[:-2]) & (other[2:] == other[:-2])
    return keys[~third], other[~third], *(x[~third] for x in more)


def _distinct(keys: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, in order."""
    order = np.lexsort([other, keys])
    keys, other = keys[order], other[order]
    at, _count = _runs(keys, other)
    return keys[at], other[at]


def _deal_anchors(bits: int):
    def run(batches):
        held, n = [], 0

        def flush():
            ctx, other, occ, half, around = (np.concatenate(x) for x in zip(*held, strict=True))
            anchors = common.shard_rows(_CTX, bits, *_capped(ctx, other, occ))
            return common.blobs(anchors + common.shard_rows(_HALF, bits, *_distinct(half, around)), _COLUMNS)

        for _, _, _, texts in _texts(batches):
            for t in texts:
                half, around = (np.concatenate(x) for x in zip(*((h[ok], t.ctx[ok]) for h, ok in t.halves), strict=True))
                held.append((t.ctx, t.ctx_other, t.occ, half, around))
                n += len(t.ctx)
                if n > _FLUSH:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return run


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key (or tuple of keys) begins in sorted ones, and how often it comes."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, n))


def _save_repeats(folder: str, bits: int):
    def run(table: pa.Table) -> pa.Table:
        shard, n, most = table.column("shard")[0].as_py(), 0, 0
        keys = common.joined(table, "b0", np.uint64)
        kind = shard >> bits
        if kind == _CTX:
            other, occ = common.joined(table, "b1", np.uint64), common.joined(table, "b2", np.uint32)
            order = np.lexsort([occ, other, keys])
            keys, other, occ = keys[order], other[order], occ[order]
            at, count = _runs(keys, other)
            at = at[count > 1]
            common.save(folder, f"occ-{shard}", occ[at])
            common.save(folder, f"other-{shard}", other[at])
            common.save(folder, f"key-{shard}", keys[at])
            n = len(at)
        elif kind == _HALF:
            keys, _around = _distinct(keys, common.joined(table, "b1", np.uint64))
            at, count = _runs(keys)
            at, count = at[count > 1], count[count > 1]
            common.save(folder, f"size-{shard}", count.astype(np.uint32))
            common.save(folder, f"key-{shard}", keys[at])
            n, most = len(at), int(count.max(initial=0))
        elif kind == _WINDOW:
            other = common.joined(table, "b1", np.uint64)
            order = np.lexsort([other, keys])
            keys, other = keys[order], other[order]
            at, count = _runs(keys, other)
            common.save(folder, f"other-{shard}", other[at[count > 1]])
            common.save(folder, f"key-{shard}", keys[at[count > 1]])
        else:
            order = np.argsort(keys, kind="stable")
            for i, (name, kind) in enumerate((("other", np.uint64), ("start", np.int64), ("end", np.int64)), 1):
                common.save(folder, f"{name}-{shard}", common.joined(table, f"b{i}", kind)[order])
            common.save(folder, f"key-{shard}", keys[order])
            n = len(keys)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([n], pa.int64()), "most": pa.array([most], pa.int64())})

    return run


class _Known:
    """The sorted files as a task sees them."""

    def __init__(self, folder: str, bits: int, limit: int):
        self.ctx = Shards(folder, bits, _CTX, "key", "other", "occ")
        self.half = Shards(folder, bits, _HALF, "key", "size")
        self.window = Shards(folder, bits, _WINDOW, "key", "other")
        self.cover = Shards(folder, bits, _COVER, "key", "other", "start", "end")
        self.limit = limit

    @staticmethod
    def find(shards: Shards, keys: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs of hashes are there, and the last companion of each (0 where not)."""
        found, last = np.zeros(len(keys), bool), np.zeros(len(keys), np.uint32)
        order = np.argsort(keys)
        for part, (own, own_other, *more) in shards.ranges(keys[order]):
            mine = order[part]
            at = np.searchsorted(own, keys[mine])
            while len(mine):  # one step, but for different strings of one first hash
                inside = np.minimum(at, len(own) - 1)
                same = (at < len(own)) & (own[inside] == keys[mine])
                hit = same & (own_other[inside] == other[mine])
                found[mine[hit]] = True
                if more:
                    last[mine[hit]] = more[-1][inside[hit]]
                mine, at = mine[same & ~hit], at[same & ~hit] + 1
        return found, last

    def shared(self, t: _Text) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Which anchors repeat with all around them; which stand for their kind; per half its group's size, 0 if alone."""
        repeats, least = self.find(self.ctx, t.ctx, t.ctx_other)
        stands = ~repeats | (t.occ == least)
        return repeats, stands, [np.where(ok, self.half.find(h)[1][0], 0) for h, ok in t.halves]


_ROUNDS = "g long, ctx long, single boolean, key long, other long, first long, body binary"


def _surroundings(known: _Known):
    def run(batches):
        for _, data, _, texts in _texts(batches):
            for t in texts:
                repeats, stands, sizes = known.shared(t)
                for side, size in enumerate(sizes):
                    use = np.flatnonzero(stands & (size > 0) & (size <= known.limit))
                    if not len(use):
                        continue
                    first = t.a[use] - (SIDE if side == 0 else HALF)
                    low, high = np.maximum(first, t.low[use]), np.minimum(first + WIDE, t.high[use])
                    body = [data[x:y].tobytes() for x, y in zip((low + t.begin).tolist(), (high + t.begin).tolist(), strict=True)]
                    place = first - t.low[use] + t.begin  # negative: columns before the text
                    columns = [(t.halves[side][0][use] | _U(side)).view(np.int64), t.ctx[use].view(np.int64), ~repeats[use], *(k[t.row[use]].view(np.int64) for k in (t.key, t.key_other)), place, pa.array(body, pa.binary())]
                    for at in range(0, len(use), 20_000):
                        yield pa.RecordBatch.from_arrays([(x if isinstance(x, pa.Array) else pa.array(x)).slice(at, 20_000) for x in columns], ["g", "ctx", "single", "key", "other", "first", "body"])

    return run


def columns_shared(bodies: list[bytes], lead: np.ndarray, width: int, window: int) -> np.ndarray:
    """For aligned strings: which windows (by first column) another string holds in the same columns.

    ``lead``: empty columns before each string. From the last column to the
    first, each round puts a symbol in front of all suffixes, orders them
    stably by it, and takes a common prefix with the new neighbour from the
    least of those that lay between the two.
    """
    n = len(bodies)
    size = np.fromiter(map(len, bodies), np.int64, n)
    grid = np.full((n, width), 256, np.uint16)  # 256: no symbol, equal to none
    column = np.arange(width)
    grid[(column >= lead[:, None]) & (column < (lead + size)[:, None])] = np.frombuffer(b"".join(bodies), np.uint8)
    grid = np.ascontiguousarray(grid.T)
    order, common_prefix = np.arange(n), np.zeros(n + 1, np.int32)
    shared = np.zeros((n, width - window + 1), bool)
    for t in range(width - 1, -1, -1):
        symbol = grid[t][order]
        moved = np.argsort(symbol, kind="stable")
        symbol = symbol[moved]
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] < 256))
        after = np.zeros(n + 1, np.int32)
        if len(same):
            between = np.empty(2 * len(same), np.int64)
            between[::2], between[1::2] = moved[same] + 1, moved[same + 1] + 1
            after[same + 1] = np.minimum.reduceat(common_prefix, between)[::2] + 1
        order, common_prefix = order[moved], after
        if t < shared.shape[1]:
            long = common_prefix >= window
            shared[order, t] = long[:-1] | long[1:]
    return shared


def _compare(bits: int, most: int = 8_000):
    """Sorted by g: whole groups together, about ``most`` strings at a time; covers of the strings that stand alone."""

    def covers(rows: pa.Table) -> list[tuple[int, list[bytes]]]:
        # the two halves are aligned differently: a place of a text must not meet itself
        side = rows.column("g").to_numpy() & 1
        return [x for i in (0, 1) if (side == i).any() for x in one_side(rows.filter(pa.array(side == i)))]

    def one_side(rows: pa.Table) -> list[tuple[int, list[bytes]]]:
        ctx = rows.column("ctx").to_numpy()
        at = np.sort(np.unique(np.stack([ctx, rows.column("first").to_numpy(), rows.column("g").to_numpy()]), axis=1, return_index=True)[1])
        rows = rows.take(at)  # surroundings that equal rows sent more than once
        first = rows.column("first").to_numpy()
        shared = columns_shared(rows.column("body").to_pylist(), np.maximum(-first, 0), WIDE, WINDOW)
        shared &= rows.column("single").to_numpy(zero_copy_only=False)[:, None]
        edge = np.diff(np.pad(shared, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (row, start), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        key, other = (rows.column(c).to_numpy().view(np.uint64)[row] for c in ("key", "other"))
        order = np.argsort(key, kind="stable")
        return common.shard_rows(_COVER, bits, key[order], other[order], (first[row] + start)[order], (first[row] + end - 1 + WINDOW)[order])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            g = batch.column("g").to_numpy()
            held.append(batch)
            n += len(g)
            if n >= most and len(last := np.flatnonzero(g != g[-1])):
                stop = int(last[-1]) + 1
                done = covers(pa.Table.from_batches([*held[:-1], batch.slice(0, stop)]))
                held = [batch.slice(stop)]
                n = len(g) - stop
                if done:
                    yield common.blobs(done, _COLUMNS)
        if held and (done := covers(pa.Table.from_batches(held))):
            yield common.blobs(done, _COLUMNS)

    return run


def _deal_windows(known: _Known, bits: int):
    """Windows of the groups beyond the limit, by both hashes; a repeated surrounding counts as two."""

    def run(batches):
        for _, _, _, texts in _texts(batches):
            for t in texts:
                repeats, stands, sizes = known.shared(t)
                found = []
                for side, size in enumerate(sizes):
                    anchor, start = t.windows(side, np.flatnonzero(stands & (size > known.limit)))
                    h = [x.of(start, start + WINDOW) for x in (t.hashes, t.others)]
                    found += [h, [x[repeats[anchor]] for x in h]]
                keys = _capped(*(np.concatenate(x) for x in zip(*found, strict=True)))
                if len(keys[0]):
                    yield common.blobs(common.shard_rows(_WINDOW, bits, *keys), _COLUMNS)

    return run


def _covers_of(known: _Known, key: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with their covers from the column rounds: row, start, end in the row's text."""
    order = np.argsort(key)
    for part, (own, own_other, start, end) in known.cover.ranges(key[order]):
        q, row = key[order[part]], order[part]
        low, n = np.searchsorted(own, q), np.searchsorted(own, q, side="right") - np.searchsorted(own, q)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        rows = np.repeat(row, n)
        mine = own_other[at] == other[rows]
        yield rows[mine], start[at[mine]], end[at[mine]]


def _drop(known: _Known, names: list[str]):
    def run(batches):
        for part, data, offsets, texts in _texts(batches):
            change = np.zeros(len(data) + 1, np.int32)
            for t in texts:
                repeats, _, sizes = known.shared(t)
                use = np.flatnonzero(repeats & (t.end - t.start >= WINDOW))
                found = [(t.start[use], t.end[use])]
                for side, size in enumerate(sizes):
                    _, start = t.windows(side, np.flatnonzero(size > known.limit))
                    start = start[known.find(known.window, *(x.of(start, start + WINDOW) for x in (t.hashes, t.others)))[0]]
                    found.append((start, start + WINDOW))
                for start, end in found:
                    np.add.at(change, start + t.begin, 1)
                    np.add.at(change, end + t.begin, -1)
                key = t.key, t.key_other
            for row, start, end in _covers_of(known, *key):
                np.add.at(change, offsets[row] + start, 1)
                np.add.at(change, offsets[row] + end, -1)
            gone = np.cumsum(change[:-1]) > 0
            removed = np.concatenate([[0], np.cumsum(gone)])[offsets]
            kept = data[~gone]
            kept_offsets = (offsets - removed).astype(np.int32)
            border = np.zeros(len(data) + 1, bool)
            border[offsets] = True
            starts = np.flatnonzero(gone & (border[:-1] | ~np.concatenate([[False], gone[:-1]])))
            ends = np.flatnonzero(gone & (border[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
            row = np.searchsorted(offsets, starts, side="right") - 1
            spans = pa.StructArray.from_arrays([pa.array(starts - offsets[row]), pa.array(ends - offsets[row])], ["start", "end"])
            split = np.searchsorted(starts, offsets).astype(np.int32)
            added = [
                pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(kept_offsets), pa.py_buffer(kept)]),
                pa.ListArray.from_arrays(pa.array(split), spans),
                pa.array(np.diff(offsets)),
            ]
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(names))] + added, [*names, "_kept", "_spans", "_bytes"])

    return run


def drop_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", group_limit: int = 20_000) -> DataFrame:
    """Every column of ``docs`` plus ``_kept`` binary, ``_spans`` array<struct<start,end>>, ``_bytes`` long.

    A byte of a text (as UTF-8) goes if a string of ``WINDOW`` bytes that
    covers it also starts anywhere else in the input, the same text included;
    all is judged on the input. Spans are maximal removed runs, in bytes.

    Null text counts as empty and is kept so. Texts under ``WINDOW`` bytes
    keep all. Equal rows repeat each other: both lose their long text.
    ``doc_id`` may be null or repeat. Input columns ``_id``, ``_text``, ``_kept``,
    ``_spans``, ``_bytes`` clash and are refused. An empty table gives an
    empty table. Texts may be longer than memory for hashes: they are worked
    in overlapping pieces, but each text itself is held once.
    """
    spark = common.ship(docs.sparkSession)
    names = docs.columns
    if clash := {"_id", "_text", "_kept", "_spans", "_bytes"} & set(names):
        raise ValueError(f"reserved column names: {sorted(clash)}")
    texts = docs.select(F.col(text).alias("_text"), F.col(doc_id).cast("long").alias("_id"))
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    bits = common.bits_for(size, 32 << 20)
    folder = common.shared_folder(spark, "suffix")
    known = _Known(folder, bits, group_limit)

    def save(rows: DataFrame) -> int:
        done = rows.groupBy("shard").applyInArrow(_save_repeats(folder, bits), _DONE)
        return done.agg(F.max("most")).first()[0] or 0

    largest = save(texts.mapInArrow(_deal_anchors(bits), _BLOBS))
    if largest > group_limit:
        save(texts.mapInArrow(_deal_windows(known, bits), _BLOBS))
    rows = texts.mapInArrow(_surroundings(known), _ROUNDS)
    save(rows.repartition(1 << bits, "g").sortWithinPartitions("g").mapInArrow(_compare(bits), _BLOBS))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    inner = docs.select("*", F.col(text).alias("_text"), F.col(doc_id).cast("long").alias("_id"))
    return inner.mapInArrow(_drop(known, names), f"{fields}, _kept binary, _spans array<struct<start:long,end:long>>, _bytes long")
