"""Best-fit packing: token pieces into sequences, planned on the histogram of their lengths.

The plan never sees a document: best-fit decreasing runs over how many pieces
there are of each length, and says which ranks of a length go to which
sequences, at which offset. Pieces then take their slots by their rank within
their length.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

_CACHE_WORDS = 500_000
_LINE = 50  # words encoded as one text: longer ones cost more a word
_BETWEEN = "\x01"  # stands between words that are encoded together
_OPEN: dict[str, Tokenizer] = {}


class Tokenizer:
    """Ids of whole texts by a ``tokenizers`` file that drops white space, word by word.

    Such a tokenizer cuts at white space before it merges, so a text's ids
    are its words' ids in order, and each distinct word is encoded once while
    a worker remembers it. Words are encoded many at a time, with a sign
    between them to tell their ids apart; words that hold the sign or a
    special token are encoded alone. Where the tokenizer lower-cases, words
    are told apart by their lower-case form, unless that holds a special token.
    """

    def __init__(self, path: str):
        self.encoder = tokenizers.Tokenizer.from_file(path)
        sign = self.encoder.encode(_BETWEEN, add_special_tokens=False).ids
        self.between = sign[0] if len(sign) == 1 else None
        self.odd = [x.encode() for x in (_BETWEEN, *(t.content for t in self.encoder.get_added_tokens_decoder().values()))]
        normalizer = json.loads(self.encoder.to_str())["normalizer"] or {}
        self.lower = any(n["type"] == "Lowercase" for n in normalizer.get("normalizers", [normalizer]) if n)
        self.forget()

    @staticmethod
    def open(path: str) -> Tokenizer:
        if path not in _OPEN:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            _OPEN[path] = Tokenizer(path)
        return _OPEN[path]

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table, self.size = np.empty(0, "<u4"), np.empty(0, np.int64)
        self.used = np.empty(0, bool)  # of the known words: needed since the last time that some were forgotten

    def forget_unused(self) -> None:
        """Keeps the words that were needed lately, half as many as may be known at most."""
        kept = np.flatnonzero(self.used)[: _CACHE_WORDS // 2]
        place = np.full(len(self.size), -1)
        place[kept] = np.arange(len(kept))
        start, size = (np.cumsum(self.size) - self.size)[kept], self.size[kept]
        self.known = {w: place[i] for w, i in self.known.items() if place[i] >= 0}
        self.table = self.table[np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)]
        self.size, self.used = size, np.zeros(len(kept), bool)

    def learn(self, words: list[bytes]) -> None:
        tables, sizes = [self.table], [self.size]
        whole = b" ".join(words)
        if self.between is None:
            plain, alone = [], words
        elif any(x in whole for x in self.odd):
            plain, alone = [w for w in words if not any(x in w for x in self.odd)], [w for w in words if any(x in w for x in self.odd)]
        else:
            plain, alone = words, []
        for i in range(0, len(plain), _LINE):
            line = f" {_BETWEEN} ".encode().join(plain[i : i + _LINE]).decode()
            flat = np.array(self.encoder.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            signs = np.flatnonzero(flat == self.between)
            tables.append(flat[flat != self.between])
            sizes.append(np.diff(np.concatenate([[-1], signs, [len(flat)]])) - 1)
        for w in alone:
            tables.append(np.array(self.encoder.encode(w.decode(), add_special_tokens=False).ids, "<u4"))
            sizes.append(np.array([len(tables[-1])]))
        self.known.update(zip([*plain, *alone], range(len(self.size), len(self.size) + len(words)), strict=True))
        self.table, self.size = np.concatenate(tables), np.concatenate(sizes)
        self.used = np.concatenate([self.used, np.zeros(len(words), bool)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin; the end is at the last place."""
        words = common.Words(texts, lower=self.lower)
        if self.lower and any(x in b" ".join(words.words) for x in self.odd):
            words = common.Words(texts, lower=False)
        if new := [w for w in words.words if w not in self.known]:
            if len(self.known) + len(new) > _CACHE_WORDS:
                self.forget_unused()
                new = [w for w in words.words if w not in self.known]
            self.learn(new)
        start = np.cumsum(self.size) - self.size
        word = np.fromiter(map(self.known.__getitem__, words.words), np.int64, len(words.words))
        self.used[word] = True
        n, first = self.size[word][words.codes], start[word][words.codes]
        total = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(total[-1]) + np.repeat(first - total[:-1], n)
        return self.table[at], total[np.concatenate([[0], np.cumsum(words.counts)])]


def _pieces(path: str, names: list[str], most: int, separator: int, with_ids: bool):
    def run(batches):
        tokenizer = Tokenizer.open(path)
        for batch in batches:
            for part in common.slices(batch, "_text"):
                ids, offsets = tokenizer.encode(common.texts_of(part, "_text"))
                row, piece, start, length, crc, own = [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
                    doc = np.append(ids[a:b], np.uint32(separator)).astype("<u4")
                    for j, s in enumerate(range(0, len(doc), most)):
                        x = doc[s : s + most]
                        row.append(i)
                        piece.append(j)
                        start.append(s)
                        length.append(len(x))
                        crc.append(zlib.crc32(x))
                        if with_ids:
                            own.append(x.view("<i4"))
                kept = pa.RecordBatch.from_arrays([part.column(n) for n in names], names).take(pa.array(row, pa.int64()))
                columns = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
                more = ["_piece", "_start", "_length", "_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(np.concatenate(own))))
                    more.append("_ids")
                yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*names, *more])

    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows ``(length, first rank, end rank, first sequence, offset)``.

    Sequences that hold the same lengths are one run of numbers with a count;
    placing k pieces in such a run splits it in two at most. Longest first,
    each piece goes to the sequence with the least room that fits it.
    """
    out: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # ascending: rooms with an open run
    runs: dict[int, list[tuple[int, int]]] = {}  # room: heap of (first sequence, how many)
    sequences = 0

    def put(room: int, first: int, n: int) -> None:
        if room not in runs:
            runs[room] = []
            insort(rooms, room)
        heapq.heappush(runs[room], (first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # open as many as still needed, each filled with as many as fit
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            else:
                room = rooms[at]
                first, n = heapq.heappop(runs[room])
                if not runs[room]:
                    del runs[room], rooms[at]
            k = min(n, left)
            out.append((length, rank, rank + k, first, capacity - room))
            rank, left = rank + k, left - k
            if room > length:
                put(room - length, first, k)
            if n > k:
                put(room, first + k, n - k)
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    keep: list[str] | None = None,
    capacity: int = 2048,
    separator: int = 0,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: columns ``keep`` (by default all but the text), ``_piece``, ``_start``, ``_length``, ``_crc32``
    of its ids as little-endian 32-bit, ``_ids`` if asked for, ``_sequence`` and ``_offset`` in it.

    A document is its ids and ``separator``; one longer than ``capacity`` is
    cut into pieces of that length and a rest. Null or empty text is the
    separator alone. Equal rows are packed each. Extra columns may have any
    name but those above. No rows give no rows. ``tokenizer``: path of a
    ``tokenizers`` file whose pre-tokenizer drops white space.
    """
    spark = common.ship(docs.sparkSession)
    names = keep if keep is not None else [c for c in docs.columns if c != text]
    added = {"_piece", "_start", "_length", "_crc32", "_ids", "_sequence", "_offset", "_text", "_deal", "_rank"}
    if clash := added & set(names):
        raise ValueError(f"reserved column names: {sorted(clash)}")
    kept = docs.select(*names)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields)
    schema = f"{fields}_piece int, _start long, _length int, _crc32 long" + ", _ids array<int>" * with_ids
    pieces = docs.select(*names, F.col(text).alias("_text")).mapInArrow(_pieces(tokenizer, names, capacity, separator, with_ids), schema)
    # A length's pieces are dealt to many groups, ranked in each, and a group's first rank follows from the counts.
    order = [c for c in (*names, "_piece", "_start", "_crc32")]
    pieces = common.cut(pieces.withColumn("_deal", F.pmod(F.xxhash64(*order), F.lit(_deals(spark))).cast("int")), "pieces")
    counts = pieces.groupBy("_length", "_deal").agg(F.count("*").alias("n")).cache()
    histogram = {r._length: r.n for r in counts.groupBy("_length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    before = Window.partitionBy("_length").orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_length", "_deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inner = Window.partitionBy("_length", "_deal").orderBy(*order)
    ranked = pieces.withColumn("_rank", F.row_number().over(inner) - 1).join(firsts, ["_length", "_deal"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("first"))
    slots = plan(histogram, capacity)
    slot = "s_length int, s_first long, s_end long, s_sequence long, s_offset int"
    table = spark.createDataFrame(pa.Table.from_arrays([pa.array(c) for c in zip(*slots, strict=True)], ["l", "f", "e", "s", "o"]).to_pandas(), slot) if slots else spark.createDataFrame([], slot)
    # The plan's size follows from the capacity, not the input: a few rows for each length and room left.
    table = F.broadcast(table) if len(slots) <= 100_000 else table
    at = (F.col("_length") == F.col("s_length")) & (F.col("_rank") >= F.col("s_first")) & (F.col("_rank") < F.col("s_end"))
    placed = ranked.join(table, at)
    return placed.select(
        *names, "_piece", "_start", "_length", "_crc32", *["_ids"] * with_ids,
        (F.col("s_sequence") + F.col("_rank") - F.col("s_first")).alias("_sequence"), F.col("s_offset").cast("long").alias("_offset"),
    )


def _deals(spark) -> int:
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
