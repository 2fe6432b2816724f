"""Benchmark decontamination by a distributed positional inverted index.

``build`` turns texts into segments of some MB. A segment holds, for each of
its words, the ascending positions at which the word stands, counted through
the segment's texts with a gap between two texts. A frequent word thus has one
bounded list a segment, and nothing is shuffled to build the index. It is a
table: rows of a word, and rows of a text with its number of words.

``find`` takes phrases (windows of test words). The index gives each test
word's count over the whole corpus; a window starts from the list of its
rarest word, adjusted by the word's offset, and is intersected with the
adjusted lists of the others, rarest first, until nothing is left. With
``span`` the words may stand anywhere within so many consecutive words.
Only the lists of test words leave the index, to meet by segment.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10  # words
SEGMENT_BYTES = 8 << 20  # text of a segment (one text at least)
BLOCK_WORDS = 1 << 21  # test words that are looked up in one pass over the index
_PIECE = 1 << 16  # words of an item that are one row
_GAP = 1
_WORD = np.full(256, 0x20, np.uint8)  # what is no word byte becomes a space, A-Z become a-z
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _WORD[_low : _high + 1] = np.arange(_low, _high + 1)
_WORD[0x41:0x5B] = np.arange(0x61, 0x7B)


def words_of(texts: pa.Array) -> common.Words:
    """Words of digits, lower-cased letters and characters beyond ASCII."""
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return common.Words(texts, lower=False)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    plain = _WORD[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]]
    buffers = [None, pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(plain)]
    return common.Words(pa.StringArray.from_buffers(len(texts), buffers[1], buffers[2]), lower=False)


# ---------------------------------------------------------------------------
# the index


def _index(keep: list[str], segment_bytes: int):
    def run(batches):
        task, serial = TaskContext.get().partitionId(), 0
        names = ["segment", "word", "n", "positions", "doc", "first", *keep]
        for batch in batches:
            types = [batch.schema.field(c).type for c in keep]
            for part in common.slices(batch, "_index_text", segment_bytes):
                segment, serial = (task << 32) + serial, serial + 1
                words = words_of(common.texts_of(part, "_index_text"))
                first = np.concatenate([[0], np.cumsum(words.counts + _GAP)[:-1]])
                begin = np.cumsum(words.counts) - words.counts
                position = (np.arange(len(words.codes)) - begin[words.rows] + first[words.rows]).astype(np.int32)
                rows = part.num_rows
                none = [pa.nulls(rows, pa.string()), pa.array(words.counts, pa.int32()), pa.nulls(rows, pa.list_(pa.int32()))]
                docs = [pa.array(np.full(rows, segment)), *none, pa.array(np.arange(rows), pa.int32()), pa.array(first, pa.int32())]
                yield pa.RecordBatch.from_arrays([*docs, *(part.column(c) for c in keep)], names)
                counts = np.bincount(words.codes, minlength=len(words.words))
                used = np.flatnonzero(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts[used])]), pa.int32()), pa.array(position[np.argsort(words.codes, kind="stable")]))
                text = pa.array([words.words[i] for i in used.tolist()], pa.binary()).cast(pa.string())
                size = len(used)
                postings = [pa.array(np.full(size, segment)), text, pa.array(counts[used], pa.int32()), lists, pa.nulls(size, pa.int32()), pa.nulls(size, pa.int32())]
                yield pa.RecordBatch.from_arrays([*postings, *(pa.nulls(size, t) for t in types)], names)

    return run


def build(docs: DataFrame, text: str = "text", keep: list[str] | None = None, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of all rows of ``docs``, written to the shared folder.

    A row is a word of a segment (``segment``, ``word``, ``n``, ``positions``)
    or a text (``segment``, ``doc`` within it, ``n`` words, ``first``
    position, the columns ``keep``; ``word`` is null). A null text has no
    words. Kept columns named like one of the index's are refused.
    """
    common.ship(docs.sparkSession)
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    if clash := {"segment", "word", "n", "positions", "doc", "first", "_index_text", "_spans", "_items"} & set(keep):
        raise ValueError(f"reserved column names: {sorted(clash)}")
    kept = docs.select(*keep)
    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    rows = docs.select(*keep, F.col(text).cast("string").alias("_index_text"))
    out = rows.mapInArrow(_index(keep, segment_bytes), f"segment long, word string, n int, positions array<int>, doc int, first int{fields}")
    return common.cut(out, "index")


# ---------------------------------------------------------------------------
# test items


def _pieces(window: int, size: int):
    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "text", 1 << 20):
                words = words_of(common.texts_of(part, "text"))
                text = pa.array(words.words, pa.binary()).cast(pa.string())
                ids, lists = [], []
                for row, start in enumerate(np.cumsum(words.counts) - words.counts):
                    n = int(words.counts[row])
                    for at in range(0, max(1, n - window + 1), size) if n else ():
                        codes = words.codes[start + at : start + min(n, at + size + window - 1)]
                        ids.append(part.column("item")[row].as_py())
                        lists.append(text.take(pa.array(codes)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([x.to_pylist() for x in lists], pa.list_(pa.string()))], ["item", "words"])

    return run


def pieces(items: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """Rows ``(item, words)``: the words of each item, long items in overlapping pieces that hold each window once. Items without words have none."""
    common.ship(items.sparkSession)
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(window, _PIECE), "item string, words array<string>")


@dataclass
class Phrases:
    """Distinct windows of some items: word numbers (-1 beyond a short one), and the items of each."""

    words: list[str]
    windows: np.ndarray  # windows x WINDOW
    items: list[str]
    owners: tuple[np.ndarray, np.ndarray]  # windows' starts in, and numbers of items
    order: np.ndarray | None = None  # each window's columns, rarest word first

    def rank(self, counts: dict[str, int]) -> None:
        n = np.array([counts.get(w, 0) for w in self.words] + [np.iinfo(np.int64).max])  # -1 is last
        self.order = np.argsort(n[self.windows], axis=1, kind="stable")
        self.rarest = n[np.take_along_axis(self.windows, self.order[:, :1], axis=1)[:, 0]]


def phrases(rows: list, window: int = WINDOW) -> Phrases:
    """The windows of ``(item, words)`` rows; an item of fewer words is one window."""
    number: dict[str, int] = defaultdict(lambda: len(number))
    item: dict[str, int] = defaultdict(lambda: len(item))
    found, owner = [], []
    for name, words in rows:
        codes = np.array([number[w] for w in words], np.int32)
        if len(codes) < window:
            codes = np.append(codes, np.full(window - len(codes), -1, np.int32))
        part = np.lib.stride_tricks.sliding_window_view(codes, window)
        found.append(part)
        owner.append(np.full(len(part), item[name]))
    if not found:
        return Phrases([], np.empty((0, window), np.int32), [], (np.zeros(1, np.int64), np.empty(0, np.int64)))
    windows, which = np.unique(np.concatenate(found), axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), np.concatenate(owner)]), axis=1)
    starts = np.searchsorted(pairs[0], np.arange(len(windows) + 1))
    return Phrases(list(number), windows, list(item), (starts, pairs[1]))


def blocks(items: DataFrame, window: int, most: int) -> Iterator[Phrases]:
    """The items' windows, about ``most`` words at a time; the driver holds one block."""
    held, n = [], 0
    for row in items.toLocalIterator():
        held.append((row.item, row.words))
        n += len(row.words)
        if n >= most:
            yield phrases(held, window)
            held, n = [], 0
    if held:
        yield phrases(held, window)


# ---------------------------------------------------------------------------
# search in one segment


class Lists:
    """The position lists of a segment's test words as one sorted array of (word, position)."""

    def __init__(self, phrase: Phrases, words: pa.Array, positions: pa.ListArray):
        number = {w: i for i, w in enumerate(phrase.words)}
        codes = np.array([number[w] for w in words.to_pylist()], np.int64)
        sizes = np.diff(positions.offsets.to_numpy())
        self.keys = np.sort(np.repeat(codes << 32, sizes) + positions.flatten().to_numpy())

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of the words' lists; a word below 0 has an empty one."""
        start, end = (np.searchsorted(self.keys, (words.astype(np.int64) + x) << 32) for x in (0, 1))
        return start, np.where(words < 0, 0, end - start)

    def have(self, words: np.ndarray, positions: np.ndarray) -> np.ndarray:
        wanted = (words.astype(np.int64) << 32) + positions
        at = np.searchsorted(self.keys, wanted)
        return (positions >= 0) & (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == wanted)

    def next(self, words: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """The word's first position not before; -1 if there is none."""
        at = np.searchsorted(self.keys, (words.astype(np.int64) << 32) + positions)
        key = self.keys[np.minimum(at, len(self.keys) - 1)]
        return np.where((at < len(self.keys)) & (key >> 32 == words), key & 0xFFFFFFFF, -1)


def _expand(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every place in the ranges."""
    row = np.repeat(np.arange(len(start)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def _turns(phrase: Phrases, size: np.ndarray, most: int = 1 << 21) -> Iterator[slice]:
    """Runs of windows whose rarest lists hold about ``most`` positions, one window at least."""
    total, start = np.cumsum(size), 0
    while start < len(size):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, side="right")))
        yield slice(start, end)
        start = end


def exact(phrase: Phrases, lists: Lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first, last + 1) of every occurrence: the words one after the other."""
    width = phrase.windows.shape[1]
    length = (phrase.windows >= 0).sum(axis=1)
    lead = phrase.order[:, 0]
    start, size = lists.of(phrase.windows[np.arange(len(lead)), lead])
    out = []
    for turn in _turns(phrase, size):
        row, place = _expand(start[turn], size[turn])
        row = row + turn.start
        first = (lists.keys[place] & 0xFFFFFFFF) - lead[row]
        for step in range(1, width):  # rarest first: few are left after a step or two
            if not len(row):
                break
            column = phrase.order[row, step]
            word = phrase.windows[row, column]
            stays = (word < 0) | lists.have(np.maximum(word, 0), first + column)
            row, first = row[stays], first[stays]
        ok = first >= 0
        out.append((row[ok], first[ok], first[ok] + length[row[ok]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def near(phrase: Phrases, lists: Lists, span: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first, last + 1) of every shortest run of at most ``span`` words from its first word on that holds all words of a window, in any order.

    ``ends``: where texts end, ascending; a run lies in one text.
    """
    width = phrase.windows.shape[1]
    out = []
    lead = phrase.windows[np.arange(len(phrase.windows)), phrase.order[:, 0]]
    start, size = lists.of(lead)
    for turn in _turns(phrase, size * width):
        row, place = _expand(start[turn], size[turn])
        anchor, row = lists.keys[place] & 0xFFFFFFFF, row + turn.start
        found = []
        for column in range(width):  # a run begins at one of the words, up to span before its rarest
            word = phrase.windows[row, column]
            low, high = (np.searchsorted(lists.keys, (np.maximum(word, 0).astype(np.int64) << 32) + x) for x in (np.maximum(anchor - span + 1, 0), anchor + 1))
            begin_row, begin = _expand(low, np.where(word < 0, 0, high - low))
            found.append(np.stack([row[begin_row], lists.keys[begin] & 0xFFFFFFFF]))
        row, first = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), np.int64)
        last = first
        for step in range(width):
            word = phrase.windows[row, phrase.order[row, step]]
            at = np.where(word < 0, first, lists.next(np.maximum(word, 0), first))
            limit = np.minimum(first + span, ends[np.searchsorted(ends, first, side="right")])
            stays = (at >= 0) & (at < limit)
            row, first, last = row[stays], first[stays], np.maximum(last, at)[stays]
        out.append((row, first, last + 1))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def _union(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of some intervals."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order]) if len(last) else last
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(first)), bool), first[1:] > reach[:-1]]))
    return first[new], reach[np.append(new[1:], len(first)) - 1] if len(new) else reach


def _search(block, keep: list[str], span: int | None):
    def run(key, table):
        phrase = block.value
        is_doc = table.column("word").is_null()
        docs, found = table.filter(is_doc).combine_chunks(), table.filter(pc.invert(is_doc)).combine_chunks()
        docs = docs.sort_by("doc")
        first = docs.column("first").to_numpy().astype(np.int64)
        n = docs.column("n").to_numpy()
        if found.num_rows:
            positions = found.column("positions")
            lists = Lists(phrase, found.column("word"), positions.chunk(0) if isinstance(positions, pa.ChunkedArray) else positions)
            window, start, end = exact(phrase, lists) if span is None else near(phrase, lists, span, first + n)
        else:
            window = start = end = np.empty(0, np.int64)
        doc = np.searchsorted(first, start, side="right") - 1
        # spans of each text: the gap keeps those of neighbours apart
        low, high = _union(start, end)
        of = np.searchsorted(first, low, side="right") - 1
        begin = first[of]
        offsets = pa.array(np.searchsorted(of, np.arange(docs.num_rows + 1)), pa.int32())
        spans = pa.StructArray.from_arrays([pa.array(low - begin, pa.int32()), pa.array(high - begin, pa.int32())], ["first", "end"])
        starts, items = phrase.owners
        row, place = _expand(starts[window], starts[window + 1] - starts[window])
        pair = np.unique(np.stack([doc[row], items[place]]), axis=1) if len(row) else np.empty((2, 0), np.int64)
        names = pa.array(phrase.items, pa.string()).take(pa.array(pair[1]))
        owned = pa.ListArray.from_arrays(pa.array(np.searchsorted(pair[0], np.arange(docs.num_rows + 1)), pa.int32()), names)
        return pa.Table.from_arrays([*(docs.column(c) for c in ("segment", "doc", "n", *keep)), pa.ListArray.from_arrays(offsets, spans), owned], ["segment", "doc", "n", *keep, "_spans", "_items"])

    return run


_MATCHES = "_spans array<struct<first:int,end:int>>, _items array<string>"


def _look_up(index: DataFrame, phrase: Phrases, keep: list[str], fields: str, span: int | None) -> DataFrame:
    spark = index.sparkSession
    # the block's words: their number is bounded by its size
    words = F.broadcast(spark.createDataFrame([(w,) for w in phrase.words], "word string"))
    counts = index.select("word", "n").join(words, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n")).collect()
    phrase.rank({r.word: r.n for r in counts})
    block = spark.sparkContext.broadcast(phrase)
    columns = ["segment", "word", "n", "positions", "doc", "first", *keep]
    texts = index.where("word is null").select(*columns)
    lists = index.where("word is not null").join(words, "word", "left_semi").select(*columns)
    return texts.union(lists).groupBy("segment").applyInArrow(_search(block, keep, span), f"segment long, doc int, n int{fields}, {_MATCHES}")


def find(index: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW, span: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per indexed text: its kept columns, ``n`` (words), ``_spans`` (maximal runs of hit words, first
    and end by number) and ``_items`` (ids, as text, of the items that occur; each once, ascending).

    A window is ``window`` consecutive words of an item; an item of fewer words
    is one window, one without words has none. A window occurs where its words
    stand one after the other or, with ``span``, within ``span`` consecutive
    words in any order (a word that the window repeats may be met once). Repeated items are found
    alike; a null item id counts as the empty text. No items: no spans. An
    empty index gives no rows. Extra columns of ``items`` are ignored. Items
    are looked up ``block_words`` words at a time, each block in one pass.
    """
    if window < 1 or (span is not None and span < 1):
        raise ValueError("window and span must be at least 1")
    spark = index.sparkSession
    keep = [c for c in index.columns if c not in {"segment", "word", "n", "positions", "doc", "first"}]
    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in index.select(*keep).schema.fields)
    passes = [_look_up(index, b, keep, fields, span) for b in blocks(pieces(items, text, item_id, window), window, block_words)]
    if not passes:
        none = [F.array().cast(x.strip().split(" ", 1)[1]).alias(x.strip().split(" ", 1)[0]) for x in _MATCHES.split(", ")]
        return index.where("word is null").select("n", *keep, *none)
    out = passes[0]
    if len(passes) > 1:
        for more in passes[1:]:
            out = out.union(more)
        first = [F.first(c).alias(c) for c in ("n", *keep)]
        out = out.groupBy("segment", "doc").agg(*first, F.flatten(F.collect_list("_spans")).alias("_spans"), F.flatten(F.collect_list("_items")).alias("_items"))
        out = out.withColumn("_spans", _merged("_spans"))
    return out.select("n", *keep, "_spans", F.array_sort(F.array_distinct("_items")).alias("_items"))


def _merged(spans: str):
    """The union of runs from several passes: a run begins where none before it reaches."""
    reach = F.transform(F.array_sort(spans), lambda s, i: F.struct(s["first"].alias("first"), s["end"].alias("end"), i.alias("i")))
    kind = "array<struct<first:int,end:int>>"
    last = lambda a: F.element_at(a, -1)
    longer = lambda a, s: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["first"].alias("first"), F.greatest(last(a)["end"], s["end"]).alias("end"))))
    return F.aggregate(
        reach,
        F.array().cast(kind),
        lambda a, s: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] >= s["first"]), longer(a, s)).otherwise(F.concat(a, F.array(F.struct(s["first"].alias("first"), s["end"].alias("end"))))),
    )


def oracle_sql(window: int = WINDOW) -> str:
    """The registered query in DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
with d as materialized (select row_number() over () as r, doc_id, {words} as w from documents),
b as (select coalesce(item_id::varchar, '') as item, {words} as w from benchmark),
bw as materialized (select distinct item, least(len(w), {window}) as l, array_to_string(w[s:s + least(len(w), {window}) - 1], ' ') as g
  from (select *, unnest(range(1, greatest(len(w) - {window}, 0) + 2)) as s from b where len(w) > 0)),
dg as (select r, s, l, array_to_string(w[s:s + l - 1], ' ') as g from (select r, w, l, unnest(range(1, len(w) - l + 2)) as s from d cross join (select distinct l from bw))),
m as materialized (select dg.r, dg.s, dg.l, bw.item from dg join bw using (l, g)),
hits as (select r, count(distinct p)::bigint as n_hit from (select r, unnest(range(s, s + l)) as p from (select distinct r, s, l from m)) group by r),
found as (select r, count(*)::bigint as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from m) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (r) left join found using (r)
"""
