"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by workers.

The model is a folder of sorted arrays dealt into shards: word hashes with
their counts (a word's id is its place among all of them), id pairs with their
counts, and per word its continuations and what follows it. Tasks count what
they read, deal the counts by shard, and one task per shard adds them up and
writes its arrays; scoring tasks map the arrays and read what they look up.
A word with more than its share of all followers has its pairs dealt by the
whole pair, so no shard grows with one word.

Order two is fixed: longer n-grams of this corpus are nearly all distinct, and
their arrays alone would outgrow the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, windows
from .common import Shards, Words

_U = np.uint64
_SEED = 3
_END = xxhash.xxh64_intdigest(b"\n", _SEED)  # no word: words hold no white space
_WORD, _PAIR, _WORD_SUMS = range(3)
_FLUSH = 1 << 20
_ENTRIES = "shard int, b0 binary, b1 binary, b2 binary"


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their counts added up."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts[order], at)


_MOST = (1 << 32) - 1  # of a count in 32 bits


def _narrow(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same counts in 32 bits each: a larger one is several entries of its key."""
    whole, rest = np.divmod(counts.astype(np.int64), _MOST)
    if not whole.any():
        return keys, counts.astype(np.uint32)
    keys = np.concatenate([keys, np.repeat(keys, whole)])
    counts = np.concatenate([rest, np.full(whole.sum(), _MOST)]).astype(np.uint32)
    return keys[counts > 0], counts[counts > 0]


def _stored(counts: np.ndarray) -> np.ndarray:
    """Counts as a shard's file has them: in 32 bits where all fit, else in 64."""
    return counts.astype(np.uint32) if counts.max(initial=0) <= _MOST else counts.astype(np.int64)


def _gathered(found: Iterator[tuple[np.ndarray, np.ndarray]], deal) -> Iterator[pa.RecordBatch]:
    """Counts of one task, added up before they are dealt."""
    keys, counts, n = [], [], 0
    for k, c in found:
        keys.append(k)
        counts.append(c)
        n += len(k)
        if n > _FLUSH:
            yield common.blobs(deal(*_summed(np.concatenate(keys), np.concatenate(counts))), 3)
            keys, counts, n = [], [], 0
    if n:
        yield common.blobs(deal(*_summed(np.concatenate(keys), np.concatenate(counts))), 3)


def _word_counts(bits: int):
    def run(batches):
        def found():
            for batch in batches:
                for part in common.slices(batch):
                    words = Words(common.texts_of(part), lower=True)
                    yield words.hashes(_SEED), np.bincount(words.codes, minlength=len(words.words))
                    yield np.array([_END], np.uint64), np.array([part.num_rows])

        def deal(keys, counts):
            real = counts > 0
            return common.shard_rows(_WORD, bits, keys[real], counts[real].astype(np.int64))

        return _gathered(found(), deal)

    return run


@dataclass
class Model:
    """Where the arrays are and what is known of the whole: enough for any task to score."""

    folder: str
    bits: int
    offsets: list[int] = field(default_factory=list)  # id of each shard's first word, and the number of words
    tokens: int = 0
    texts: int = 0
    pairs: int = 0
    discounts: tuple[list[float], list[float]] = field(default_factory=lambda: ([0.0] * 4, [0.0] * 4))  # of words by continuations, of pairs
    gamma: float = 1.0

    @property
    def words(self) -> int:
        return self.offsets[-1]

    @property
    def start(self) -> int:
        """Id of what stands before a text."""
        return self.words

    def unknown(self) -> float:
        return self.gamma / (self.words + 1)


class Reader:
    """A task's view of a model's arrays."""

    def __init__(self, model: Model):
        self.model = model
        self.hashes = Shards(model.folder, model.bits, _WORD, "key", "count")
        self.pairs = Shards(model.folder, model.bits, _PAIR, "key", "count")
        self.sums = Shards(model.folder, model.bits, _WORD_SUMS, "follow", "back", "total")
        self.offsets = np.array(model.offsets, np.int64)

    def find_words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes)
        keys = hashes[order]
        shift = _U(64 - self.model.bits)
        for part, (own, count) in self.hashes.ranges(keys):
            q = keys[part]
            at = np.minimum(np.searchsorted(own, q), len(own) - 1)
            hit = own[at] == q
            ids[order[part][hit]] = self.offsets[int(q[0] >> shift)] + at[hit]
            counts[order[part][hit]] = count[at[hit]]
        return ids, counts

    def shard_of(self, before: np.ndarray, after: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Of each pair; ``count``: how often the first word comes."""
        hot = count > max(1, self.model.tokens >> (self.model.bits + 2))
        key = np.where(hot, (before.astype(np.uint64) << _U(32)) | after.astype(np.uint64), before.astype(np.uint64))
        return (windows.mix(key + _U(1)) >> _U(64 - self.model.bits)).astype(np.int64)

    def pair_counts(self, shard: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        order = np.lexsort([keys, shard])
        edge = np.searchsorted(shard[order], np.arange((1 << self.model.bits) + 1))
        for i, (a, b) in enumerate(zip(edge, edge[1:], strict=False)):
            if b > a and (arrays := self.pairs.shard(i)) and len(arrays[0]):
                own, count = arrays
                q = keys[order[a:b]]
                at = np.minimum(np.searchsorted(own, q), len(own) - 1)
                out[order[a:b]] = np.where(own[at] == q, count[at], 0)
        return out

    def sums_of(self, ids: np.ndarray) -> list[np.ndarray]:
        """For known ids: what p(word) is without context, the weight given back to it, and how often anything follows."""
        out = [np.zeros(len(ids)) for _ in range(3)]
        shard = np.minimum(np.searchsorted(self.offsets, ids, side="right") - 1, (1 << self.model.bits) - 1)
        for i in np.unique(shard):
            if arrays := self.sums.shard(int(i)):
                here = shard == i
                for x, a in zip(out, arrays, strict=True):
                    x[here] = a[ids[here] - self.offsets[i]]
        return out


class _Tokens:
    """Of some texts: for every token its id and that of the one before, rows and counts."""

    def __init__(self, reader: Reader, texts: pa.Array):
        words = Words(texts, lower=True)
        n = len(texts)
        ids, counts = reader.find_words(np.append(words.hashes(_SEED), _U(_END)))
        length = words.counts + 1
        last = np.cumsum(length) - 1
        code = np.full(length.sum(), len(words.words))
        inner = np.ones(len(code), bool)
        inner[last] = False
        code[inner] = words.codes
        self.code, self.ids, self.counts = code, ids, counts
        self.row = np.repeat(np.arange(n), length)
        self.length = length
        self.before = np.empty(len(code), np.int64)  # place in the word list of the token before; -1: none
        self.before[1:] = code[:-1]
        self.before[last - length + 1] = -1


def _pair_counts(model: Model):
    def run(batches):
        reader = Reader(model)

        def found():
            for batch in batches:
                for part in common.slices(batch):
                    t = _Tokens(reader, common.texts_of(part))
                    if len(t.code):
                        keys, n = np.unique(((t.before + 1) << 32) | t.code, return_counts=True)
                        before = np.append(t.ids, model.start)[(keys >> 32) - 1]
                        yield (before.astype(np.uint64) << _U(32)) | t.ids[keys & 0xFFFFFFFF].astype(np.uint64), n

        def deal(keys, counts):
            before = (keys >> _U(32)).astype(np.int64)
            shard = reader.shard_of(before, (keys & _U(0xFFFFFFFF)).astype(np.int64), _counts_of(reader, before))
            order = np.argsort(shard, kind="stable")
            edge = np.searchsorted(shard[order], np.arange((1 << model.bits) + 1))
            parts = [(i, *_narrow(keys[order[a:b]], counts[order[a:b]])) for i, (a, b) in enumerate(zip(edge, edge[1:], strict=False)) if b > a]
            return [((_PAIR << model.bits) + i, [k.tobytes(), n.tobytes()]) for i, k, n in parts]

        return _gathered(found(), deal)

    return run


def _counts_of(reader: Reader, ids: np.ndarray) -> np.ndarray:
    out = np.full(len(ids), reader.model.texts, np.int64)  # as often as texts begin
    shard = np.searchsorted(reader.offsets, ids, side="right") - 1
    for i in np.unique(shard[ids < reader.model.words]):
        here = (shard == i) & (ids < reader.model.words)
        out[here] = reader.hashes.shard(int(i))[1][ids[here] - reader.offsets[i]]
    return out


_SUMS = "shard int, n long, total long, c1 long, c2 long, c3 long, c4 long, b0 binary, b1 binary, b2 binary"


def _done(shard: int, n: int, total: int, counts: np.ndarray, rows: list | None = None) -> pa.Table:
    few = [int((counts == i).sum()) for i in (1, 2, 3, 4)]
    rows = [(shard, [b"", b"", b""]), *(rows or [])]
    first = [n, total, *few]
    return pa.table(
        {"shard": pa.array([r[0] for r in rows], pa.int32())}
        | {c: pa.array([first[i]] + [0] * (len(rows) - 1), pa.int64()) for i, c in enumerate(("n", "total", "c1", "c2", "c3", "c4"))}
        | {f"b{i}": pa.array([r[1][i] for r in rows], pa.binary()) for i in range(3)}
    )


def _by_word(offsets: np.ndarray, kind: int, bits: int, ids: np.ndarray) -> Iterator[tuple[int, slice]]:
    shard = np.minimum(np.searchsorted(offsets, ids, side="right") - 1, (1 << bits) - 1)
    edge = np.searchsorted(shard, np.arange((1 << bits) + 1))
    for i, (a, b) in enumerate(zip(edge, edge[1:], strict=False)):
        if b > a:
            yield (kind << bits) + i, slice(a, b)


def _save_words(folder: str):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _summed(common.joined(table, "b0", np.uint64), common.joined(table, "b1", np.int64))
        common.save(folder, f"count-{shard}", counts)
        common.save(folder, f"key-{shard}", keys)
        end = counts[keys == _U(_END)]
        return _done(shard, len(keys), int(counts.sum()), np.repeat(1, int(end[0]) if len(end) else 0))

    return run


def _save_pairs(model: Model):
    """A shard's pairs, and what they add to the sums of their words: continuations, and followers by how often."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _summed(common.joined(table, "b0", np.uint64), common.joined(table, "b1", np.uint32).astype(np.int64))
        common.save(model.folder, f"count-{shard}", _stored(counts))
        common.save(model.folder, f"key-{shard}", keys)
        offsets = np.array(model.offsets, np.int64)
        before = (keys >> _U(32)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), before[1:] != before[:-1]]))
        sums = [np.add.reduceat(x.astype(np.int64), at) for x in (counts, counts == 1, counts == 2, counts > 2)]
        follow = np.stack(sums, axis=1) if len(at) else np.zeros((0, 4), np.int64)
        ids, n = np.unique((keys & _U(0xFFFFFFFF)).astype(np.int64), return_counts=True)
        rows = [(s, [before[at][x].astype(np.uint32).tobytes(), follow[x].tobytes(), b""]) for s, x in _by_word(offsets, _WORD_SUMS, model.bits, before[at])]
        rows += [(s, [ids[x].astype(np.uint32).tobytes(), b"", n[x].astype(np.uint32).tobytes()]) for s, x in _by_word(offsets, _WORD_SUMS, model.bits, ids)]
        return _done(shard, len(keys), int(counts.sum()), counts, rows)

    return run


def _save_sums(model: Model):
    """Per word, dense: continuations, and total and kinds of its followers; the last shard also has the start."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        i = shard - (_WORD_SUMS << model.bits)
        size = model.offsets[i + 1] - model.offsets[i] + (i == (1 << model.bits) - 1)
        follow, back = np.zeros((size, 4), np.int64), np.zeros(size, np.int64)
        for ids, sums, n in zip(table.column("b0"), table.column("b1"), table.column("b2"), strict=True):
            at = np.frombuffer(ids.as_buffer(), np.uint32).astype(np.int64) - model.offsets[i]
            if len(sums.as_buffer()):
                follow[at] += np.frombuffer(sums.as_buffer(), np.int64).reshape(-1, 4)
            else:
                back[at] += np.frombuffer(n.as_buffer(), np.uint32)
        common.save(model.folder, f"raw_follow-{shard}", follow)
        common.save(model.folder, f"raw_back-{shard}", back)
        more = int((back > 2).sum())
        return _done(shard, more, int(back.sum()), back)

    return run


def _finish(model: Model):
    """The raw sums of a shard as the scoring tasks use them."""

    def run(batches):
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                follow, back = (np.load(f"{model.folder}/raw_{n}-{shard}.npy", mmap_mode="r") for n in ("follow", "back"))
                d1, d2 = model.discounts
                own = np.maximum(back - np.array(d1)[np.minimum(back, 3)], 0) / max(1, model.pairs) + model.unknown()
                total = follow[:, 0].astype(np.float64)
                given = (follow[:, 1] * d2[1] + follow[:, 2] * d2[2] + follow[:, 3] * d2[3]) / np.maximum(1, total)
                for n, x in (("follow", own), ("back", given), ("total", total)):
                    common.save(model.folder, f"{n}-{shard}", x)
            yield pa.RecordBatch.from_arrays([batch.column("shard")], ["shard"])

    return run


def discounts(c1: int, c2: int, c3: int, c4: int) -> list[float]:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more, from how many things come that often."""
    y = c1 / (c1 + 2 * c2) if c1 else 0.0
    raw = [k - (k + 1) * y * (b / a) if a else k * 0.5 for k, a, b in ((1, c1, c2), (2, c2, c3), (3, c3, c4))]
    return [0.0, *(min(float(k), max(0.0, d)) for k, d in zip((1, 2, 3), raw, strict=True))]


def train(texts: DataFrame, text: str = "text", shard_bytes: int = 32 << 20) -> Model:
    """Count a model from all rows of ``texts`` into a new folder below ``spark.checkpoint.dir``.

    Two passes over the texts. Null text is an empty one (an end alone). No
    rows give a model that knows nothing.
    """
    spark = common.ship(texts.sparkSession)
    rows = texts.select(F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = Model(common.shared_folder(spark, "ngrams"), common.bits_for(size, shard_bytes))
    shards = 1 << model.bits

    def reduced(entries: DataFrame, save) -> DataFrame:
        return common.cut(entries.groupBy("shard").applyInArrow(save, _SUMS), "counts")

    def total(done: DataFrame) -> dict:
        return done.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "total", "c1", "c2", "c3", "c4"))).first().asDict()

    words = reduced(rows.mapInArrow(_word_counts(model.bits), _ENTRIES), _save_words(model.folder))
    sizes = {r.shard: r.n for r in words.select("shard", "n").collect()}  # one number per shard
    model.offsets = [0, *np.cumsum([sizes.get(i, 0) for i in range(shards)]).tolist()]
    if model.words >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    known = total(words)
    model.tokens, model.texts = known["total"], known["c1"]
    pairs = reduced(rows.mapInArrow(_pair_counts(model), _ENTRIES), _save_pairs(model))
    found = total(pairs)
    model.pairs = found["n"]
    sums = reduced(pairs.where(F.col("shard") >= _WORD_SUMS << model.bits).select("shard", "b0", "b1", "b2"), _save_sums(model))
    back = total(sums)
    model.discounts = (discounts(*(back[f"c{i}"] for i in (1, 2, 3, 4))), discounts(*(found[f"c{i}"] for i in (1, 2, 3, 4))))
    d = model.discounts[0]
    model.gamma = (d[1] * back["c1"] + d[2] * back["c2"] + d[3] * back["n"]) / model.pairs if model.pairs else 1.0
    sums.select("shard").mapInArrow(_finish(model), "shard int").agg(F.count("*")).first()
    return model


def _score(model: Model, names: list[str]):
    def run(batches):
        reader = Reader(model)
        unknown = model.unknown()
        d = np.array(model.discounts[1])
        for batch in batches:
            for part in common.slices(batch, "_text"):
                t = _Tokens(reader, common.texts_of(part, "_text"))
                n = part.num_rows
                own, given, total = (np.append(x, 0.0) for x in reader.sums_of(t.ids[t.ids >= 0]))
                place = np.full(len(t.ids) + 1, len(own) - 1)  # of each word in those, last: nothing known
                place[np.flatnonzero(t.ids >= 0)] = np.arange((t.ids >= 0).sum())
                alone = np.where(t.ids >= 0, own[place[:-1]], unknown)
                keys, inverse = np.unique(((t.before + 1) << 32) | t.code, return_inverse=True)
                after, before = keys & 0xFFFFFFFF, (keys >> 32) - 1
                first = before < 0
                start = [x[0] for x in reader.sums_of(np.array([model.start]))]
                back = np.where(first, start[1], given[place[before]])
                follows = np.where(first, start[2], total[place[before]])
                before_id = np.where(first, model.start, t.ids[before])
                seen = (before_id >= 0) & (t.ids[after] >= 0) & (follows > 0)
                count = np.zeros(len(keys), np.int64)
                b, a = before_id[seen], t.ids[after][seen]
                often = np.where(first, model.texts, t.counts[before])[seen]
                count[seen] = reader.pair_counts(reader.shard_of(b, a, often), (b.astype(np.uint64) << _U(32)) | a.astype(np.uint64))
                p = np.where(follows > 0, np.maximum(count - d[np.minimum(count, 3)], 0) / np.maximum(1, follows) + back * alone[after], alone[after])
                score = np.bincount(t.row, np.log10(p)[inverse], minlength=n)
                base = np.log10((t.counts + 1) / (model.tokens + model.words + 1))
                columns = [pa.array(t.length.astype(np.int64)), pa.array(np.bincount(t.row, t.counts[t.code] > 0, minlength=n).astype(np.int64)), pa.array(np.bincount(t.row, base[t.code], minlength=n)), pa.array(score)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *columns], [*names, "_tokens", "_known", "_base", "_score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (by default all) and, of every row's whole text, ``_tokens`` (words and an end), ``_known`` of them,
    ``_base`` (log10 probability by add-one word counts) and ``_score`` (by the model).

    Null text is empty: an end alone. Every row, repeated ones too, is scored
    on its own. Columns of those names and ``_text`` clash and are refused. No
    rows give no rows.
    """
    common.ship(docs.sparkSession)
    names = keep or docs.columns
    if clash := {"_text", "_tokens", "_known", "_base", "_score"} & set(names):
        raise ValueError(f"reserved column names: {sorted(clash)}")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    rows = docs.select(*names, F.col(text).alias("_text"))
    return rows.mapInArrow(_score(model, names), f"{fields}, _tokens long, _known long, _base double, _score double")


def perplexity(score: float, tokens: int) -> float:
    return math.pow(10, -score / max(1, tokens))
