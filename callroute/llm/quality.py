"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Two kinds of n-gram are hashed: of the words themselves, and of their shapes
(letters, capitals and digits each folded to one sign, a word repeated at
once to another), so that a habit of writing shows in words never seen. A
score is a sparse dot product through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, windows

_U = np.uint64
_ORDERS = {"word": 2, "shape": 3}
_FOLDS = [(r"\p{Lu}{2,}", "A"), (r"\p{Lu}?\p{Ll}+|\p{Lu}", "a"), (r"\p{L}+", "b"), (r"\p{Nd}+", "0")]


class Features:
    """For some texts: n-gram buckets with the row of each, and what one n-gram of a row weighs."""

    def __init__(self, texts: pa.Array, bits: int):
        words = common.Words(texts, lower=False)
        ids = words.hashes(11)
        folded = pa.array(words.words, pa.binary()).cast(pa.string())
        for pattern, sign in _FOLDS:
            folded = pc.replace_substring_regex(folded, pattern, sign)
        shapes = pc.dictionary_encode(folded)
        shape_ids = common.hashes(shapes.dictionary.cast(pa.binary()).to_pylist(), 13)
        codes, rows = words.codes, words.rows
        word = ids[codes]
        shape = shape_ids[shapes.indices.to_numpy(zero_copy_only=False)][codes] if len(codes) else np.empty(0, np.uint64)
        again = np.zeros(len(codes), bool)
        again[1:] = (codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])
        shape = np.where(again, _U(1), shape)
        bucket, row = [], []
        for tokens, (name, order) in zip((word, shape), _ORDERS.items(), strict=True):
            gram, own = tokens, rows
            for n in range(1, order + 1):
                if n > 1:  # the n-1 tokens before, then this one, all of one text
                    gram = gram[:-1] * _U(0x9E3779B97F4A7C15) + tokens[n - 1 :]
                    inside = rows[n - 1 :] == rows[: len(rows) - n + 1]
                    own = rows[n - 1 :]
                    kept = inside
                else:
                    kept = slice(None)
                bucket.append((windows.mix(gram[kept] ^ _U(n * 7 + len(name))) >> _U(64 - bits)).astype(np.int64))
                row.append(own[kept])
        self.bucket, self.row = bucket, row
        self.weight = 1.0 / np.maximum(1, words.counts)

    def dot(self, weights: np.ndarray, rows: int) -> np.ndarray:
        total = np.zeros(rows)
        for bucket, row in zip(self.bucket, self.row, strict=True):
            total += np.bincount(row, weights[bucket], minlength=rows)
        return total * self.weight


class Learner:
    """Follow-the-regularised-leader with a step size of its own for each bucket; the last bucket is the intercept."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) > self.l1, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2), 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / self.alpha * w


def _train(bits: int, epochs: int, rates: tuple[float, float, float, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rows = Learner(bits, *rates), []
        for batch in batches:
            for part in common.slices(batch):
                f = Features(common.texts_of(part), bits)
                bucket, row = np.concatenate(f.bucket), np.concatenate(f.row)
                order = np.argsort(row, kind="stable")
                edge = np.searchsorted(row[order], np.arange(part.num_rows + 1))
                for i, label in enumerate(part.column("label").to_pylist()):
                    at, n = np.unique(bucket[order[edge[i] : edge[i + 1]]], return_counts=True)
                    at, x = np.append(at, 1 << bits), np.append(n * f.weight[i], 1.0)
                    model.learn(at, x, label)
                    if epochs > 1:
                        rows.append((at.astype(np.int32), x.astype(np.float32), label))
        for _ in range(epochs - 1):
            for row in rows:
                model.learn(*row)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())], ["weights"])

    return run


def learnable(doc_id: str | Column, folds: int = 3, held_out: int = 1) -> Column:
    """Rows that a model may learn from: crc32 of the id's text, modulo ``folds``, is not ``held_out``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds, F.lit(0)) != held_out


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    text: str = "text",
    doc_id: str = "doc_id",
    max_rows: int = 5_000,
    bits: int = 18,
    epochs: int = 2,
    rates: tuple[float, float, float, float] = (2.0, 0.05, 1e-4, 0.0),
) -> np.ndarray:
    """Weights of ``2 ** bits`` buckets and the intercept.

    Learns from a sample of about ``max_rows`` labelled rows (those of the
    smallest hashed ids; the only bound on what is read), in one task, row by
    row. Of several rows of an id the one of the smallest text hash counts, so
    the bound holds for rows. Null labels and ids teach nothing; of several labels of an id the
    largest counts; null text is empty. Without labelled rows all weights are 0.
    """
    common.ship(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("label"))
    known = known.select(F.col(doc_id).alias("_id"), "label")
    n = known.count()
    below = F.lit(True)
    if n > max_rows:  # the ids' hashes are even, so this share of their range holds about max_rows
        below = F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) < int(max_rows / n * (1 << 40))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).where(below).join(known.where(below), "_id")
    rows = rows.groupBy("_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    rows = rows.select("text", "label", F.xxhash64("_id", F.lit(1)).alias("at"), "_id").repartition(1).sortWithinPartitions("at", "_id", "text")
    found = rows.select("text", "label").mapInArrow(_train(bits, epochs, rates), "weights binary").first()
    return np.frombuffer(found.weights, np.float32) if found else np.zeros((1 << bits) + 1, np.float32)


def _score(weights, names: list[str]):
    def run(batches):
        w = weights.value
        bits = int(np.log2(len(w) - 1))
        for batch in batches:
            for part in common.slices(batch, "_text"):
                z = Features(common.texts_of(part, "_text"), bits).dot(w, part.num_rows) + w[-1]
                score = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(score)], [*names, "_score"])

    return run


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (by default all) and ``_score``, the probability of label 1, of every row by its whole text.

    Null text is empty; an empty text gets the intercept's score. Rows,
    repeated ones too, are scored on their own. An input column ``_score`` or
    ``_text`` clashes and is refused. The weights are broadcast: their size is
    set by the number of buckets, not by the data.
    """
    spark = common.ship(docs.sparkSession)
    names = keep or docs.columns
    if clash := {"_score", "_text"} & set(names):
        raise ValueError(f"reserved column names: {sorted(clash)}")
    kept = docs.select(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    rows = docs.select(*names, F.col(text).alias("_text"))
    return rows.mapInArrow(_score(spark.sparkContext.broadcast(weights), names), f"{fields}, _score double")
