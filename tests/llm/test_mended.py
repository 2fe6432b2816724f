"""Cases that once went wrong: labels of any type, wide counts, parts of other types, repeated ids, clashing names."""

from __future__ import annotations

import itertools
import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from callroute.llm import chat, common, embeddings, mixing, quality, scoring, simhash, suffix, topk


@pytest.mark.parametrize(("kind", "labels"), [("double", [1.2, 1.7, None, -0.0, 0.0]), ("string", ["a", "b", None, "", "1"]), ("array<int>", [[1], [2], None, [], [1, 2]])])
def test_labels_are_compared_as_they_are(spark, kind, labels):
    vectors = [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0]]
    rows = list(enumerate(itertools.product(vectors, labels)))
    df = spark.createDataFrame([(i, v, label) for i, (v, label) in rows], f"vec_id long, embedding array<float>, label {kind}")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}

    def linked(a, b):
        (u, x), (v, y) = a, b
        return x is not None and x == y and np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93

    for i, a in rows:
        near = [j for j, b in rows if j != i and linked(a, b)]
        least = min([i, *near])  # links of these vectors reach all of their class
        assert got[i] == (len(near), least, least == i), (a, got[i])


def test_counts_beyond_32_bits_are_kept():
    keys, counts = np.array([5, 9, 11], np.uint64), np.array([3, (1 << 33) + 7, 1 << 32], np.int64)
    k, n = scoring._narrow(keys, counts)
    assert n.dtype == np.uint32
    assert [x.tolist() for x in scoring._summed(k, n.astype(np.int64))] == [keys.tolist(), counts.tolist()]
    assert scoring._stored(counts).tolist() == counts.tolist() and scoring._stored(counts[:1]).dtype == np.uint32


def test_pair_count_beyond_32_bits_is_read_back(tmp_path):
    model = scoring.Model(str(tmp_path), 0, [0, 3], tokens=10)
    keys = np.array([(1 << 32) | 2], np.uint64)
    parts = [scoring._narrow(keys, np.array([(1 << 32) - 1])) for _ in range(3)]
    rows = [(scoring._PAIR, [k.tobytes(), n.tobytes()]) for k, n in parts]
    table = pa.Table.from_batches([common.blobs(rows, 3)])
    scoring._save_pairs(model)(table)
    assert scoring.Reader(model).pair_counts(np.array([0]), keys).tolist() == [3 * ((1 << 32) - 1)]


def test_shards_unmap_what_was_not_used_lately(tmp_path, monkeypatch):
    monkeypatch.setattr(common.Shards, "OPEN", 2)
    for i in range(4):
        np.save(f"{tmp_path}/key-{i}.npy", np.array([i << 62], np.uint64))
    shards = common.Shards(str(tmp_path), 2, 0, "key")
    keys = np.arange(4, dtype=np.uint64) << np.uint64(62)
    for _ in range(2):
        assert shards.find(keys)[0].all() and len(shards.open) == 2


def test_parts_of_other_types_are_attachments(spark):
    part = f"from_json('[{{\"type\":\"video\",\"ref\":\"d\",\"size\":3}},{{\"type\":\"text\",\"text\":\"x\"}},{{\"ref\":\"e\"}},null]', 'array<{chat.PART}>')"
    row = spark.sql(f"select 1L as conv_id, 0L as turn, 'user' as role, {part} as parts, 'clash' as formatted, 9 as turn_starts")
    r = chat.format_chats(row).first()
    assert r.formatted == "<|im_start|>user\n<|other|>x<|other|><|im_end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("other", "d", 0), ("other", "e", 0)]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 9, 100])
def test_running_sums(spark, n):
    sizes = [(7 * i) % 5 for i in range(n)]
    df = spark.createDataFrame([(sizes,)], "s array<bigint>")
    assert df.select(chat.running(F.col("s"), 8).alias("x")).first().x == [sum(sizes[:i]) for i in range(n)]


def test_a_repeated_labelled_id_is_learned_once(spark, documents):
    good = [(i, f"fine words in good order number {i}") for i in range(0, 40, 2)]
    bad = [(i, f"!!! ??? $$$ {i} ###") for i in range(1, 40, 2)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int")
    copies = [(0, "fine words in good order number 0")] * 500
    once = quality.train(documents(good + bad), labels)
    assert np.array_equal(once, quality.train(documents(good + bad + copies), labels))


def plain_ftrl(examples, alpha, beta, l1, l2, epochs):
    """Follow-the-regularised-leader in dictionaries, coordinate by coordinate."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for x, y in examples:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - step * w[i], n.get(i, 0.0) + g * g
    return weight


def test_training_is_plain_ftrl(spark, documents):
    bits, rates = 10, (2.0, 0.05, 1e-2, 0.1)
    rows = [(i, " ".join(("good words here", "BAD 12 !!", "x y z")[(i + j) % 3] for j in range(i % 5 + 1))) for i in range(30)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int")
    docs = documents([*rows, (99, "never labelled")])
    got = quality.train(docs, labels, bits=bits, epochs=2, rates=rates)
    order = [r.doc_id for r in docs.where("doc_id < 99").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").collect()]
    texts = dict(rows)
    examples = []
    for i in order:
        f = quality.Features(pa.array([texts[i]]), bits)
        x = {}
        for b in np.concatenate(f.bucket).tolist():
            x[b] = x.get(b, 0.0) + float(f.weight[0])
        examples.append(({**x, 1 << bits: 1.0}, int(i % 3 == 0)))
    weight = plain_ftrl(examples, *rates, epochs=2)
    assert got == pytest.approx(np.array([weight(i) for i in range((1 << bits) + 1)]), abs=1e-4)
    assert np.count_nonzero(got) > 20
    assert quality.score(docs.limit(0), got).count() == 0


def test_clashing_names_are_refused(spark, documents):
    docs = documents([(1, "a")])
    with pytest.raises(ValueError, match="reserved"):
        simhash.near_duplicates(docs.withColumnRenamed("lang", "_text"), keep=["doc_id", "_text"])
    with pytest.raises(ValueError, match="reserved"):
        mixing.mix(docs.withColumnRenamed("lang", "_w"), {"source": 1.0}, "n_chars", 0.5)


def test_sql_of_mixing_keeps_languages_that_are_not_listed(spark, documents, tmp_path):
    rows = [(i, "some words " * (i % 7 + 1), ["en", "de", "xx", None][i % 4], "ab"[i % 2]) for i in range(200)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    from callroute.llm.queries import op2_mixing

    got = sorted((r.doc_id, r.topic, r.n_tokens, round(r.probability, 5), r.kept) for r in op2_mixing(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cursor = con.execute(mixing.oracle_sql())
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(round(v, 5) if k == "probability" else v for k, v in zip(names, r, strict=True)) for r in cursor.fetchall())
    assert got == want
    assert any(k for i, *_, k in want if i % 4 > 1)


def test_sql_of_top_k_asks_each_vector_once(spark, tmp_path):
    rows = [(i, [float((i * 7 + j) % 5) for j in range(4)]) for i in range(60)]
    rows += [rows[50], rows[50], (0, [4.0, 4.0, 4.0, 4.0]), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0"), k=5).collect()))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert got == sorted(con.execute(topk.oracle_sql(5, 50, 256)).fetchall())


def test_pipeline_on_nothing(spark, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_stage_does_not_depend_on_the_order_of_rows(spark, documents):
    rows = [(1, "a b c d e f", "en", "x"), (1, "a b c d e f", "de", "y"), (None, "a b c d e f", "fr", "z"), (2, "other words " * 9, "en", "x")]
    kept = []
    for order in (rows, rows[::-1]):
        out = corpus_pipeline.simhash_dedup(spark, documents(order).repartition(3), "").collect()
        kept.append(sorted((r.doc_id, r.lang, r.source) for r in out))
    assert kept[0] == kept[1] == [(1, "de", "y"), (2, "en", "x")]


def test_strings_of_one_hash_are_told_apart_by_the_other(tmp_path):
    keys, other, occ = np.array([3, 7, 7, 7, 9], np.uint64), np.array([1, 1, 4, 6, 1], np.uint64), np.arange(5, dtype=np.uint32) + 10
    for name, x in (("key", keys), ("other", other), ("occ", occ)):
        np.save(f"{tmp_path}/{name}-0.npy", x)
    known = suffix._Known(str(tmp_path), 0, 5)
    asked = [(7, 6), (7, 5), (9, 1), (9, 2), (3, 1), (7, 1), (8, 1), (99, 1)]
    found, last = known.find(known.ctx, *(np.array(x, np.uint64) for x in zip(*asked, strict=True)))
    assert found.tolist() == [pair in set(zip(keys.tolist(), other.tolist(), strict=True)) for pair in asked]
    assert last.tolist() == [13, 0, 14, 0, 10, 11, 0, 0]


def test_two_entries_of_a_pair_are_enough():
    got = suffix._capped(np.array([5, 5, 5, 5, 2], np.uint64), np.array([1, 1, 1, 2, 9], np.uint64), np.array([3, 1, 2, 7, 8]))
    assert [x.tolist() for x in got] == [[2, 5, 5, 5], [9, 1, 1, 2], [8, 1, 2, 7]]
