"""Clustering, the positional index and infilling against brute force, on small inputs with odd cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callroute.llm import clusters, index, infill

# --- clustering ----------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, extra string"


def lloyd(rows, k, rounds, seed, scale, width):
    """(id, cluster, distance) by plain whole-number loops over rows ``(id, vector)``."""
    kept = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, members in groups.items():
            centroids[n] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return [(i, *reversed(nearest(v))) for i, v in kept], centroids


def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) + (i % 4) * 0.4).astype(np.float32).tolist()) for i in range(200)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (300, None), (301, [1.0]), (302, [float("nan")] * 8), (303, [None] * 8), (304, [float("inf")] * 8), (305, []), (306, [0.0] * 8), (307, [-0.001] * 8)]
    return rows


def test_clusters_as_by_plain_loops(spark):
    rows = odd_vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS)
    out = clusters.cluster(df, k=5, rounds=4, seed=3, scale=64, width=8).collect()
    expected, centroids = lloyd(rows, 5, 4, 3, 64, 8)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.vec_id, r["_cluster"], r["_distance"]) for r in out), key=key) == sorted(expected, key=key)
    assert {r["_cluster"]: r["_centroid"] for r in out} == {n: centroids[n] for n in {e[1] for e in expected}}
    total = sum(e[2] for e in expected)
    assert {r["_inertia"] for r in out} == {total}
    assert {(r["_cluster"], r["_cluster_inertia"]) for r in out} == {(n, sum(e[2] for e in expected if e[1] == n)) for n in {e[1] for e in expected}}


def test_clusters_of_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [5.0, 5.0], "b"), (3, [1.0, 2.0], None)], VECTORS)
    out = {r.vec_id: (r["_distance"], r.extra) for r in clusters.cluster(df, k=8, width=2, keep=["vec_id", "extra"]).collect()}
    assert out == {1: (0, "a"), 2: (0, "b"), 3: (0, None)}
    none = clusters.cluster(df.limit(0), width=2)
    assert none.count() == 0 and none.columns == ["vec_id", "_cluster", "_distance", "_cluster_inertia", "_inertia", "_centroid"]
    same = spark.createDataFrame([(i, [3.0, 3.0], "") for i in range(4)], VECTORS)
    assert {r["_cluster"] for r in clusters.cluster(same, k=3, width=2).collect()} == {0}  # ties: the smaller number


def test_clusters_refuse_what_they_cannot_do(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0], "a")], VECTORS)
    with pytest.raises(Exception, match="beyond"):
        clusters.cluster(df, width=2).collect()
    with pytest.raises(ValueError, match="reserved"):
        clusters.cluster(df.withColumnRenamed("extra", "_cluster"), width=2, keep=["vec_id", "_cluster"])


@pytest.mark.parametrize("width", [1, 3, 64])
def test_search_finds_the_nearest_and_measures_few(width):
    rng = np.random.default_rng(width)
    centroids = rng.integers(-2000, 2000, (300, width)) + rng.integers(-3000, 3000, (300, 1))
    centroids[17] = centroids[5]
    x = np.concatenate([centroids[[5, 17, 299]], rng.integers(-2000, 2000, (500, width)) + rng.integers(-3000, 3000, (500, 1))])
    who, distance, measured = clusters.Centroids(centroids).nearest(x)
    every = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert who.tolist() == every.argmin(axis=1).tolist() and distance.tolist() == every.min(axis=1).tolist()
    assert measured < 0.5 * every.size


def test_largest_distances_do_not_wrap():
    big = np.full((2, 128), clusters.LIMIT)
    assert clusters.Centroids(-big[:1]).nearest(big)[1].tolist() == [128 * (2 * clusters.LIMIT) ** 2] * 2


# --- positional index ------------------------------------------------------------

ITEM = "item_id long, text string, doc_id string"


def plain_words(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def scan(text, items, window, span=None):
    """(words, spans, items) of one text by trying every place."""
    words, hit, found = plain_words(text), set(), set()
    for item_id, item in items:
        w = plain_words(item)
        for a in range(max(1, len(w) - window + 1) if w else 0):
            part = w[a : a + window]
            for at in range(len(words)):
                if span is None:
                    run = len(part) if words[at : at + len(part)] == part else 0
                else:
                    here = words[at : at + span]
                    run = max(here.index(x) for x in part) + 1 if set(part) <= set(here) and here[0] in part else 0
                if run:
                    hit |= set(range(at, at + run))
                    found.add("" if item_id is None else str(item_id))
    spans = [(a, next(e for e in range(a, len(words) + 1) if e not in hit)) for a in sorted(hit) if a - 1 not in hit]
    return len(words), spans, sorted(found)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(4)
    vocabulary = ["the", "a", "ñandú", "x1", "Zeta", "über", "of", "42", "rare" * 3]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randrange(3, 9))) for i in range(12)]
    items += [(50, None), (51, " ... "), (None, "only once here"), (3, items[5][1]), (3, items[3][1]), (60, "THE, a--the!"), (61, "the " * 9)]
    texts = [say(rng.randrange(0, 60)) for _ in range(60)] + [None, "", "...", "the", "the a the", "the a", "the", "Only\x00once—here", "only once here only once here", "the " * 3000, items[0][1] + " " + items[1][1]]
    texts += [texts[0]] * 5
    return items, texts


@pytest.mark.parametrize(("span", "block", "segment"), [(None, 1 << 21, 1 << 23), (None, 7, 200), (5, 1 << 21, 300), (6, 20, 1 << 23)])
def test_index_finds_what_a_scan_finds(spark, documents, library, monkeypatch, span, block, segment):
    items, texts = library
    monkeypatch.setattr(index, "_PIECE", 4 if block == 7 else 1 << 16)
    texts = [t[:300] if t and span else t for t in texts]
    docs = documents([(i if i % 9 else None, t) for i, t in enumerate(texts)])
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], ITEM)
    postings = index.build(docs, keep=["doc_id", "lang"], segment_bytes=segment)
    out = index.find(postings, bench, window=4, span=span, block_words=block).collect()
    got = sorted((str(r.doc_id), r.n, [tuple(s) for s in r["_spans"]], r["_items"]) for r in out)
    want = sorted((str(i if i % 9 else None), *scan(t, items, 4, span)) for i, t in enumerate(texts))
    assert got == want
    assert sum(bool(w[2]) for w in want) > 10


def test_index_of_nothing(spark, documents):
    docs = documents([(1, "some words of a text")])
    bench = spark.createDataFrame([(1, "some words", None)], ITEM)
    none = index.find(index.build(docs, keep=["doc_id"]), bench.limit(0)).collect()
    assert [(r.doc_id, r.n, r["_spans"], r["_items"]) for r in none] == [(1, 5, [], [])]
    assert index.find(index.build(docs.limit(0), keep=["doc_id"]), bench).count() == 0
    with pytest.raises(ValueError, match="reserved"):
        index.build(docs.withColumnRenamed("lang", "segment"))
    with pytest.raises(ValueError, match="at least 1"):
        index.find(index.build(docs), bench, window=0)


def test_every_word_of_every_text_is_in_the_index(spark, documents, library):
    _items, texts = library
    postings = index.build(documents(list(enumerate(texts))), keep=["doc_id"])
    total = {r.word: r.n for r in postings.where("word is not null").groupBy("word").agg(F.sum(F.size("positions")).alias("n")).collect()}
    want = {}
    for t in texts:
        for w in plain_words(t):
            want[w] = want.get(w, 0) + 1
    assert total == want


# --- infilling ---------------------------------------------------------------------

TOKEN = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def planned(doc_id, text, rate=50, spm=80):
    """(units, form, prefix chars, middle chars, output) by slicing."""
    text = text or ""
    tokens = TOKEN.findall(text)
    digits = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infilling_as_by_slices(spark, documents):
    rng = random.Random(6)
    odd = [None, "", " ", "\n\t ", "one", " one", "one ", "a<P>b", "<S>", "x <M", "<", "ünï cödé — 漢字 😀 ", "  two words \x0b", "\x00 nul", "w " * 200_000]
    texts = odd + ["".join(rng.choice(["a", "ß", " ", "\n", "漢", "<", ">", "P", "😀"]) for _ in range(rng.randrange(40))) for _ in range(200)]
    rows = list(enumerate(texts)) + [(None, "a null id"), (3, "x y z"), (3, "x y z")]
    out = infill.restored(infill.fill_in_middle(documents(rows), rate=90)).collect()
    got = sorted((str(r.doc_id), str(r.text), r["_units"], r["_form"], str(r["_prefix_chars"]), str(r["_middle_chars"]), r["_output"], r["_restored"], r.lang) for r in out)
    want = []
    for i, t in rows:
        n, form, p, m, output = planned(i, t, rate=90)
        want.append((str(i), str(t), n, form, str(p), str(m), output, t or "", "en"))
    assert got == sorted(want)
    assert {w[3] for w in want} == {"plain", "psm", "spm"}


def test_infilling_of_nothing_and_clashes(spark, documents):
    assert infill.restored(infill.fill_in_middle(documents([]), keep=["doc_id"])).count() == 0
    with pytest.raises(ValueError, match="already"):
        infill.fill_in_middle(documents([(1, "a")]).withColumnRenamed("lang", "_form"))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n<PSM>é😀", max_size=60), st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4))
def test_rotations_invert(text, h):
    output, form, *_ = infill.rotate(text.encode(), h, rate=100)
    assert bytes(infill.restore(bytes(output), form)) == text.encode()


@pytest.mark.parametrize("swap", [1, 3, 1 << 16])
def test_blocks_change_places(monkeypatch, swap):
    monkeypatch.setattr(infill, "_SWAP", swap)
    data = bytes(range(50))
    for start, cut, end in [(0, 0, 50), (0, 50, 50), (3, 20, 41), (5, 6, 7), (9, 9, 9)]:
        buffer = bytearray(data)
        infill.exchange(buffer, start, cut, end)
        assert bytes(buffer) == data[:start] + data[cut:end] + data[start:cut] + data[end:]


def test_words_are_cut_as_the_pattern_says():
    texts = ["A b-C", None, "", "é1_x\x7f\x00y", "Zß  "]
    words = index.words_of(pa.array([t or "" for t in texts]))
    got = [[words.words[c].decode() for c in words.codes[words.rows == i]] for i in range(len(texts))]
    assert got == [plain_words(t) for t in texts]
