"""Operators on documents against brute force, with nulls, empty and long texts, repeats, no rows and extra columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from callroute.llm import common, mixing, packing, quality, queries, scoring, simhash, suffix


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}é" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base, passage = prose(rng, 300), prose(rng, 60)
    out = [(i, prose(rng, rng.randrange(1, 120))) for i in range(40)]
    out += [(100, base), (101, base), (102, base.replace("w7é", "changed", 1)), (103, prose(rng, 30) + " " + passage + " " + prose(rng, 30))]
    out += [(104, passage + "\t\n" + prose(rng, 9)), (105, prose(rng, 20) + " " + passage), (106, "ab" * 300), (107, None), (108, ""), (109, " \n\t ")]
    out += [(110, "Two Words"), (110, "Two Words"), (None, passage), (111, prose(rng, 30_000, 10**6)), (112, "<|endoftext|> \x01 x<|startoftext|>y   İΣ")]
    return out


# --- suffix-array dedup


def covered(texts, window=suffix.WINDOW):
    """By brute force: for each text the bytes of windows that start at two places or more."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + window] for b in data for i in range(len(b) - window + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        out.append((b, gone))
    return out


@pytest.mark.parametrize("limit", [20_000, 0])
def test_repeats_are_dropped_as_by_brute_force(documents, rows, limit):
    expected = collections.Counter()
    for (doc_id, _), (b, gone) in zip(rows, covered([t for _, t in rows]), strict=True):
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = tuple(m.span() for m in re.finditer(b"\1+", bytes(gone)))
        expected[doc_id, kept, spans] += 1
    found = suffix.drop_repeats(documents(rows), group_limit=limit).collect()
    got = collections.Counter((r.doc_id, bytes(r._kept), tuple((s.start, s.end) for s in r._spans)) for r in found)
    assert got == expected
    assert any(spans for _, _, spans in expected)


def test_long_text_in_pieces(documents, monkeypatch):
    rng = random.Random(2)
    unique, part = prose(rng, 3_000, 10**7), prose(rng, 80, 10**7)
    text = unique[:9_000] + part + unique[9_000:] + part
    monkeypatch.setattr(suffix, "PIECE", 4_096)
    data = np.frombuffer(text.encode(), np.uint8)
    whole = suffix._Text(data, np.array([0, len(data)]), np.zeros(1, np.uint64))
    pieces = [t for t in suffix._pieces(data, np.zeros(1, np.uint64))]
    assert np.concatenate([t.a + t.begin for t in pieces]).tolist() == whole.a.tolist()
    assert np.concatenate([t.ctx for t in pieces]).tolist() == whole.ctx.tolist()


def test_columns_shared_against_all_pairs():
    rng = random.Random(1)
    bodies = [bytes(rng.choices(b"ab", k=rng.randrange(5, 12))) for _ in range(40)]
    lead = np.array([rng.randrange(0, 12 - len(b) + 1) for b in bodies])
    got = suffix.columns_shared(bodies, lead, 12, 4)

    def at(i, t):
        s = bodies[i][t - lead[i] : t - lead[i] + 4] if t >= lead[i] else b""
        return s if len(s) == 4 else None

    for i in range(40):
        for t in range(9):
            assert got[i, t] == (at(i, t) is not None and any(at(j, t) == at(i, t) for j in range(40) if j != i))


# --- SimHash near-dedup


def brute_fingerprint(text, n=4):
    w = words_of(text)
    shingles = [" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_classes_as_by_brute_force(documents, rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)].append(doc_id)
    expected = collections.Counter((doc_id, prints[i], min(least[root(i)], default=None)) for i, (doc_id, _) in enumerate(rows))
    found = simhash.near_duplicates(documents(rows)).collect()
    assert collections.Counter((r.doc_id, r._fingerprint % (1 << 64), r._component) for r in found) == expected


@pytest.mark.parametrize("cell,parts", [(4_000, simhash.PARTS), (5, simhash.PARTS), (4_000, (2,)), (5, (3,)), (4_000, (4,))])
def test_links_connect_what_is_near(spark, cell, parts):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))) for _ in range(60)} | {rng.getrandbits(64) for _ in range(100)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    links = simhash.link(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, parts, cell)
    classes = {r.node: r.root for r in common.components(links).collect()}
    parent = {p: p for p in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in signed:
        for b in signed:
            if ((a ^ b) % (1 << 64)).bit_count() <= 4:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert {p: classes.get(p, p) for p in signed} == {p: root(p) for p in signed}


def test_thresholds_always_cover_the_distance():
    rng = np.random.default_rng(0)
    values = [rng.integers(0, 1 << 21, 50, dtype=np.uint64) for _ in range(3)]
    counts = [rng.integers(0, 50, 1 << 12).astype(float) for _ in range(3)]
    dealt, cost = simhash.deal_thresholds(values, [22, 21, 21], counts, 4)
    assert (dealt.sum(axis=1) == 4 - 3 + 1).all() and (dealt >= -1).all() and (cost > 0).all()


def test_more_fingerprints_take_fewer_partitions(spark):
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 64, 2_000, dtype=np.uint64)
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    groups, counts = simhash.choose_partitions(frame, 4)
    assert len(groups) == 5 and sorted(b for g in groups for b in g) == list(range(64)) and all(c.sum() == 2_000 for c in counts)

    def cheapest(times):
        cost = {}
        for n in simhash.PARTS:
            some = simhash.group_bits(np.eye(64) * 1_000, 2_000, n)
            histograms = [np.full(1 << min(12, len(g)), 2_000 * times / (1 << min(12, len(g)))) for g in some]
            cost[n] = simhash.deal_thresholds(simhash.part_values(prints, some), [len(g) for g in some], histograms, 4)[1].sum()
        return min(cost, key=cost.get)

    assert [cheapest(x) for x in (1, 150, 5_000, 10**6)] == [5, 4, 3, 2]


# --- LM scoring


def test_kneser_ney_as_written_out(documents, rows):
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 or i is None]
    tokens = [[*words_of(t), "\n"] for t in train]
    u, b = collections.Counter(), collections.Counter()
    for w in tokens:
        u.update(w)
        b.update(zip(["<s>", *w], w, strict=False))
    followers, continuations, given = collections.Counter(), collections.Counter(), collections.Counter()

    def discounts(counts):
        n = collections.Counter(counts)
        return scoring.discounts(n[1], n[2], n[3], n[4])

    d2 = discounts(b.values())
    for (v, w), c in b.items():
        followers[v] += c
        continuations[w] += 1
        given[v] += d2[min(c, 3)]
    d1 = discounts(continuations.values())
    spare = sum(d1[min(c, 3)] for c in continuations.values()) / len(b)

    def chance(v, w):
        c = continuations[w]
        alone = max(c - d1[min(c, 3)], 0) / len(b) + spare / (len(u) + 1)
        if not followers[v]:
            return alone
        return max(b[v, w] - d2[min(b[v, w], 3)], 0) / followers[v] + given[v] / followers[v] * alone

    assert sum(chance("w1é", w) for w in u) + given["w1é"] / followers["w1é"] * spare / (len(u) + 1) == pytest.approx(1)
    docs = documents(rows)
    model = scoring.train(docs.where(quality.learnable("doc_id", 7, 2)), shard_bytes=20_000)
    total = sum(u.values())
    assert (model.tokens, model.words, model.pairs) == (total, len(u), len(b))
    found = scoring.score(docs, model, keep=["doc_id", "text"]).collect()
    assert len(found) == len(rows)
    for r in found:
        w = [*words_of(r.text), "\n"]
        assert (r._tokens, r._known) == (len(w), sum(u[x] > 0 for x in w))
        assert r._base == pytest.approx(sum(math.log10((u[x] + 1) / (total + len(u) + 1)) for x in w))
        assert r._score == pytest.approx(sum(math.log10(chance(v, x)) for v, x in zip(["<s>", *w], w, strict=False)))


# --- packing


def test_pieces_and_sequences(documents, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = Tokenizer.from_file(path)
    expected = collections.Counter()
    for doc_id, text in rows:
        ids = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        expected.update((doc_id, j, s, len(ids[s : s + 2048]), tuple(ids[s : s + 2048].tolist())) for j, s in enumerate(range(0, len(ids), 2048)))
    found = packing.pack(documents(rows), path, keep=["doc_id"]).collect()
    assert collections.Counter((r.doc_id, r._piece, r._start, r._length, tuple(r._ids)) for r in found) == expected
    assert all(zlib.crc32(np.array(r._ids, "<u4")) == r._crc32 for r in found)
    held = collections.defaultdict(list)
    for r in found:
        held[r._sequence].append((r._offset, r._length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("seed", range(20))
def test_plan_places_every_rank_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 2048])
    counts = {n: rng.randrange(1, 50) for n in rng.sample(range(1, capacity + 1), min(capacity, 30))}
    used, ranks = collections.defaultdict(list), collections.Counter()
    for length, first, end, sequence, offset in packing.plan(counts, capacity):
        for k in range(end - first):
            used[sequence + k].append((offset, length))
            ranks[length, first + k] += 1
    assert ranks == collections.Counter((n, r) for n, c in counts.items() for r in range(c))
    for pieces in used.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        assert sum(n for _, n in pieces) <= capacity
    # best fit over single pieces needs as many sequences
    rooms: list[int] = []
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fitting = [(room, i) for i, room in enumerate(rooms) if room >= length]
        if fitting:
            rooms[min(fitting)[1]] -= length
        else:
            rooms.append(capacity - length)
    assert len(used) == len(rooms)


# --- quality classifier


def test_classifier_learns_a_habit_and_takes_any_row(spark, documents, rows):
    rng = random.Random(9)
    good = [(1000 + i, prose(rng, 40, 10**6)) for i in range(150)]
    bad = [(2000 + i, prose(rng, 40, 10**6).replace(" ", "!! ")) for i in range(150)]
    labels = spark.createDataFrame([(i, int(i < 2000)) for i, _ in good + bad] + [(None, 1), (1000, None)], "doc_id long, quality int")
    docs = documents(good + bad + rows)
    weights = quality.train(docs.where(quality.learnable("doc_id")), labels.where(quality.learnable("doc_id")))
    found = quality.score(docs, weights).collect()
    assert len(found) == len(good + bad + rows) and all(0 <= r._score <= 1 for r in found)
    held = [r for r in found if r.doc_id and r.doc_id >= 1000 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert held and all((r._score >= 0.5) == (r.doc_id < 2000) for r in held)


def test_without_labels_every_score_is_even(documents, rows, spark):
    weights = quality.train(documents(rows), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r._score for r in quality.score(documents(rows), weights).collect()} == {0.5}


# --- mixing


def test_raking_meets_the_marginals(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("abc"), rng.choice(["x", "y", None]), rng.randrange(1, 50)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n long")
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": 0.5}
    out = mixing.mix(docs, targets, "n", 0.4, rounds=20).collect()
    assert len(out) == 3000
    expected = sum(r.n * r._probability for r in out)
    assert expected == pytest.approx(0.4 * sum(r.n for r in out))
    for value, share in targets["source"].items():
        assert sum(r.n * r._probability for r in out if r.source == value) / expected == pytest.approx(share, abs=1e-6)
    assert sum(r.n for r in out if r._kept) == pytest.approx(expected, rel=0.1)


def test_mixing_of_nothing_and_odd_weights(spark):
    schema = "doc_id long, source string, lang string, topic string, n long, extra string"
    assert mixing.mix(spark.createDataFrame([], schema), mixing.TARGETS, "n", 0.5).count() == 0
    rows = [(1, "a", "en", "t", None, "e"), (2, "a", "xx", "t", 5, "e"), (3, None, "en", None, 5, "e"), (3, None, "en", None, 5, "e"), (None, "a", "en", "t", 7, "e")]
    out = mixing.mix(spark.createDataFrame(rows, schema), mixing.TARGETS, "n", 1.0).collect()
    assert len(out) == 5 and "extra" in out[0].asDict()
    assert not any(r._kept for r in out if r.lang == "xx") and all(r._kept for r in out if r.lang == "en")


def test_languages_without_a_target_are_still_sampled(spark, tmp_path):
    rng = random.Random(6)
    listed = mixing.TARGETS["lang"]
    langs = {*listed, "nl", None}
    rows = [(i, "some words of it " * rng.randrange(1, 9), rng.choice(["en"] * 6 + ["de", "fr", "es", "nl", None]), rng.choice("ab")) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    lang = {r[0]: r[2] for r in rows}
    assert {lang[r.doc_id] for r in queries.op2_mixing(spark, str(tmp_path)).collect() if r.kept} == langs
    assert {r.lang for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()} == langs
    marked = docs.withColumn("topic", mixing.topic("text")).withColumn("n", mixing.words("text"))
    words, sampled = collections.Counter(), collections.Counter()
    for r in mixing.mix(marked, mixing.TARGETS, "n", 0.3, rounds=20, unlisted=True).collect():
        words[r.lang] += r.n
        sampled[r.lang] += r.n * r._probability
    rest = sum(words[k] for k in listed) / words.total()
    for k in langs:
        assert sampled[k] / sampled.total() == pytest.approx(listed[k] * rest if k in listed else words[k] / words.total(), abs=1e-6)


# --- all of them


def test_empty_tables(spark, documents):
    none = documents([])
    assert suffix.drop_repeats(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    model = scoring.train(none)
    assert scoring.score(none, model).count() == 0
    only = scoring.score(documents([(1, "a b")]), model).first()
    assert (only._tokens, only._known, only._base, only._score) == (3, 0, 0.0, 0.0)


def test_clashing_columns_are_refused_and_others_kept(documents, rows):
    docs = documents(rows[:3]).withColumn("shard", F.lit("s")).withColumn("key", F.lit(1.5))
    assert {"shard", "key", "_kept"} <= set(suffix.drop_repeats(docs).columns)
    assert suffix.drop_repeats(docs).where("shard = 's' and key = 1.5").count() == 3
    for call in (lambda d: suffix.drop_repeats(d), lambda d: quality.score(d, np.zeros(5, np.float32)), lambda d: packing.pack(d, "x"), lambda d: scoring.score(d, None)):
        with pytest.raises(ValueError, match="reserved"):
            call(docs.withColumn("_text", F.lit(1)))


def test_digest_of_the_registered_suffix_query(spark, tmp_path, documents, rows):
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op8_suffix_dedup"](spark, str(tmp_path)).collect()
    expected = collections.Counter()
    for (doc_id, _), (b, gone) in zip(rows, covered([t for _, t in rows]), strict=True):
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        expected[doc_id, len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == expected


def test_words_by_themselves_give_the_ids_of_whole_texts(monkeypatch):
    """Capitals, special tokens in any case, the sign between words, and words forgotten and met again."""
    import public_tokenizers
    import pyarrow as pa
    import tokenizers

    from callroute.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, words = tokenizers.Tokenizer.from_file(path), packing.Tokenizer(path)
    monkeypatch.setattr(packing, "_CACHE_WORDS", 40)
    odd = ["", "  \t\x0b ", "É É İ İ ẞ Kelvin K", "<|StartOfText|> Don'T x<|endoftext|>Y", "A \x01 B a\x01b", "THE the The"]
    texts = odd + [" ".join(f"Word{j}, word{j % 7}." for j in range(i, i + 15)) for i in range(60)] + odd
    for i in range(0, len(texts), 5):
        ids, at = words.encode(pa.array(texts[i : i + 5]))
        for k, text in enumerate(texts[i : i + 5]):
            assert ids[at[k] : at[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids
