"""The pipeline against a plain one: every stage's rows recomputed from its own input without Spark."""

from __future__ import annotations

import collections
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F
from test_documents import brute_fingerprint, covered
from test_mended import plain_ftrl
from tokenizers import Tokenizer

import corpus_pipeline
from callroute.llm import mixing, quality

BITS = 18


def features(text):
    f = quality.Features(pa.array([text or ""]), BITS)
    x = {}
    for b in np.concatenate(f.bucket).tolist():
        x[b] = x.get(b, 0.0) + float(f.weight[0])
    return {**x, 1 << BITS: 1.0}


def plain_quality(spark, rows, labels):
    learn = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    order = [r.id for r in spark.createDataFrame([(i,) for i in learn], "id long").orderBy(F.xxhash64("id", F.lit(1)), "id").collect()]
    texts, marks = {r.doc_id: r.text for r in rows}, dict(labels)
    weight = plain_ftrl([(features(texts[i]), marks[i]) for i in order], 2.0, 0.05, 1e-4, 0.0, epochs=2)
    score = {t: 1 / (1 + math.exp(-sum(weight(i) * v for i, v in features(t).items()))) for t in {r.text for r in rows}}
    assert all(abs(s - 0.5) > 1e-3 for t, s in score.items() if t)
    return [r for r in rows if score[r.text] >= 0.5]


def plain_simhash(rows):
    prints = [brute_fingerprint(r.text or "") for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        best = least.setdefault(root(i), r)
        if (r.doc_id is None, r.doc_id or 0) < (best.doc_id is None, best.doc_id or 0):
            least[root(i)] = r
    return list(least.values())


def plain_suffix(rows):
    out = []
    for r, (data, gone) in zip(rows, covered([r.text for r in rows]), strict=True):
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((r.doc_id, r.text if not any(gone) else kept.decode("utf-8", "replace")))
    return out


def test_every_stage_as_by_a_plain_pipeline(spark, tmp_path, documents):
    rng = random.Random(21)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = prose(60)
    rows = [(i, prose(70), ["en", "de", "xx"][i % 3], "ab"[i % 2]) for i in range(120)]
    rows += [(500 + i, prose(70).replace(" ", "!! "), "en", "a") for i in range(60)]
    rows += [(700 + i, rows[i][1], "en", "b") for i in range(10)] + [(720 + i, rows[20 + i][1] + " more", "fr", "a") for i in range(5)]
    rows += [(800 + i, f"{prose(15)} {shared} {prose(15)}", "es", "b") for i in range(6)] + [(900, None), (901, prose(9)), (902, "ünï " + prose(20))]
    folder = str(tmp_path)
    documents(rows).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], int(r[0] < 500)) for r in rows if r[0] < 600]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = lambda rows: sorted((r.doc_id, r.text or "") for r in rows)

    def taken(name, docs):
        path = f"{folder}/{name.replace(' ', '-')}.parquet"
        stages[name](spark, docs, folder).write.parquet(path)
        return spark.read.parquet(path)

    good = taken("quality classifier", docs)
    assert kept(good.collect()) == kept(plain_quality(spark, docs.collect(), labels))
    single = taken("SimHash near-dedup", good)
    assert kept(single.collect()) == kept(plain_simhash(good.collect()))
    whole = taken("suffix-array dedup", single)
    assert sorted((r.doc_id, r.text or "") for r in whole.collect()) == sorted((i, t or "") for i, t in plain_suffix(single.collect()))
    mixed = taken("mixing sources to target weights", whole)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/suffix-array-dedup.parquet/*.parquet')")
    cursor = con.execute(mixing.oracle_sql())
    at = [d[0] for d in cursor.description].index("kept")
    wanted = [r[0] for r in cursor.fetchall() if r[at]]
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(wanted) and 50 < len(wanted) < whole.count()
    packed = taken("best-fit packing", mixed).collect()
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {r.doc_id: len(encoder.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed.collect()}
    got = collections.defaultdict(int)
    for r in packed:
        got[r.doc_id] += r["_length"]
    assert got == lengths
    places = collections.defaultdict(list)
    for r in packed:
        places[r["_sequence"]].append((r["_offset"], r["_length"]))
    for parts in places.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 2048
    assert len(places) <= math.ceil(sum(lengths.values()) / 2048) + 1
