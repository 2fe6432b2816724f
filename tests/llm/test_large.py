"""What must hold for tables larger than a test can be: plans and files."""

from __future__ import annotations

import numpy as np

from callroute.llm import topk


def test_query_blocks_are_not_gathered_on_the_driver(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = np.random.default_rng(5)
    vectors = rng.integers(-9, 9, (200, 6)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").coalesce(1)
    written = []
    cut = topk.common.cut

    def noted(*args, **options):
        written.append(cut(*args, **options))
        return written[-1]

    monkeypatch.setattr(topk.common, "cut", noted)
    found = topk.top_k(df, df.where("vec_id % 5 = 0"), k=3, scale=1)
    rows = found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    # one task wrote 13 blocks of candidates: no file holds more than FILE_BLOCKS of them
    files = written[0].groupBy("_metadata.file_name").count().collect()
    assert sum(r["count"] for r in files) == 13 and max(r["count"] for r in files) <= topk.FILE_BLOCKS
    scores = vectors @ vectors.T
    want = []
    for q in range(0, 200, 5):
        best = sorted((c for c in range(200) if c != q), key=lambda c: (-scores[q, c], c))[:3]
        want += [(q, rank, c, int(scores[q, c])) for rank, c in enumerate(best, 1)]
    assert sorted(map(tuple, rows)) == sorted(want)
