"""Operators on vectors, conversations and pages, and the pipeline's stages."""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from callroute.llm import chat, embeddings, extract, simhash, topk

VECTORS = "vec_id long, embedding array<float>, label int, extra string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 24))
    rows = [(i, (centres[i % 6] + rng.normal(scale=0.25 * (i % 3), size=24)).astype(np.float32).tolist(), i % 2) for i in range(300)]
    rows += [(400, rows[0][1], 0), (401, rows[0][1], 0), (402, rows[0][1], 1), (401, rows[0][1], 0)]
    rows += [(500, None, 0), (501, [0.0] * 24, 0), (502, [float("nan")] * 24, 0), (503, [None] * 24, 0), (504, [float("inf")] * 24, 1), (505, rows[3][1], None), (506, [1.0, 2.0], 0), (550, [], 1)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], VECTORS)


def whole(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("tile", [8, 1_024])
def test_embedding_links_as_by_brute_force(vectors, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rows, df = vectors
    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def unit(v):
        x = np.array(v, float)
        return x / np.linalg.norm(x)

    fit = [whole(r[1]) and any(r[1]) and r[2] is not None for r in rows]
    for i in range(n):
        for j in range(i):
            if fit[i] and fit[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and unit(rows[i][1]) @ unit(rows[j][1]) >= 0.93:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    expected = sorted((r[0], links[i], least[root(i)], r[0] == least[root(i)]) for i, r in enumerate(rows))
    assert sorted(tuple(r) for r in embeddings.near_duplicates(df).collect()) == expected
    assert sum(links) > 100
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_boxes_that_are_near_meet(spark):
    """Of random boxes on one to three axes all pairs within the reach are met, once each, and no other."""
    rng = np.random.default_rng(5)
    for axes, reach in ((1, 0.3), (2, 0.05), (3, 0.374)):
        low = rng.uniform(-1, 1, size=(60, axes))
        high = low + rng.uniform(0, 0.3, size=(60, axes))
        gap = np.maximum(0, np.maximum(low[:, None] - high[None], low[None] - high[:, None]))
        near = np.triu((gap**2).sum(axis=2) <= reach**2)
        df = spark.createDataFrame([("l", axes, i, low[i].tolist(), high[i].tolist()) for i in range(60)], "label string, dims int, tile long, low array<double>, high array<double>")
        found = sorted(map(tuple, embeddings.near_tiles(df, reach).collect()))
        assert found == sorted(zip(*(x.tolist() for x in np.nonzero(near)), strict=True)) and len(found) < 60 * 61 // 2


@pytest.mark.parametrize("tile", [7, 1_024])
def test_tiles_find_every_pair(tile):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(tile, 12)) + 1.5
    axes = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    u = a / np.linalg.norm(a, axis=1, keepdims=True)
    i, j = embeddings.near_pairs(a, a, axes, 0.93, same=True)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(np.triu(u @ u.T >= 0.93, 1))), strict=True))


@pytest.mark.parametrize("block", [16, 8_192])
def test_top_k_as_by_brute_force(vectors, monkeypatch, block):
    rows, df = vectors
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", max(2, block // 8))
    fit = [(r[0], np.floor(256 * np.array(r[1], float))) for r in rows if whole(r[1])]

    def product(a, b):
        n = min(len(a), len(b))
        return int(a[:n] @ b[:n])

    expected = []
    for i, q in {i: q for i, q in fit if i % 50 == 0}.items():
        best = sorted((-product(q, x), j) for j, x in fit if j != i)[:5]
        expected += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    found = topk.top_k(df, df.where("vec_id % 50 = 0"))
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("queries", [2, 512])
def test_repeated_queries_keep_their_answers(vectors, spark, monkeypatch, queries):
    rows, df = vectors
    monkeypatch.setattr(topk, "QUERIES", queries)
    asked = [(50, rows[50][1], 0, "x")] * 5 + [(50, [4 * x for x in rows[7][1]], 0, "x"), (100, rows[100][1], 0, "x")]
    candidates = [(r[0], np.floor(256 * np.array(r[1], float))) for r in rows[:300]]
    expected = set()
    for i, v, *_ in asked:
        q = np.floor(256 * np.array(v, np.float32).astype(float))
        best = sorted((-int(q @ x), j) for j, x in candidates if j != i)[:5]
        expected |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    found = topk.top_k(df.where("vec_id < 300"), spark.createDataFrame(asked, VECTORS).repartition(3))
    assert len(expected) == 15 and sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_bound_drops_candidates_but_never_a_result():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(2_000, 64)) * np.geomspace(1, 0.01, 64))
    m = np.ascontiguousarray(x.T)
    rest = [np.sqrt((m[i:] ** 2).sum(axis=0)) for i in range(0, 64, topk.STEP)] + [np.zeros(2_000)]
    ids = np.arange(2_000)
    for q in range(20):
        got, score = topk.best(x[q], q, ids, m, rest, 5)
        every = sorted((-int(x[q] @ x[j]), j) for j in ids if j != q)[:5]
        assert [(int(-s), int(j)) for j, s in zip(got, score, strict=True)] == every


# --- chat


def turns_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, extra string").withColumn("parts", chat.text_part(F.col("text")))


def test_texts_come_back_whatever_they_hold(spark):
    rng = random.Random(7)
    bits = ["<|im_end|>", "<|im_start|>", "&", "&lt;", "<", "|", "\n", "é𝄞", "&amp;", "assistant\n", " ", "\\", "&nl;"]
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem", "<|im_end|>&nl;"]), "".join(rng.choices(bits, k=rng.randrange(0, 12))), "x") for c in range(30) for t in range(rng.randrange(1, 8))]
    rows += [(99, 0, None, None, "x"), (99, None, "assistant", "first", "x"), (98, 0, "assistant", "same", "x"), (98, 0, "assistant", "same", "x"), (None, 0, "user", "n", "x"), (97, 0, "assistant", "ü" * 200_000, "x")]
    out = chat.format_chats(turns_of(spark, rows)).withColumn("back", chat.read_back()).withColumn("loss", chat.under_mask()).collect()
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert {r.conv_id for r in out} == set(by)
    for r in out:
        mine = sorted(by[r.conv_id], key=lambda x: x[:2])
        got = [(b.role, b.text) for b in r.back]
        assert sorted(got) == sorted(x[2:] for x in mine) and r.n_turns == len(mine)
        if len({x[:2] for x in mine}) == len(mine):
            assert got == [x[2:] for x in mine]
        assert list(r.loss) == [text for role, text in got if role == "assistant"]
        for s in r.loss_spans:  # the spans are places of the whole text
            assert html.unescape(r.formatted[s.start : s.start + s.length].replace("&nl;", "&amp;nl;")) == r.back[s.turn].text or "&" in r.back[s.turn].text
    assert chat.format_chats(turns_of(spark, rows).limit(0)).count() == 0


def test_parts_of_every_kind(spark):
    row = spark.sql(
        f"""select 1L as conv_id, 0L as turn, 'user' as role, from_json('[
        {{"type":"text","text":"see <|image|>"}},{{"type":"image","ref":"a.png"}},{{"type":"audio","ref":"b.wav","size":1281}},
        {{"type":"document","ref":"c.pdf","size":9}},{{"type":"video","ref":"d"}},{{"type":"image"}},null]', 'array<{chat.PART}>') as parts"""
    )
    r = chat.format_chats(row).first()
    assert r.formatted == "<|im_start|>user\nsee &lt;|image|><|image|><|audio|><|document|><|other|><|image|><|im_end|>\n"
    assert [(a.kind, a.ref, a.turn, a.tokens) for a in r.attachments] == [("image", "a.png", 0, 256), ("audio", "b.wav", 0, 3), ("document", "c.pdf", 0, 3), ("other", "d", 0, 0), ("image", None, 0, 256)]
    assert r.expanded_tokens == 518


# --- pages

MODEL = extract.train(extract.PAGES)


def test_training_pages_give_their_main_text():
    for page in extract.PAGES[:6]:
        text = MODEL.extract(re.sub(r"\s*data-(main|skip)", "", page))
        assert "Plain words" in text and "Buy" not in text and "Home" not in text and "Contact" not in text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<nav><a href=/x>Menu</a></nav><article><h1>A&amp;B</h1><p>One\n  two<br>three <b>fo</b>ur.</p><script>x('</p>')</script></article><footer>f</footer>", "A&B One two three four."),
        ("<article><p>Body of it.<aside>Side</aside><p>More.<form>Join</form><div class='comments'><p>Reader words</p></div>", "Body of it. More."),
        ("<article>" + "<div>" * 8 + "<p>deep", "deep"),
        ("<article><div><div><p>In.</p></div></div><div>Also in.</div></article>", "In. Also in."),
        ("<article><p>" + "long words " * 50_000 + "</p></article>", ("long words " * 50_000).strip()),
        ("", ""),
        ("<!-- only a note", ""),
    ],
)
def test_pages(source, text):
    assert MODEL.extract(source) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<article><p>Body of it.</p><svg class='i' width=1/><p>More.</p></article>", "Body of it. More."),
        ("<article><p>Body of it.</p><svg/><p>More.</p><svg><title>x</title></svg><p>Last.</p></article>", "Body of it. More. Last."),
        ("<article><p><a title=Don't href=x>Body</a> of it.</p><p>It's more.</p></article>", "Body of it. It's more."),
        ('<article><p title="a"">Body of it.</p><p title="b">More.</p></article>', "Body of it. More."),
        ('<article><p title="a"">Body of it.</p></article>', "Body of it."),
        ("<article><p ' title = 'a>b' \">Body of it.</p><p =\"a>More.</p><p title=a=\"b>Last.</p>", "Body of it. More. Last."),
        ('<article><p title="a>Body of it.</p></article>', "Body of it."),
    ],
)
def test_self_closed_pictures_and_stray_quotes_swallow_nothing(source, text):
    assert MODEL.extract(source) == text


def test_stray_quotes_cost_no_more_than_the_page():
    assert len(extract.Page("<a b='" * 50_000 + '<a b="' * 50_000).tag) < 100_002


def test_depth_has_no_limit():
    assert all(np.isfinite(MODEL.marginals(extract.Page("<article>" + "<div>" * 50_000 + "deep"))))


def test_marginals_are_those_of_all_assignments():
    page = extract.Page("<div class='ad'><p>a<b>c</b></p></div>")
    n = len(page.tag)
    weight, node = np.zeros((n, 2)), [(MODEL.root, 0, 0)]
    node += [MODEL.node(page.tag[i], page.data[i], page.tag[page.parent[i]], len(page.data[i].strip()) if page.tag[i] == "#text" else 0) for i in range(1, n)]
    for k in range(1 << n):
        x = [k >> i & 1 for i in range(n)]
        p = np.exp(sum(o for o, v in zip((m[0] for m in node), x, strict=True) if v))
        for i in range(1, n):
            c = node[i][1 + x[page.parent[i]]]
            p *= c if x[i] else 1 - c
        for i in range(n):
            weight[i, x[i]] += p
    assert MODEL.marginals(page) == pytest.approx(np.log(weight[:, 1] / weight[:, 0]).tolist())


def test_pages_table(spark):
    rows = [(1, "u", "<article>x</article>", 0.5), (1, "u", "<article>x</article>", 0.5), (2, None, None, None), (None, "v", "", 1.0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, extra double")
    found = extract.main_text(df)
    assert sorted((r.page_id or 0, r._text) for r in found.collect()) == [(0, ""), (1, "x"), (1, "x"), (2, "")]
    assert "extra" in found.columns and extract.main_text(df.limit(0)).count() == 0


# --- pipeline


def test_one_document_of_a_group_stays_whatever_its_ids(spark, documents):
    rng = random.Random(12)

    def group(n=3):
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
        return [text + " " * i for i in range(n)]  # the same words

    nulls, same, mixed, plain = group(), group(), group(), group()
    rows = [(None, t) for t in nulls] + [(1, t) for t in same] + [(1, same[0])] + [(None, mixed[0]), (2, mixed[1]), (None, mixed[2])] + [(5, plain[0]), (4, plain[1]), (6, plain[2])]
    rows += [(1, "alone under an id of others"), (None, "alone without an id")]
    roots = {r._root for r in simhash.near_duplicates(documents(rows)).collect()}
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.simhash_dedup(spark, documents(rows), "").collect()]
    assert len(roots) == 6 and len(kept) == 6
    assert sum((None, t) in kept for t in nulls) == 1 and sum((1, t) in kept for t in same) == 1
    assert {(2, mixed[1]), (4, plain[1]), *rows[-2:]} <= set(kept)


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path, documents):
    rng = random.Random(11)

    def prose(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    good = [(i, prose(80)) for i in range(200)]
    bad = [(1000 + i, prose(80).replace(" ", "!! ")) for i in range(100)]
    passage = prose(60)
    more = [(2000, good[0][1]), (2001, prose(20) + " " + passage), (2002, passage + " " + prose(20)), (2003, None), (2003, None), (None, prose(9))]
    documents(good + bad + more).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + bad], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        kept.append({(r.doc_id) for r in docs.select("doc_id").collect()})
        if stage is not corpus_pipeline.pack_sequences:
            assert docs.columns == corpus_pipeline.COLUMNS
        if stage is corpus_pipeline.suffix_dedup:
            texts = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
            assert passage not in texts[2001][0] and passage not in texts[2002][0] and texts[5] == (good[5][1], len(good[5][1]))
    assert all(i in kept[0] for i, _ in good) and not any(i in kept[0] for i, _ in bad)
    assert 2000 not in kept[1] and 0 in kept[1] and kept[1] >= {i for i, _ in good}
    assert kept[2] == kept[1] and 100 < len(kept[3]) < len(kept[2]) and kept[4] == kept[3]
