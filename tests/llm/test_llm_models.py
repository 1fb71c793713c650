"""Encoding, scores, languages, pages and top-k search: exact round trips, brute force and held-out accuracy."""

import struct

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import bpe, html_extract, langid, topk, toxicity


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.word_vocabulary()


@pytest.fixture(scope="module")
def reference(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@pytest.fixture(scope="module")
def coder(vocabulary):
    return bpe.Bpe(vocabulary)


def same(coder, reference, text):
    packed, decoded = coder.encode(text)
    ids = reference.encode(text or "", add_special_tokens=False).ids
    return list(struct.unpack(f"<{len(packed) // 4}I", packed)) == ids and decoded == reference.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.characters(min_codepoint=1, max_codepoint=0x24F), max_size=60))
def test_encoding_is_the_librarys(coder, reference, text):
    assert same(coder, reference, text)


def test_encoding_of_every_code_point(coder, reference):
    points = [c for c in [*range(1, 0x33480), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}1{chr(c)}{chr(c)}b" for c in points]
    wrong = [hex(c) for c, t, e in zip(points, texts, reference.encode_batch(texts, add_special_tokens=False)) if coder.encode(t)[0] != struct.pack(f"<{len(e.ids)}I", *e.ids)]
    assert not wrong


def test_encoding_of_awkward_texts(spark, coder, reference, vocabulary):
    texts = [None, "", " ", "a<|endoftext|>b <|startoftext|>", "ΣΑΣ İ ǅ", "don't I'LL 'sx", "a" * 5000, "日本語 한국어", "12½ x1y", "xyz" * 30 + " " + "word " * 500]
    assert all(same(coder, reference, t) for t in texts)
    df = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)] + [(1, "", "old")], "doc_id long, text string, ids string")
    out = bpe.encode_texts(spark, df, vocabulary)
    assert out.columns == ["doc_id", "text", "ids", "decoded"] and out.count() == len(texts) + 1
    assert all(bytes(r.ids) == coder.encode(r.text)[0] for r in out.collect())
    assert bpe.encode_texts(spark, df.limit(0), vocabulary).count() == 0


def test_new_words_are_merged_side_by_side(vocabulary, monkeypatch):
    rng = np.random.default_rng(9)
    letters = list("abcdefghijklmnoprstué漢ж")
    texts = [" ".join("".join(rng.choice(letters, int(rng.integers(1, 30)))) for _ in range(60)) for _ in range(40)] + [None, "", "<|endoftext|>a", "x" * 200, "Ա Ɐ \u1c89 \U00010940a"]
    want = [bpe.Bpe(vocabulary).encode(t) for t in texts]
    for remember in (10, 200_000):
        few, alone, calls = bpe.Bpe(vocabulary, remember), bpe.Bpe.word_ids, []
        monkeypatch.setattr(bpe.Bpe, "word_ids", lambda self, w: calls.append(w) or alone(self, w))
        assert list(few.encode_all(texts)) == want
        monkeypatch.undo()
    assert len(calls) < 20 and list(few.encode_all([])) == []


def test_words_that_came_once_are_not_held(spark, vocabulary):
    rng = np.random.default_rng(10)
    texts = ["".join(map(chr, rng.integers(97, 123, 40))) + " often" for _ in range(2000)]
    coder, fresh = bpe.Bpe(vocabulary), bpe.Bpe(vocabulary)
    assert list(fresh.encode_all(texts, words=200)) == [coder.encode(t) for t in texts]
    assert "often" in fresh.young and len(fresh.young) + len(fresh.old) + len(fresh.fresh) < 100
    out = bpe.encode_texts(spark, spark.createDataFrame([(1, "one text")], "doc_id long, text string"), vocabulary, keep_text=False)
    assert out.columns == ["doc_id", "ids", "decoded"] and bytes(out.first().ids) == coder.encode("one text")[0]


def toxic_tables(spark, n=600):
    rng = np.random.default_rng(1)
    plain = [f"word{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(n):
        words, y = list(rng.choice(plain, 40)), int(k % 4 == 0)
        if y:
            words[int(rng.integers(40))] = str(rng.choice(["stupid", "moron", "scum"]))
        docs.append((k, " ".join(words), "clash"))
        labels.append((k, y if k % 50 else None))
    docs += [(None, "stupid", None), (n, None, None), (n + 1, "", None), (1, "repeated", None)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_tables(spark)
    out = toxicity.toxicity(spark, docs, labels).withColumn("held_out", toxicity.held_out("id"))
    assert out.count() == docs.count()
    rows = out.join(labels.where("toxic IS NOT NULL").withColumnRenamed("doc_id", "id"), "id").where("held_out AND id != 1").collect()
    assert len(rows) > 100 and np.mean([(r.score >= 0.7) == (r.toxic == 1) for r in rows]) > 0.95
    assert all(r.score < 0.5 for r in out.where("id >= 600").collect()) and all(0 <= r.score <= 1 for r in out.collect())


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = toxic_tables(spark, 20)
    assert toxicity.toxicity(spark, docs, labels.limit(0)).select("score").distinct().count() == 1
    assert toxicity.toxicity(spark, docs.limit(0), labels).count() == 0


def test_factorization_machine_learns_a_pair():
    """Neither term alone is toxic, both together are."""
    rng = np.random.default_rng(2)
    x = (rng.random((800, 6)) < 0.5).astype(np.float32)
    y = (x[:, 0] * x[:, 1]).astype(np.float32)
    w0, w, v = toxicity.fit(x, y, 4, 600)
    xv = x @ v
    z = w0 + x @ w + 0.5 * (xv**2 - x @ v**2).sum(axis=1)
    assert ((z > 0) == (y == 1)).mean() > 0.99


def test_language_on_held_out_rows(spark):
    rng = np.random.default_rng(3)
    parts = {"aa": ["ka", "ko", "ku"], "bb": ["sch", "tz", "ng"], "cc": ["é", "è", "ou"]}
    docs = [(k, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(int(rng.integers(3, 200)))), lang) for k, lang in enumerate(list(parts) * 100)]
    docs += [(900, None, "aa"), (901, "123 !?", "aa"), (902, "", None), (None, "kakoku kakoku", "aa"), (903, "kakoku " * 5000, None)]
    docs += [(3, "kakoku kokuka", "aa"), (3, "schtzng", "bb")]  # an id that repeats
    out = langid.language(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"id": F.lit("clash"), "score": F.lit("clash")}))
    assert out.count() == len(docs)
    docs, out = docs[:-2], out.where("id != 3 OR id IS NULL")
    got = {r.id: r for r in out.withColumn("held_out", langid.held_out("id")).collect()}
    held = [k for k, _, _ in docs[:300] if k != 3 and got[k].held_out]
    assert len(held) > 40 and np.mean([got[k].lang == docs[k][2] for k in held]) > 0.95
    assert [got[k].lang for k in (900, 901, 902, 903)] == ["und", "und", "und", "aa"] and len(got) == len(docs) - 1
    assert langid.language(spark, spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_folded_network_is_the_network():
    net = langid.Network(["a", "b"])
    x = np.random.default_rng(5).integers(1, 256, (7, langid.WINDOW)).astype(np.uint8)
    net.fold()
    e = net.p["e"][x]
    pooled = []
    for w in langid.WIDTHS:
        a = sum(e[:, k : langid.WINDOW - w + 1 + k] @ net.p[f"f{w}"][k] for k in range(w)) + net.p[f"b{w}"]
        pooled.append(a.max(axis=1))
    plain = langid.softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ net.p["o"] + net.p["c"])
    assert np.allclose(net.probabilities(x), plain, atol=1e-4)


PAGES = {
    "": "",
    "<p>a<p>b": "a\n\nb",
    "plain <b>bold</b> x": "plain bold x",
    "<div class='cookie notice'>c</div><div id=main>Hello<br>w&ouml;rld  <i>x</i></div><ul><li>a<li>b</ul>": "Hello wörld x\n\na\n\nb",
    "<nav>n</nav><article><h1>T</h1><p>x &amp; y</p><section class=comments><p>c</p></section></article><footer>f": "T\n\nx & y",
    "<article>a<script>if (a<b) {}</script><style>p{}</style><!-- c --></article>": "a",
    "<" * 3 + "a": "<<<a",
    "<div>" * 3000 + "deep": "deep",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html_extract.main_text(page) == PAGES[page]


def test_site_templates_go_and_shared_passages_stay(spark):
    rows = [(k, f"http://h.example/{k}", f"<body><div><span>Our shop {k % 2}</span></div><div class=body><p>{'common passage' if k % 3 == 0 else f'text {k}'}</p></div></body>") for k in range(40)]
    rows += [(100 + k, f"http://other.example/{k}", f"<body><div><span>own {k}</span></div></body>") for k in range(10)] + [(200, None, None), (200, None, None), (None, "x", "<p>y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("places", F.lit("clash"))
    got = html_extract.extract(spark, df).collect()
    text = {r.id: r.text for r in got}
    assert len(got) == len(rows) and text[200] == "" and text[None] == "y"
    assert all(text[k] == ("common passage" if k % 3 == 0 else f"text {k}") for k in range(40)) and text[103] == "own 3"
    assert html_extract.extract(spark, df.limit(0)).count() == 0


def test_copies_of_a_page_make_no_template(spark):
    page = lambda p, foot="": f"<body><article><p>{p}</p></article><div>{foot}</div></body>"
    rows = [(k, "http://h.example/a", page("copied")) for k in range(8)] + [(8, "http://h.example/b", page("first")), (9, "http://h.example/c", page("second"))]
    rows += [(20 + k, None, page("nowhere")) for k in range(5)]
    # a place of nearly all recurring subtrees: those go, and the one that does not recur stays
    rows += [(40 + k, "http://t.example/", f"<body><div><span>{'shop' if k else 'only here'}</span></div><p>text {k}</p></body>") for k in range(12)]
    text = {r.id: r.text for r in html_extract.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(text[k] == "copied" for k in range(8)) and text[8] == "first" and text[9] == "second"
    assert all(text[20 + k] == "nowhere" for k in range(5))
    assert text[40] == "only here\n\ntext 0" and all(text[40 + k] == f"text {k}" for k in range(1, 12))


def test_pages_of_copies_datelines_and_innocent_names(spark):
    page = lambda body: f"<html><body><nav>menu</nav>{body}<div class='x'><span>All rights reserved</span></div></body></html>"
    rows = [(k, "http://copies.example/a", page("<article><p>six of one</p></article>")) for k in range(6)]
    rows += [(20 + k, "http://news.example/a", page(f"<div class=story><div class=line>{'London' if k < 18 else f'Own line {k}'}</div><p>story {k}</p></div>")) for k in range(20)]
    rows += [(60, "http://names.example/a", "<div class='search-results-analysis'>one</div>"), (61, "http://names.example/b", "<div class='social-history'>two</div><p>three</p>"), (62, "http://names.example/c", "<div class='cookie-notice'>c</div><p>four</p>")]
    text = {r.id: r.text for r in html_extract.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(text[k] == "six of one\n\nAll rights reserved" or text[k] == "six of one" for k in range(6))
    assert [text[38], text[39]] == ["Own line 18\n\nstory 18", "Own line 19\n\nstory 19"] and text[21] == "story 1"
    assert [text[60], text[61], text[62]] == ["one", "two\n\nthree", "four"]


def test_templates_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(120):
        host = f"h{k % 3}.example"
        parts = [f"<div class=c{j}>{'shop ' + str(int(rng.integers(2))) if j < 2 else f'own {k} {j}'}</div>" for j in range(4)]
        rows.append((k, f"http://{host}/{k}", "<body>" + "".join(parts) + (f"<p>{'often' if rng.random() < 0.5 else k}</p>") + "</body>"))
    rows += rows[:10]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.host, r.hash) for r in html_extract.site_templates(df.select(html_extract.page_host("url").alias("host"), "html"), 5, 0.8).collect()}
    per: dict = {}
    for host, page in {(f"h{k % 3}.example", h) for k, _, h in rows}:
        for place, h in {(e.place, html_extract._subtree(page, e, html_extract.host_hash(host))) for e in html_extract._counted(html_extract.parse(page)[1])}:
            per.setdefault((host, place), {}).setdefault(h, 0)
            per[host, place][h] += 1
    want = {(host, h) for (host, _), n in per.items() if sum(c for c in n.values() if c >= 5) >= 0.8 * sum(n.values()) for h, c in n.items() if c >= 5}
    assert got == want and len(want) >= 6
    few, many = (html_extract.extract(spark, df, most_sent=m).orderBy("id", "text").collect() for m in (0, 100))
    assert few == many


def brute(vectors, k):
    out = {}
    for i, q in vectors:
        s = sorted(((-float(np.dot(q, v)), j) for j, v in vectors if j != i and len(v) == len(q)))[:k]
        out[i] = [(j, -a) for a, j in s]
    return out


@pytest.mark.parametrize("shard_rows", [50, 1000])
def test_top_k_is_exact(spark, shard_rows):
    rng = np.random.default_rng(6)
    sound = [(k, [float(x) for x in rng.integers(-5, 6, 8)]) for k in range(400)] + [(1000 + k, [1.0] * 8) for k in range(120)] + [(2000, [1.0, 2.0])]
    broken = [(3000, None), (3001, []), (3002, [float("nan")] * 8), (3003, [float("inf")] * 8), (3004, [None] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(sound + broken, "id long, v array<double>").withColumn("shard", F.lit("clash"))
    got = topk.top_k(spark, df, df.where("id % 40 = 0 OR id = 2000"), 5, shard_rows).orderBy("query_id", "rank").collect()
    want = brute(sound, 5)
    for q in {i for i, _ in sound if i % 40 == 0 and i != 2000}:
        assert [(r.id, r.score) for r in got if r.query_id == q] == want[q]
    assert not [r for r in got if r.query_id >= 2000]
    assert topk.top_k(spark, df.limit(0), df.limit(0)).count() == 0


def test_top_k_with_repeated_rows_and_many_blocks(spark):
    rng = np.random.default_rng(12)
    rows = [(k % 150, [float(x) for x in rng.integers(-4, 5, 6)]) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got: dict = {}
    for r in topk.top_k(spark, df, df.where("id % 5 = 0"), 7, shard_rows=40, block_rows=8, rounds=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    for i in range(0, 150, 5):
        q = min(v for j, v in rows if j == i)
        best = sorted((-float(np.dot(q, v)), j) for j, v in rows if j != i)[:7]
        assert got[i] == [(j, -s) for s, j in best]


def test_top_k_gives_all_when_few(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [3.0])], "id long, v array<double>")
    assert [(r.id, r.rank) for r in topk.top_k(spark, df, df.where("id = 1")).orderBy("rank").collect()] == [(3, 1), (2, 2)]
