"""Images, names, links and places of texts; small operators on rows."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import images as I
from lodestrata.functions import text as X
from lodestrata.operators import aggregates as A
from lodestrata.operators import evaluation as V
from lodestrata.operators import filters as L
from lodestrata.operators import lifecycle as C
from lodestrata.operators import ranking as R
from lodestrata.operators.vector_blocks import nearest_in_blocks, vector_blocks
from lodestrata.sources import files as S
from lodestrata.sources import tables as T


def test_images_are_found_where_they_stand():
    text = "![[a/b.PNG|one]] ![x](c.jpg \"t\") ![y](http://h/z.png) ![[no.txt]]\n```\n![[in.png]]\n~~~\n![[in.png]]\n```\r\n  ![z](../up%20s/./d.gif#f)![[ /r.webp ]]![](data:x.png)"
    found = I.find_images(text, "n/m/note.md")
    assert [(r["source"], r["alt"], r["syntax"]) for r in found] == [("a/b.PNG", "one", "wikilink"), ("n/m/c.jpg", "x", "markdown"), ("n/up s/d.gif", "z", "markdown"), ("r.webp", "", "wikilink")]
    assert [text[r["start"] : r["end"]] for r in found] == ["![[a/b.PNG|one]]", '![x](c.jpg "t")', "![z](../up%20s/./d.gif#f)", "![[ /r.webp ]]"]
    assert I.find_images("![a](x/../../n.png)", "n/m.md")[0]["source"] == "n.png"
    for bad in ("![a](../../x.png)", "![[../x.png]]", "![a](/x.png)", "![[#head]]", "![a](..)"):
        with pytest.raises(I.Outside):
            I.find_images(bad, "n/m.md")


def test_images_are_rewritten_whole_or_not_at_all(spark):
    notes = spark.createDataFrame([(1, "x ![[a.png|A]] y ![b](b.png)", "n.md"), (2, "![[a.png]] ![[gone.png]]", "n.md"), (3, "![[../a.png]]", "n.md"), (4, None, "n.md"), (5, "plain", None)], "id int, text string, relative_path string")
    targets = spark.createDataFrame([(1, "a.png", "new/1.png"), (1, "b.png", "new/2.png"), (2, "a.png", "new/1.png")], "id int, source string, target string")
    out = {r.id: (r.text, r.issue) for r in I.rewrite_images(notes, targets, "id").collect()}
    assert out == {1: ("x ![[new/1.png|A]] y ![[new/2.png|b]]", None), 2: ("![[a.png]] ![[gone.png]]", "no target for gone.png"), 3: ("![[../a.png]]", "an image must stay inside the root"), 4: ("", None), 5: ("plain", None)}


def test_names_are_unique_without_regard_to_case(spark):
    titles = ["Intro", "intro", "intro (2)", "a/b: c?", " .. ", "a-b- c-", "tab\there", "Intro"]
    df = spark.createDataFrame([("d", k, t) for k, t in enumerate(titles)] + [("e", 0, "Intro")], "doc string, k int, title string")
    got = [(r.doc, r["name"]) for r in X.unique_names(df, "doc", "k", "title", F.array(F.lit("INDEX"), F.lit("intro (3)"))).orderBy("doc", "k").collect()]
    assert got == [("d", n) for n in ["Intro", "intro (2)", "intro (2) (2)", "a-b- c-", "内容", "a-b- c- (2)", "tab-here", "Intro (4)"]] + [("e", "Intro")]
    name = spark.range(1).select(X.safe_name(F.lit(" My Note: ä.PDF ")).alias("a"), X.safe_name(F.lit("..."), F.lit("item-7"), F.lit(".PDF")).alias("b"), X.safe_name(F.lit("x.pdf"), F.lit("y"), F.lit(".PDF")).alias("c")).first()
    assert tuple(name) == ("my-note-.pdf", "item-7.pdf", "x.pdf")


def test_links_and_places(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert one(X.wiki_links(F.lit("[[ a |b]] [[c#d]] ![[a]] [[]] [[ ]]"))) == ["a", "c"]
    assert one(X.heading_locations(F.lit("# A\r\n```\n  ## B\n```\n    # no\n#no\n### "))) == ["line:1", "line:3", "line:7"]
    assert [tuple(one(X.evidence_location(F.array(F.lit("first")), F.lit(x)))) for x in ("Heading: A b ;page: 3", "page:0", "line:1")] == [("A b", 3), ("first", None), ("first", None)]
    link = lambda t: one(X.top_source_link(F.lit(t), F.lit("s.pdf")))
    assert [link(t) for t in ("---\na: 1\n---\n# T\n\nsub\nfrom [[s.pdf|x]]", "one\ntwo\n[[s.pdf]]", "[[t.pdf]] [[s.pdf]]", "", "# [[s.pdf]]")] == [True, False, True, False, False]


def test_vectors_of_bytes(spark):
    rows = [(bytearray(struct.pack("<2f", 1.5, -2)), 2), (bytearray(b"abc"), 2), (None, 2), (bytearray(struct.pack("<2f", 1, float("nan"))), 2)]
    df = spark.createDataFrame(rows, "raw binary, n int")
    assert [r.v for r in df.select(X.float32_vector(F.col("raw"), F.col("n")).alias("v")).collect()] == [[1.5, -2.0], None, None, None]


def test_blocks_answer_as_the_plain_search_does(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    asked = table.where("vec_id % 90 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = {}
    for r in nearest_in_blocks(vector_blocks(table, "vec_id", "embedding", rows=64), asked, 6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.key)
    for r in asked.collect():
        assert got[r.query_id] == [x.vec_id for x in R.nearest(table, list(r.vector), 6, ["vec_id"], "embedding").collect()]
    with pytest.raises(ValueError, match="more than 1"):
        nearest_in_blocks(vector_blocks(table, "vec_id", "embedding"), asked, 3, most=1)
    ties = spark.createDataFrame([(k, [1.0, 0.0]) for k in (9, 3, 7, 10)] + [(1, [0.0, 1.0])], "id int, vector array<float>")
    one = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, vector array<float>")
    assert [r.key for r in nearest_in_blocks(vector_blocks(ties, "id"), one, 3).orderBy("rank").collect()] == [3, 7, 9]
    for bad in ([0.0, 0.0], [1.0], [float("inf"), 1.0], None, [None, 1.0]):
        with pytest.raises(Exception, match="broken vector: 5"):
            vector_blocks(ties.unionByName(spark.createDataFrame([(5, bad)], ties.schema)).coalesce(1), "id").collect()


def test_small_operators(spark, tmp_path):
    ranked = spark.createDataFrame([(1, 3, "c", ["h"], "see /etc/passwd", True), (1, 1, "a", ["h"], "fine", True), (1, 2, "b", ["h"], "fine too", False), (1, 4, "d", ["C:\\x"], "t", True), (1, 5, "e", ["h"], "line\nnext \"x\"", True)], "query_id int, rank int, doc string, heading_path array<string>, text string, outbound_allowed boolean")
    assert [(r.doc, r.fused_rank, r.candidate_id) for r in R.rerank_candidates(ranked).orderBy("fused_rank").collect()] == [("a", 1, "candidate01"), ("e", 5, "candidate02")]
    view = ranked.withColumn("candidate_id", F.col("doc")).withColumn("block_kind", F.lit("p")).withColumn("allowed_tags", F.array().cast("array<string>")).withColumn("fused_rank", F.col("rank"))
    seen = L.rerank_view(view)
    assert "doc" not in seen.columns and sorted(r.candidate_id for r in seen.collect()) == ["a", "b", "e"]
    channels = spark.createDataFrame([(1, c, k, f"i{k}") for c in ("lexical", "semantic") for k in range(1, 4)], "query_id int, channel string, rank int, item_id string")
    want = spark.createDataFrame([(1, "i1"), (1, "gone")], "query_id int, item_id string")
    assert {(r.rrf_k, r.recall) for r in V.calibrate_fusion(channels, want).collect()} == {(20, 0.5), (60, 0.5), (100, 0.5)}
    docs = spark.createDataFrame([("d1", "a", True, None), ("d2", "a", False, None), ("d3", "b", True, None)], "document_id string, relative_path string, is_current boolean, stale_reason string")
    vectors = docs.select("document_id", F.lit(1).alias("v"))
    marked, kept = C.invalidate(docs, vectors, "a", "moved")
    assert {(r.document_id, r.stale_reason) for r in marked.collect()} == {("d1", "moved"), ("d2", None), ("d3", None)} and {r.document_id for r in kept.collect()} == {"d2", "d3"}
    rows = spark.createDataFrame([("t", ["h"], "p.md", ["a"], ["l"])], "text string, heading_path array<string>, relative_path string, tags array<string>, links array<string>")
    assert R.overlap_score(rows.withColumn("text", F.lit("alpha beta")), "alpha gamma").first().score == round(4 * 0.5 + 2 / 3, 6)
    assert [r.f for r in spark.createDataFrame([(90.0, []), (60.0, []), (90.0, ["ocr-empty-result"])], "c double, i array<string>").select(A.needs_fallback(F.col("c"), F.col("i")).alias("f")).collect()] == [False, True, True]
    sessions = spark.createDataFrame([("s", "x"), ("e", "y")], "session_id string, title string")
    said = spark.createDataFrame([("s", 2, "user", "b"), ("s", 1, "user", "a")], "session_id string, turn int, role string, text string")
    out = {r.session_id: json.loads(r.json) for r in T.export_sessions(sessions, said).collect()}
    assert [m["text"] for m in out["s"]["messages"]] == ["a", "b"] and out["e"]["title"] == "y"
    T.write_report(spark.createDataFrame([(0.5,)], "recall double"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().report_version == 1
    assert [r.document_id for r in T.current_documents(docs.withColumn("indexed_at", F.lit("x"))).collect()] == ["d1", "d3"]
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "page-1.tsv").write_text(head + '5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t91.5\t"quoted\n4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n')
    words = S.read_ocr_tsv(spark, str(tmp_path / "page-1.tsv")).collect()
    assert [(r.target_id, r.level, r.conf, r.text) for r in words] == [("page-1", 5, 91.5, '"quoted'), ("page-1", 4, -1.0, None)]
