from pyspark.sql import functions as F

from lodestrata.functions import metadata as M
from lodestrata.operators import joins as J
from lodestrata.operators import layout as Y
from lodestrata.operators import projection as P
from lodestrata.operators import queue as Q

BLOCK = "graph_id string, reading_order int, block_id string, kind string, text string, page int, level int, x1 double, y1 double, x2 double, y2 double"


def blocks(spark, rows):
    return spark.createDataFrame([("g", k, f"b{k}", *r, 0.0, float(k), 50.0, float(k) + 1) for k, r in enumerate(rows, 1)], BLOCK)


def test_projection_and_its_chunks(spark):
    df = blocks(spark, [("paragraph", "intro", 1, None), ("heading", "One", 1, 1), ("paragraph", "a" * 300, 1, None), ("paragraph", "b" * 300, 2, None), ("paragraph", "c" * 300, 2, None), ("noise", "foot", 2, None), ("table", "| x |", 2, None), ("paragraph", "d" * 900, 3, None), ("paragraph", "e", 3, None)])
    rows = P.projected(df).orderBy("sequence").collect()
    assert [r.location for r in rows[:3]] == ["page:1", "heading:One", "heading:One"] and len(rows) == 8
    assert rows[2].context_before == "b2" and rows[0].context_before is None
    chunks = P.projection_chunks(df).orderBy("chunk").collect()
    assert [(r.kind, r["first"], r["last"]) for r in chunks] == [("paragraph", 1, 1), ("paragraph", 3, 4), ("paragraph", 5, 5), ("table", 6, 6), ("paragraph", 7, 7), ("paragraph", 8, 8)]
    assert chunks[1].contextual_prefix == "[One]" and chunks[1].text == "a" * 300 + "\n\n" + "b" * 300


def test_answers_stand_with_their_questions(spark):
    lines = ["Title", "1. What is it?", "A: a thing", "more of it", "2. Who?", "答：nobody", "3. left open?"]
    df = spark.createDataFrame([("d", k, t) for k, t in enumerate(lines, 1)], "doc string, place int, text string")
    got = P.fused_answers(df, ["doc"]).orderBy("place").collect()
    assert [(r.place, r.lines, r.fused) for r in got] == [(1, 1, False), (2, 3, True), (5, 2, True), (7, 1, False)]


def test_line_kinds(spark):
    rows = {"": "blank", "![a](b.png)": "image", "| a | b |": "table", "Figure 2 x": "caption", "# T": "heading", "- item": "list", "Some words.": "paragraph"}
    df = spark.createDataFrame(list(rows.items()), "t string, k string")
    assert all(r.k == r.got for r in df.select("k", P.line_kind(F.col("t")).alias("got")).collect())


def test_private_candidates_show_no_identity(spark):
    b = spark.createDataFrame([(1, "d1", 1, ["h"], "paragraph", "x", 0.9), (1, "d2", 1, ["h"], "paragraph", "y", 0.8)], "query_id int, document_id string, sequence int, heading_path array<string>, kind string, text string, score double")
    a = spark.createDataFrame([("d1", True), ("d2", False)], "document_id string, outbound_allowed boolean")
    out = P.private_candidates(b, a)
    assert out.columns == ["query_id", "candidate", "heading_path", "kind", "text", "score"] and [r.text for r in out.collect()] == ["x"]


def test_same_position_needs_text_page_and_place(spark):
    rows = [("g", "a", 1, "Head", 1.0, 1.0, 9.0, 2.0), ("g", "b", 2, "head", 1.1, 1.0, 9.0, 2.0), ("g", "c", 3, "Head", 50.0, 1.0, 60.0, 2.0), ("g", "d", 2, "other", 1.0, 1.0, 9.0, 2.0)]
    df = spark.createDataFrame(rows, "graph_id string, block_id string, page int, text string, x1 double, y1 double, x2 double, y2 double").withColumns({"page_width": F.lit(100.0), "page_height": F.lit(100.0)})
    assert {(r.block_id, r.pages) for r in J.same_position(df).collect()} == {("a", 1), ("b", 1)}


def test_page_numbers_and_fragments(spark):
    rows = [("g", 1, "b1", "paragraph", "this goes", 1, 0.0, 40.0, 50.0, 44.0), ("g", 2, "b2", "paragraph", "on here.", 1, 0.0, 45.0, 50.0, 49.0), ("g", 3, "b3", "paragraph", "- 12 -", 1, 20.0, 98.0, 30.0, 100.0)]
    df = spark.createDataFrame(rows, "graph_id string, reading_order int, block_id string, kind string, text string, page int, x1 double, y1 double, x2 double, y2 double")
    got = {r.block_id: r for r in Y.normalize(df).collect()}
    assert set(got) == {"b1", "b3"} and got["b1"].text == "this goes on here." and got["b1"].parts == 2 and got["b3"].noise


def test_queue(spark):
    jobs = spark.createDataFrame([(1, "v", "k", "pending", "r", 5), (2, "v", "k", "pending", "r", 3), (3, "w", "k", "running", "r", 1), (4, "w", "k", "pending", "r", 2), (5, "x", "k", "failed", "old", 1), (6, "x", "k", "failed", "new", 2), (7, "y", "k", "failed", "r", 1), (8, "y", "k", "completed", "r", 2)], "job_id int, vault_id string, paths_key string, status string, reason string, created_at int")
    assert [(r.vault_id, r.job_id) for r in Q.next_jobs(jobs).collect()] == [("v", 2)]
    assert [(r.vault_id, r.job_id, r.reason) for r in Q.newest_failed(jobs).collect()] == [("x", 6, "new")]
    assert [(r.job_id, r.place) for r in Q.in_turn(jobs).where("vault_id = 'v'").orderBy("place").collect()] == [(2, 1), (1, 2)]
    g = spark.createDataFrame([(1, "s", "running", 5), (2, "s", "completed", 5), (3, "t", "running", 5)], "generation_id int, snapshot_id string, status string, started_at int")
    c = spark.createDataFrame([("s", 6, "content"), ("s", 7, "policy"), ("t", 1, "before")], "snapshot_id string, changed_at int, reason string")
    assert {(r.generation_id, r.status, r.invalid_reason) for r in Q.invalidate_generations(g, c).collect()} == {(1, "invalidated", "content"), (2, "completed", None), (3, "running", None)}


def test_pages_of_listings(spark):
    s = spark.createDataFrame([(1, "beta", 3, False), (2, "Alpha", 1, False), (3, "alpine", 2, True)], "session_id int, title string, updated_at int, archived boolean")
    assert [r.session_id for r in Q.session_page(s, 1, 2).collect()] == [1, 3]
    assert [r.session_id for r in Q.session_page(s, 1, 5, text="AL", sort="title").collect()] == [2, 3]
    assert [r.session_id for r in Q.session_page(s, 1, 5, archived=True).collect()] == [3]
    f = spark.createDataFrame([("b.md",), ("A.md",), ("c.png",)], "relative_path string")
    assert [r.relative_path for r in Q.file_page(f, 1, 5, kind="markdown").collect()] == ["A.md", "b.md"]
    assert [r.relative_path for r in Q.file_page(f, 1, 1, descending=True).collect()] == ["c.png"]


def test_metadata_of_paths_and_headings(spark):
    texts = {"Unit 3 Animals": 3, "第十二单元": 12, "第三课": 3, "第5章": 5, "plain": None, "Lesson 07": 7}
    df = spark.createDataFrame(list(texts.items()), "t string, n int")
    assert all(r.n == r.got for r in df.select("n", M.unit_number(F.col("t")).alias("got")).collect())
    one = spark.range(1).select(M.structure_aliases(F.lit("Unit 3")).alias("a"), M.heading_prefixes(F.lit("see 2.1.3")).alias("p"), M.path_metadata(F.lit("English/Grade 7/Unit 2.md")).alias("m"), M.normal_metadata(F.lit(" 人教版（七年级）  ")).alias("n")).first()
    assert one.a == ["unit 3", "第3单元"] and one.p == ["213", "see213"] and (one.m.subject, one.m.name, one.m.unit, one.m.depth) == ("English", "Unit 2", 2, 2) and one.n == "人教版(七年级)"


def test_heading_scopes(spark):
    b = spark.createDataFrame([("d1", ["Book", "Unit 3 Animals"]), ("d1", ["Book", "Unit 3 Animals"]), ("d2", ["Unit 4"]), ("d3", ["Unit 4 again"])], "document_id string, heading_path array<string>")
    q = spark.createDataFrame([(1, "Unit 3"), (2, "unit 4"), (3, "Unit 9")], "query_id int, query string")
    got = {(r.query_id, r.document_id, r.blocks, r.status) for r in M.resolve_heading_scope(b, q).collect()}
    assert got == {(1, "d1", 2, "resolved"), (2, "d2", 1, "ambiguous"), (2, "d3", 1, "ambiguous"), (3, None, None, "missing")}


def test_sources_of_derived_notes(spark):
    note = lambda path, sha: f"---\nsource_path: {path}\nsource_sha256: '{sha}'\n---\nbody"
    notes = spark.createDataFrame([("a", note("X.pdf", "1")), ("b", note("x.pdf", "2")), ("c", note("gone.pdf", "1")), ("d", "plain")], "relative_path string, text string")
    files = spark.createDataFrame([("x.pdf", "1")], "relative_path string, content_sha256 string")
    assert {r.relative_path: r.state for r in M.check_sources(notes, files).collect()} == {"a": "verified", "b": "source-changed", "c": "source-missing", "d": "native"}
