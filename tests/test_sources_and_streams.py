import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from lodestrata.functions import provenance as N
from lodestrata.operators import typed_projection as Y
from lodestrata.sources import commits as C
from lodestrata.sources import documents as D
from lodestrata.sources import files as S
from lodestrata.sources import table_grid as G
from lodestrata.sources import tables as T
from lodestrata.streaming import events as E


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/n.md").write_text("# hi")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip/x.bin").write_text("z")
    assert {r.relative_path for r in S.list_files(spark, str(tmp_path)).collect()} == {"a/n.md", "skip/x.bin"}
    rows = S.scan(spark, str(tmp_path), ["skip"]).collect()
    assert [(r.relative_path, r.kind, r.category) for r in rows] == [("a/n.md", "markdown", "supported")]
    assert S.find_by_hash(S.scan(spark, str(tmp_path)), rows[0].content_sha256).first().relative_path == "a/n.md"
    assert S.read_markdown(spark, str(tmp_path)).first().text == "# hi"


def test_office_units(spark):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    df = spark.createDataFrame([("a.docx", "docx", bytearray(raw.getvalue())), ("b.xlsx", "xlsx", bytearray(b"no"))], "path string, kind string, content binary")
    got = {(r.path, r.location, r.text) for r in D.office_units(df).collect()}
    assert got == {("a.docx", "paragraph:1", "one"), ("a.docx", "table:1/row:1/cell:1", "c"), ("b.xlsx", None, None)}


def test_layout_and_tables(spark):
    json = '{"pages":[{"page_index":0,"parsing_res_list":[{"block_label":"text","block_content":"late","block_bbox":[0,1,2,3],"block_id":"2","block_order":null},{"block_label":"doc_title","block_content":"T","block_bbox":[0,1,2,3],"block_id":"1","block_order":1},{"block_label":"text","block_content":" ","block_bbox":[0,1,2,3],"block_id":"3","block_order":2}]}]}'
    rows = D.layout_blocks(spark.createDataFrame([("g", json)], "graph_id string, json string")).orderBy("reading_order").collect()
    assert [(r.kind, r.text) for r in rows] == [("heading", "T"), ("paragraph", "late")]
    html = spark.createDataFrame([(1, "<table><tr><th colspan=2>h</th></tr><tr><td>a</td><td>b <i>c</i></td></tr></table>")], "id int, html string")
    assert [(r.row, r.column, r.text, r.colspan) for r in G.table_cells(html, "html", ["id"]).orderBy("row", "column").collect()] == [(0, 0, "h", 2), (1, 0, "a", 1), (1, 1, "b c", 1)]


def test_versions_publish_last(spark, tmp_path):
    v = T.VersionedTables(spark, str(tmp_path / "idx"))
    assert v.version() == 0
    v.write({"t": spark.range(2)})
    v.write({"t": spark.range(5)})
    assert v.read("t").count() == 5 and v.read("t", 1).count() == 2


def test_rendering(spark):
    b = spark.createDataFrame([("g", 1, "heading", "T", 2), ("g", 2, "paragraph", "p", None), ("g", 3, "noise", "n", None)], "graph_id string, reading_order int, kind string, text string, level int")
    assert T.render_markdown(b).first().markdown == "## T\n\np"
    assert spark.range(1).select(T.render_table(F.array(F.array(F.lit("a")), F.array(F.lit("1"))))).first()[0] == "| a |\n| --- |\n| 1 |"


def test_stream_resumes_where_it_ended(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    spark.range(3).write.parquet(src)
    stream = lambda: E.event_stream(spark, src, "id long")
    E.drain(stream(), out, ck)
    spark.range(3, 5).write.mode("append").parquet(src)
    E.drain(stream(), out, ck)
    E.drain(stream(), out, ck)
    assert spark.read.parquet(out).count() == 5


def test_incremental_index(spark, tmp_path):
    schema = "document_id string, vault_id string, relative_path string, content_sha256 string, is_current boolean, stale_reason string"
    src = str(tmp_path / "src")
    spark.createDataFrame([("d1", "v", "a", "h1", True, None)], schema).write.parquet(src)
    tables = T.VersionedTables(spark, str(tmp_path / "idx"))
    run = lambda: E.index_incrementally(spark, spark.readStream.schema(schema).parquet(src), tables, str(tmp_path / "ck"), lambda b: b)
    run()
    spark.createDataFrame([("d2", "v", "a", "h2", True, None)], schema).write.mode("append").parquet(src)
    run()
    assert {(r.document_id, r.is_current) for r in tables.read("documents").collect()} == {("d1", False), ("d2", True)}


def walked_grid(rows):
    """Cells put down one by one on a set of taken places."""
    taken, out = set(), []
    for r, row in enumerate(rows):
        c = 0
        for down, across in row:
            while (r, c) in taken:
                c += 1
            out.append((r, c))
            taken |= {(r + i, c + k) for i in range(down) for k in range(across)}
            c += across
    return out


def test_grid_places_are_those_of_a_walk():
    rng = random.Random(9)
    for _ in range(500):
        rows = [[(rng.randint(1, 3), rng.randint(1, 3)) for _ in range(rng.randrange(4))] for _ in range(rng.randint(1, 5))]
        assert [(r, c) for r, cs in enumerate(G.grid_places(rows)) for c in cs] == walked_grid(rows)


def test_tables_with_spans_are_read_laid_out_and_rendered(spark):
    html = "<table><tr><th rowspan='2'>A&amp;B</th><th colspan=2>x<br>y</th></tr><tr><td>1</td><td rowspan=0>2</td></tr><tr></tr><tr><td colspan=x>&lt;3&gt;</td></tr></table>"
    plain = "<tr><td>a|b</td><td>- c</td></tr><tr><td>d*</td><td>\n</td></tr>"
    df = spark.createDataFrame([(1, html), (2, plain), (3, None), (4, "no table"), (5, "<td>loose</td>")], "id int, html string")
    cells = {(r.id, r.row, r.column): (r.text, r.rowspan, r.colspan, r.is_header) for r in G.table_cells(df, "html", ["id"]).collect()}
    assert cells == {
        (1, 0, 0): ("A&B", 2, 1, True), (1, 0, 1): ("x\ny", 1, 2, True), (1, 1, 1): ("1", 1, 1, False), (1, 1, 2): ("2", 1, 1, False), (1, 2, 0): ("<3>", 1, 1, False),
        (2, 0, 0): ("a|b", 1, 1, False), (2, 0, 1): ("- c", 1, 1, False), (2, 1, 0): ("d*", 1, 1, False), (2, 1, 1): ("", 1, 1, False),
    }
    over = {(r.row, r.column): r.text for r in G.covered_cells(G.table_cells(df.where("id = 1"), "html", ["id"]), ["id"]).collect()}
    assert over == {(0, 0): "A&B", (1, 0): "A&B", (0, 1): "x\ny", (0, 2): "x\ny", (1, 1): "1", (1, 2): "2", (2, 0): "<3>"}
    out = {r.id: r.markdown for r in G.render_tables(df, "html", ["id"]).collect()}
    assert out[1] == '<table>\n<tr><th rowspan="2">A&amp;B</th><th colspan="2">x\ny</th></tr>\n<tr><td>1</td><td>2</td></tr>\n<tr><td>&lt;3&gt;</td></tr>\n</table>'
    assert out[2] == "| a\\|b | \\- c |\n| --- | --- |\n| d\\* |  |" and out[3] is out[4] is out[5] is None
    again = G.render_tables(spark.createDataFrame([(out[1],)], "html string"), "html", []).first()[0]
    assert again == out[1]
    with pytest.raises(Exception, match="one width"):
        G.render_tables(spark.createDataFrame([("<tr><td>a</td></tr><tr><td>b</td><td>c</td></tr>",)], "html string"), "html", []).collect()


def test_spans_survive_a_round_trip(spark):
    rng = random.Random(1)
    rows = []
    for k in range(60):
        body = "".join("<tr>" + "".join(f"<td rowspan={rng.randint(1, 3)} colspan={rng.randint(1, 3)}>{rng.choice('abc')}</td>" for _ in range(rng.randint(1, 3))) + "</tr>" for _ in range(3))
        rows.append((k, f"<table>{body}</table>"))
    df = spark.createDataFrame(rows, "id int, html string")
    wide = df.where("html RLIKE 'span=[23]'")
    once = G.render_tables(wide, "html", ["id"]).withColumnRenamed("markdown", "html")
    grid = lambda d: sorted(map(tuple, G.covered_cells(G.table_cells(d, "html", ["id"]), ["id"]).collect()))
    assert grid(once) == grid(wide) and once.count() > 40


# --- typed chunks of a projection


def test_offset_cuts_give_back_the_text():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "a", "。", "\n", "\r\n", "x" * 300]) for _ in range(rng.randrange(60)))
        cuts = Y.offset_cuts(text)
        assert "".join(text[a:b] for a, b in cuts) == text and all(b - a <= Y.MOST for a, b in cuts)
        for a, b in cuts[:-1]:
            window = [k for k in range(a + 1, min(len(text), a + Y.MOST) + 1) if text[k - 1] in "\n。！？!?." or text[k - 1].isspace() and text[k - 1] != "\r"]
            assert b == max([k for k in window if k <= a + Y.TARGET], default=max(window, default=a + Y.MOST))


def test_typed_rows_must_be_the_lines():
    items = [f"item {k}" for k in range(30)]
    text = "".join(f"- {i}\n" for i in items)
    pieces = Y.fragments(text, "list", items)
    assert "".join(p for p, _ in pieces) == text and [p.count("\n") for p, _ in pieces] == [12, 12, 6]
    assert Y.fragments(text, "list", items[1:]) == Y.fragments(text, None) == [(text, text)]
    head, rows = ["h", "k"], [[str(k), "v" * 50] for k in range(20)]
    table = "".join(f"| {a} | {b} |\n" for a, b in [head, *rows])
    pieces = Y.fragments(table, "table", header=head, rows=rows)
    assert "".join(p for p, _ in pieces) == table and len(pieces) > 1
    assert all(r.startswith("| h | k |\n") and len(r) <= Y.MOST and r.endswith(p[-10:]) for p, r in pieces)
    assert Y.fragments(table, "table", header=head, rows=[["0", "wrong"], *rows[1:]]) == Y.fragments(table, None)
    assert Y.fragments("a|b\n", "table", header=["a", "b"], rows=[]) == [("a|b\n", "a|b\n")] and Y.fragments(" \n", "list", [""]) == []


def test_typed_chunks_of_a_graph(spark):
    head = lambda level, title: ("heading", level, title, None, None, None)
    atom = ("atomic", None, None, None, None, None)
    blocks = [
        ("heading", "Deep", True, True, head(3, "Deep")), ("paragraph", "a" * 200, True, True, atom), ("paragraph", "b" * 200, True, True, atom), ("paragraph", "c" * 200, True, True, atom),
        ("paragraph", "skipped", False, True, atom), ("paragraph", "d", True, True, atom), ("paragraph", "hidden", True, False, atom), ("paragraph", "e", True, True, atom),
        ("heading", "Top", True, True, head(1, " Top ")), ("paragraph", "f", True, True, atom), ("list", "- x\n- y\n", True, True, ("list", None, None, ["x", "y"], None, None)),
        ("paragraph", "w " * 500, True, True, atom), ("paragraph", " ", True, True, atom), ("paragraph", "old", True, True, None), ("heading", "No", True, True, head(2, " ")),
    ]
    df = spark.createDataFrame([("g", 7, k, f"b{k}", kind, text, sel, ret, 0.5 + k / 100, s) for k, (kind, text, sel, ret, s) in enumerate(blocks)], f"graph_id string, revision int, reading_order int, block_id string, kind string, text string, selected boolean, retrievable boolean, confidence double, structure {Y.STRUCTURE}")
    out = Y.typed_chunks(df).orderBy("sequence").collect()
    assert [(r.block_id, r.text[:1], len(r.text)) for r in out] == [("b0", "D", 4), ("b1", "a", 402), ("b3", "c", 200), ("b5", "d", 1), ("b7", "e", 1), ("b8", "T", 3), ("b9", "f", 1), ("b10", "-", 8), ("b11", "w", 500), ("b11", "w", 500), ("b13", "o", 3), ("b14", "N", 2)]
    assert [r.heading_path for r in out][:6] == [["Deep"]] * 5 + [["Top"]] and out[10].heading_path == [] and out[-1].heading_path == ["Top"]
    assert [r.heading_level for r in out][:6] == [3] * 5 + [1] and out[1].confidence == pytest.approx(0.51)
    assert out[1].location == "graph:g:7:b1#chunk:1" and out[9].location == "graph:g:7:b11#chunk:2" and out[10].location == "graph:g:7:b13"
    assert [r.sequence for r in out] == [*range(1, 13)] and Y.typed_chunks(df.limit(0)).count() == 0


# --- committed units


SHAPES = {"documents": T_.StructType([T_.StructField(n, T_.StringType()) for n in ("vault_id", "relative_path", "text")]), "blocks": T_.StructType([T_.StructField("vault_id", T_.StringType()), T_.StructField("n", T_.LongType())])}


def unit(spark, *docs):
    return spark.createDataFrame(list(docs), "vault_id string, relative_path string, text string")


def test_units_appear_together_and_one_of_two_writers_wins(spark, tmp_path):
    log = C.UnitLog(spark, str(tmp_path / "log"), SHAPES)
    assert log.version() == 0 and log.documents().count() == 0
    stale = lambda *x: spark.createDataFrame(list(x), "vault_id string, relative_path string, reason string")
    assert log.commit(0, documents=unit(spark, ("v", "a", "1"), ("v", "b", "1")), blocks=spark.createDataFrame([("v", 1)], SHAPES["blocks"])) == 1
    base = log.version()
    assert log.commit(base, documents=unit(spark, ("v", "a", "2")), invalidations=stale(("v", "a", "moved"), ("v", "b", "gone"))) == 2
    with pytest.raises(C.Conflict):
        log.commit(base, documents=unit(spark, ("w", "c", "3")))
    state = lambda v=None: {(r.relative_path, r.text, r.is_current, r.stale_reason) for r in log.documents(v).collect()}
    assert state() == {("a", "2", True, None), ("b", "1", False, "gone")} and state(1) == {("a", "1", True, None), ("b", "1", True, None)}
    assert {r.vault_id: r.generation for r in log.generations().collect()} == {"v": 2} and log.generation("w") == 0
    # both have read version 2, and both have written: the second rename fails
    manifest = {"version": 3, "folder": "x", "tables": [], "vaults": [], "base": False}
    log._publish(3, manifest)
    with pytest.raises(C.Conflict):
        log._publish(3, manifest)
    assert not list((tmp_path / "log/_drafts").glob("[!.]*"))
    # a writer that dies before its manifest leaves nothing that is read
    unit(spark, ("v", "z", "9")).write.parquet(str(tmp_path / "log/unit-dead/documents"))
    assert state() == {("a", "2", True, None), ("b", "1", False, "gone")}
    before = state()
    assert log.compact(log.version()) == 4 and state() == before and log.generation("v") == 2
    log.commit(4, documents=unit(spark, ("v", "b", "5")))
    assert state() == {("a", "2", True, None), ("b", "5", True, None)} and log.read("blocks").count() == 1
    with pytest.raises(ValueError):
        log.commit(5, other=unit(spark))


def test_a_stale_matrix_is_never_asked(spark, tmp_path):
    log = C.UnitLog(spark, str(tmp_path / "log"), SHAPES)
    loads = []

    def load(vault, profile):
        loads.append((vault, profile))
        return log.documents().where(F.col("vault_id") == vault)

    kept = C.VectorMatrices(log, load)
    log.commit(0, documents=unit(spark, ("v", "a", "1"), ("w", "a", "1")))
    old = kept.get("v", "p")
    assert old[0] == 1 and old[1].count() == 1 and kept.get("v", "p") is old and old[1].is_cached
    kept.get("w", "p")
    log.commit(1, documents=unit(spark, ("v", "b", "1")))
    new = kept.get("v", "p")
    assert new[0] == 2 and new[1].count() == 2 and not old[1].is_cached
    kept.get("w", "p")
    assert loads == [("v", "p"), ("w", "p"), ("v", "p")]
    kept.drop("v")
    assert not new[1].is_cached and list(kept.kept) == [("w", "p")]


# --- provenance


def test_every_invalid_provenance_is_refused(spark):
    good = ['schema_version: 1', 'vault_id: "v"', "source_id: s", "processing_task_id: t", f"source_sha256: {'c' * 64}", "source_path: a/b.pdf"]
    note = lambda fields, entries=("page: 1",), head="platform_provenance:": "---\ntitle: x\n" + head + "\n" + "".join(f"  {f}\n" for f in fields) + "  source_locators:\n" + "".join(f"    - {e}\n" for e in entries) + "tags: y\n---\nbody"
    swap = lambda k, v: [f"{k}: {v}" if f.startswith(k) else f for f in good]
    wrong = [swap("schema_version", v) for v in ("2", '"1"', "true", "1.0")] + [swap("vault_id", '"  "'), swap("vault_id", "3"), swap("source_sha256", "C" * 64), swap("source_sha256", "c" * 63)]
    wrong += [swap("source_path", p) for p in ("/a", "a//b", "../a", "a/../b", r"a\\b", "C:/x", '""', "a/", ".")] + [good[1:], [*good, "no colon here"], [*good, ": x"], [*good, "graph_id: g"], [*good, "graph_id: g", "graph_revision: 0", "selected_attempt_id: a"]]
    entries = [(), ("page: 0",), ('page: "1"',), ("page: true",), ("other: 1",), ('region: " "',), ("page: 1\n      docx_location: p",), ("type: pdf-region\n      page: 1\n      bounds: [0, 0, 0, 1]",), ("type: pdf-region\n      page: 1",), ("type: docx-ooxml\n      package_part_uri: x.xml\n      element_path: body",), ("type: 7",), ("page: 1", "page: 0")]
    texts = [note(f) for f in wrong] + [note(good, e) for e in entries]
    none = [None, "", "no front matter", "---\ntitle: x\n---\n", note(good)[4:]]
    whole = [note(good), note([*good, "graph_id: g", "graph_revision: 2", "selected_attempt_id: a"]), note(good, ("page: 3\n      region: top", "type: pdf-region\n      page: 1\n      bounds: [0, 0.5, 2, 1]", "type: docx-ooxml\n      package_part_uri: /word/document.xml\n      element_path: body/p")), note(good).replace("\n", "\r\n")]
    rows = spark.createDataFrame(list(enumerate(texts + none + whole)), "k int, text string")
    out = {r.k: r.p for r in rows.select("k", N.note_provenance("text").alias("p")).collect()}
    assert [k for k in range(len(texts)) if out[k] is None or out[k].issue != "unverifiable-provenance" or out[k].vault_id] == []
    a, b = len(texts), len(texts) + len(none)
    assert all(out[k] is None for k in range(a, b))
    last = [out[k] for k in range(b, b + len(whole))]
    assert [x.issue for x in last] == [None] * 4 and last[0].source_path == "a/b.pdf" and last[0].source_locators == ['{"page":1}']
    assert last[1].graph_revision == 2 and last[2].source_locators[0] == '{"page":3,"region":"top"}' and last[3].vault_id == "v"
