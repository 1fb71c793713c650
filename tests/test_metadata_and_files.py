"""Scopes of paths, rules, reports of a rerank, bound vectors, office files and artifacts."""

import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import metadata as M
from lodestrata.functions import text as X
from lodestrata.operators import enumeration as N
from lodestrata.operators import evaluation as V
from lodestrata.operators import lifecycle as C
from lodestrata.operators import scopes as S
from lodestrata.sources import artifacts as A
from lodestrata.sources import documents as D


def test_scopes_of_paths_fail_closed(spark):
    cases = [
        ("英语/七年级上册/第一单元/教材/语法.md", ["语法"], ("英语", "七年级上册", 1, "textbook", "resolved", "explicit-scope")),
        ("英语/7年级上册/Unit 12/a.md", ["unit 12", "第十二单元"], ("英语", "七年级上册", 12, None, "resolved", "explicit-scope")),
        ("英语/七年级上册/第一单元/教材/语法.md", ["第二单元", "语法"], (None, None, None, None, "recoverable", "conflicting-unit-no")),
        ("英语/数学/第一单元/第二单元/a.md", [], (None, None, None, None, "recoverable", "conflicting-subject")),
        ("a/练习册/笔记/x.md", [], (None, None, None, None, "recoverable", "conflicting-material-type")),
        ("第三十一单元/a.md", [], (None, None, 31, None, "recoverable", "incomplete-scope")),
        ("notes/a.md", [], (None, None, None, None, "recoverable", "scope-not-explicit")),
        ("英语 第一单元.md", [], (None, None, None, None, "unknown", "scope-not-explicit")),
        ("a.md", ["x"], (None, None, None, None, "recoverable", "scope-not-explicit")),
        ("unit 100/a.md", [], (None, None, None, None, "refused", "unit-out-of-range")),
        ("第一二单元/a.md", [], (None, None, None, None, "refused", "unit-out-of-range")),
        ("Unit 0/a.md", [], (None, None, None, None, "refused", "unit-out-of-range")),
        ("", [], (None, None, None, None, "refused", "path-not-normalised")),
        (None, [], (None, None, None, None, "refused", "path-not-normalised")),
        ("../英语/a.md", [], (None, None, None, None, "refused", "path-not-normalised")),
        ("英语\\a.md", [], (None, None, None, None, "refused", "path-not-normalised")),
        ("/a.md", [], (None, None, None, None, "refused", "path-not-normalised")),
        ("a.md", [" "], (None, None, None, None, "refused", "blank-heading")),
    ]
    df = spark.createDataFrame([(k, 1, p, h) for k, (p, h, _) in enumerate(cases)], "document_id int, sequence int, relative_path string, heading_path array<string>")
    got = {r.document_id: tuple(r.m) for r in df.select("document_id", M.scope_metadata(F.col("relative_path"), F.col("heading_path")).alias("m")).collect()}
    assert got == {k: want for k, (*_, want) in enumerate(cases)}
    rules = {r.document_id: (r.meta_status, r.meta_confidence) for r in M.rule_metadata(df).collect()}
    assert all(rules[k] == (("accepted", 0.95) if want[4] == "resolved" else ("required-check", None)) for k, (*_, want) in enumerate(cases))


def test_prefixes_of_questions(spark):
    assert S.query_prefixes("什么是第二章 Methods and Tools 是什么") == ["chapter2", "ch2", "第2章", "2章", "第二章", "什么是第二章", "methods and tools"]
    assert spark.createDataFrame([(None,), (" ",)], "q string").select(S.heading_query_prefixes("q").alias("p")).distinct().collect() == [([],)]


def test_deep_sections_and_their_limits(spark):
    ev = spark.createDataFrame([("p", f"{f}/{k}.md", 1) for f in "ab" for k in range(3)] + [("q", "z.md", 1)], "plan_id string, relative_path string, sequence int")
    sections, limits = N.deep_creation_sections(ev, spark.createDataFrame([("p", "x" * 300), ("q", "y"), ("r", "none")], "plan_id string, content string"), sources=4, most=6)
    assert [(r.plan_id, r.ordinal, r.section, r.evidence, len(r.objective)) for r in sections.orderBy("plan_id", "ordinal").collect()] == [("p", 1, "a", 3, 211), ("p", 2, "b", 1, 211), ("q", 1, "z.md", 1, 12)]
    assert {r.plan_id: (r.evidence, r.sources, r.exceeded) for r in limits.collect()} == {"p": (6, 6, True), "q": (1, 1, False), "r": (0, 0, False)}


def test_a_rerank_report_never_enables(spark):
    metrics = lambda *rows: spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], "query_id int, recall double, precision double, reciprocal_rank double")
    took = spark.createDataFrame([(float(x),) for x in range(1, 21)], "latency_ms double")
    gates = {"recall": 0.5, "precision": 0.1, "reciprocal_rank": 0.5, "p95_ms": 19.0}
    r = V.rerank_report(metrics((0, 0, 0), (0.5, 0.25, 0.5)), metrics((1, 0.25, 1), (0.5, 0.5, 1)), took, gates).first()
    assert (r.queries, r.recall_gain, r.precision_gain, r.reciprocal_rank_gain, r.p50_ms, r.p95_ms) == (2, 0.5, 0.25, 0.75, 10.0, 19.0)
    assert r.quality_passes and r.latency_passes and not r.enabled
    r = V.rerank_report(metrics((0, 0, 0)), metrics((1, 0, 1)), took, {**gates, "p95_ms": 18.5}).first()
    assert not r.quality_passes and not r.latency_passes


def test_live_scores_must_cover_every_candidate(spark):
    cands = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "d", 1)], "query_id int, candidate_id string, fused_rank int")
    score = lambda *rows: spark.createDataFrame(list(rows), "query_id int, candidate_id string, relevance double")
    good = [(1, "a", 0.2), (1, "b", 0.9), (1, "c", 0.2), (2, "d", 0.0)]
    assert [tuple(r) for r in V.live_rerank(cands, score(*good)).orderBy("query_id", "rank").collect()] == [(1, "b", 1), (1, "a", 2), (1, "c", 3), (2, "d", 1)]
    for bad, why in ((good[1:], "must be scored"), ([*good, (1, "x", 0.1)], "no candidate"), ([*good, good[0]], "twice"), ([*good[:3], (2, "d", float("nan"))], "must be scored")):
        with pytest.raises(Exception, match=why):
            V.live_rerank(cands, score(*bad)).collect()
    with pytest.raises(ValueError, match="too many"):
        V.live_rerank(cands, score(*good), requests=1)


def test_vectors_are_bound_to_blocks_as_they_are(spark):
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = spark.createDataFrame([("d", True, True, None, False), ("old", False, True, None, False)], "document_id string, is_current boolean, verifiable boolean, stale_reason string, pending_association boolean")
    blocks = spark.createDataFrame([(d, k, h(f"t{k}"), "", "", f"t{k}") for d in ("d", "old") for k in (1, 2, 3)], "document_id string, sequence int, block_content_sha256 string, contextual_prefix string, retrieval_text string, text string")
    key = {r.sequence: r.k for r in blocks.where("document_id = 'd'").select("sequence", X.cache_key(F.lit("p"), X.embedding_input(F.col("contextual_prefix"), F.col("retrieval_text"), F.col("text"))).alias("k")).collect()}
    shape = "document_id string, sequence int, profile_fp string, dimension int, block_content_sha256 string, input_sha256 string, vector array<float>"
    rows = lambda *x: spark.createDataFrame(list(x), shape)
    one = lambda k, v=(3.0, 4.0), **kw: tuple({"d": "d", "k": k, "p": "p", "n": len(v), "c": h(f"t{k}"), "i": key[k], "v": list(v), **kw}.values())
    first = C.bind_vectors(rows(), rows(one(1), one(2)), docs, blocks)
    assert {(r.sequence, r.state, tuple(round(x, 3) for x in r.vector)) for r in first.collect()} == {(1, "bound", (0.6, 0.8)), (2, "bound", (0.6, 0.8))}
    kept = spark.createDataFrame([r[:7] for r in first.collect()], shape)
    again = C.bind_vectors(kept, rows(one(1), one(3, (0.0, 1.0))), docs, blocks)
    assert {(r.sequence, r.state) for r in again.collect()} == {(1, "same"), (2, "kept"), (3, "bound")}
    for bad, why in ((one(1, (1.0, 0.0)), "another vector"), (one(3, (1.0, 0.0), c=h("was")), "has changed"), (one(3, (1.0, 0.0), i="0"), "has changed"), (one(3, (1.0, 0.0, 0.0)), "one dimension"), (one(3, (1.0, 0.0), d="old"), "not current"), (one(3, (1.0, 0.0), d="gone"), "not current")):
        with pytest.raises(Exception, match=why):
            C.bind_vectors(kept, rows(bad), docs, blocks).collect()
    with pytest.raises(Exception, match="two new vectors"):
        C.bind_vectors(kept, rows(one(3), one(3)), docs, blocks).collect()


W_ = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S_ = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def packed(**parts):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", body)
    return bytearray(raw.getvalue())


def test_nested_tables_and_dates_are_read_once(spark):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda x: f"<w:tbl><w:tr><w:tc>{x}</w:tc></w:tr></w:tbl>"
    docx = packed(word__document=f"<w:document {W_}><w:body>{p('one')}{p(' ')}<w:p><w:r><w:drawing/></w:r></w:p>{cell(p('outer') + p('more') + cell(p('inner')))}</w:body></w:document>")
    styles = f'<styleSheet {S_}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
    cells = '<c r="A1"><v>45000</v></c><c r="B1" s="1"><v>45000.5</v></c><c r="C1" s="2"><v>1</v></c><c r="AA3" s="3"><v>2.5</v></c><c r="D1" s="1"><f>NOW()</f><v>1</v></c>'
    xlsx = packed(xl__styles=styles, xl__worksheets__sheet1=f"<worksheet {S_}><sheetData><row>{cells}</row></sheetData></worksheet>", xl__worksheets__sheet2=f"<worksheet {S_}/>")
    files = spark.createDataFrame([("a", "docx", docx), ("b", "xlsx", xlsx), ("c", "docx", bytearray(b"no")), ("d", "pdf", bytearray(b"x")), ("e", "xlsx", None)], "path string, kind string, content binary")
    units = {(r.path, r.location): r.text for r in D.office_units(files.where("content IS NOT NULL")).collect() if r.text}
    assert units == {("a", "paragraph:1"): "one", ("a", "table:1/row:1/cell:1"): "outer\nmore", ("b", "sheet:1/cell:A1"): "45000", ("b", "sheet:1/cell:B1"): "2023-03-15 12:00:00", ("b", "sheet:1/cell:C1"): "1899-12-31 00:00:00", ("b", "sheet:1/cell:AA3"): "2.5", ("b", "sheet:1/cell:D1"): "=NOW()"}
    out = {r.path: r for r in D.preflight(files).collect()}
    assert (out["a"].paragraphs, out["a"].tables, out["a"].sheets, out["a"].issue) == (2, 1, None, None)
    assert (out["b"].sheets, out["b"].rows, out["b"].columns) == (2, [3, 0], [27, 0]) and out["a"].sha256 == hashlib.sha256(docx).hexdigest()
    assert out["c"].issue == out["e"].issue == "unreadable: BadZipFile" and out["d"].issue == "unsupported-kind"


def test_artifacts_are_promoted_whole_or_not_at_all(spark, tmp_path):
    store = A.ArtifactStore(spark, str(tmp_path / "store"))
    row = lambda k, b, h=None: (k, "page", "text/plain", h or hashlib.sha256(b).hexdigest(), bytearray(b))
    frame = lambda *x: spark.createDataFrame(list(x), A.COLUMNS)
    store.draft("one", frame(row("a", b"1"), row("b", b"2")))
    assert not (tmp_path / "store/attempts").exists()
    store.promote("one")
    assert {(r.artifact_id, bytes(r.content)) for r in store.read("one").collect()} == {("a", b"1"), ("b", b"2")}
    for name, rows, why in (("two", [row("a", b"1", "0" * 64)], "a: hash-differs"), ("three", [row("a", b"1"), row("a", b"2")], "a: id-repeated"), ("one", [row("z", b"3")], "exists already")):
        store.draft(name, frame(*rows))
        with pytest.raises(ValueError, match=why):
            store.promote(name)
        assert not (tmp_path / f"store/drafts/{name}").exists()
    store.draft("four", frame(row("a", b"1")))
    store.discard("four")
    store.draft("four", frame(row("a", b"1")))
    with pytest.raises(ValueError, match="plain name"):
        store.draft("../x", frame())
    files = lambda h: spark.createDataFrame([("in.pdf", h, bytearray(b"pdf"))], "path string, expected_sha256 string, content binary")
    assert store.snapshot("snap", files(hashlib.sha256(b"pdf").hexdigest())).first().path == "in.pdf"
    with pytest.raises(ValueError, match="hash-differs"):
        store.snapshot("snap2", files("0" * 64))


def test_golden_fixtures_are_checked_field_by_field(spark):
    import copy
    import json

    scopes = [{"scopeId": s, "label": s.upper()} for s in ("s1", "s2")]
    blocks = [{"blockId": f"b{k}", "scopeId": "s1" if k < 3 else "s2", "documentAlias": "d", "materialType": "m", "title": "t", "text": "x"} for k in range(5)]
    clusters = [{"clusterId": "c1", "blockIds": ["b0", "b1"]}]
    query = lambda k: {"queryId": f"q{k}", "intent": V.INTENTS[k % 3], "queryText": f"ask {k}", "expectedStatus": "resolved", "scopeId": "s1", "expectedBlockIds": ["b0", "b1"], "scopeBlockIds": ["b0", "b1", "b2"], "expectedDuplicateClusterIds": ["c1"]}
    queries = [query(k) for k in range(20)]
    queries[7] |= {"expectedStatus": "recoverable", "scopeId": None, "expectedBlockIds": [], "scopeBlockIds": [], "expectedDuplicateClusterIds": []}
    good = {"schemaVersion": 1, "fixtureId": "f", "provenance": "synthetic-deidentified", "scopes": scopes, "blocks": blocks, "duplicateClusters": clusters, "queries": queries}
    cases = {"good": (lambda f: None, set()), "text": (None, {("", "not-json")})}

    def case(name, change, *faults):
        cases[name] = (change, set(faults))

    case("top", lambda f: f.update(more=1), ("", "fixture-fields"))
    case("version", lambda f: f.update(schemaVersion=2, provenance="real"), ("", "schema-version"), ("", "provenance"))
    case("few", lambda f: f.update(queries=[q for q in f["queries"] if q["intent"] == "source-lookup"]), ("", "query-count"), ("", "intent-missing"), ("", "no-recoverable"))
    case("fields", lambda f: (f["scopes"][0].update(x=1), f["blocks"][0].pop("title"), f["queries"][3].pop("scopeBlockIds")), ("s1", "scope-fields"), ("b0", "block-fields"), ("b0", "block-blank"), ("q3", "query-fields"), ("q3", "query-without-evidence"), ("q3", "query-scope-not-whole"))
    case("repeat", lambda f: f["queries"].append(f["queries"][2]), ("q2", "query-repeated"))
    case("unknown", lambda f: (f["blocks"][4].update(scopeId="s9"), f["queries"][1].update(scopeId="s8", intent="x", expectedStatus="y", queryText="a\nb", expectedDuplicateClusterIds=["c7"])), ("b4", "block-scope-unknown"), ("q1", "query-intent"), ("q1", "query-text"), ("q1", "query-status"), ("q1", "query-cluster-unknown"))
    case("clusters", lambda f: f["duplicateClusters"].extend([{"clusterId": "c2", "blockIds": ["b1", "b3"]}, {"clusterId": "c3", "blockIds": ["b9"]}]), ("c1", "cluster-block-shared"), ("c2", "cluster-block-shared"), ("c2", "cluster-over-scopes"), ("c3", "cluster-too-small"), ("c3", "cluster-block-unknown"))
    case("evidence", lambda f: (f["queries"][7].update(scopeId="s1"), f["queries"][0].update(scopeBlockIds=["b0"], expectedBlockIds=["b0", "b3"])), ("q7", "recoverable-names-evidence"), ("q0", "query-scope-not-whole"), ("q0", "query-outside-scope"), ("q0", "query-cluster-outside"))
    rows = []
    for name, (change, _) in cases.items():
        f = copy.deepcopy(good)
        if change:
            change(f)
        rows.append((name, json.dumps(f) if change else "no json"))
    got = {name: set() for name in cases}
    for r in V.golden_faults(spark.createDataFrame(rows, "fixture string, json string")).collect():
        got[r.fixture].add((r.item, r.fault))
    assert got == {name: faults for name, (_, faults) in cases.items()}
