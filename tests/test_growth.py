"""What grows with the input alone: rows that are shuffled or joined, counted by Spark while a small case runs."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import text as X
from lodestrata.operators import lifecycle as C
from lodestrata.operators import ranking as R


def counted(df, metric: str) -> int:
    """The largest value that an operator of a plan that has run counted."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            most = max([most, *[node.metrics().apply(m).value() for m in [metric] if node.metrics().contains(m)]])
            children = node.children()
            todo += [children.apply(k) for k in range(children.size())]
    return most


def shuffled(df) -> int:
    return counted(df, "shuffleRecordsWritten")


def rows(df) -> int:
    return counted(df, "numOutputRows")


def test_pairs_of_one_root_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(C, "CELL", 250, raising=False)
    vaults = spark.range(2000).select(F.col("id").alias("vault_id"), F.lit("/a/B").alias("root_path"))
    per_task = C.overlapping_roots(vaults).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count_if(F.col("outer_id") == F.col("inner_id")).alias("own"))
    got = per_task.collect()
    assert sum(r.n for r in got) == 2000 * 1999 and not sum(r.own for r in got)
    assert len(got) >= 16 and 4 * max(r.n for r in got) <= 2000 * 1999
    assert shuffled(per_task) <= 40_000


def test_roots_in_several_cells_and_vaults_with_several_roots(spark, monkeypatch):
    monkeypatch.setattr(C, "CELL", 3)
    roots = [(k, ["/a", "/A/b", "/a/b/c", "/ab", "", "/a/"][k % 6]) for k in range(40)] + [(0, "/a/b"), (0, "/a/b"), (7, "/ab/x"), (None, "/a"), (50, None)]
    df = spark.createDataFrame(roots, "vault_id long, root_path string")
    got = [tuple(r) for r in C.overlapping_roots(df).collect()]
    low = [(v, r.lower()) for v, r in roots if v is not None and r is not None]
    want = {(o, i) for o, a in low for i, b in low if o != i and (a == b or b.startswith(a + "/"))}
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_of_one_root_take_little_room(spark, tmp_path):
    """All pairs of a root are many rows; written, each takes a fraction of a byte."""
    vaults = spark.range(1500).select(F.col("id").alias("vault_id"), F.lit("/a/B").alias("root_path"))
    C.overlapping_roots(vaults).write.parquet(str(tmp_path / "pairs"))
    back = spark.read.parquet(str(tmp_path / "pairs"))
    assert back.count() == back.distinct().count() == back.where("outer_id BETWEEN 0 AND 1499 AND inner_id BETWEEN 0 AND 1499 AND outer_id <> inner_id").count() == 1500 * 1499
    assert 4 * sum(p.stat().st_size for p in (tmp_path / "pairs").rglob("*.parquet")) < 1500 * 1499


def test_pairs_leave_a_cell_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(C, "RUN", 4)
    monkeypatch.setattr(C, "PAIRS", 20)
    rng = random.Random(3)
    cells = [([rng.randrange(40) for _ in range(rng.randrange(1, 30))], [rng.randrange(40) for _ in range(rng.randrange(1, 30))]) for _ in range(60)]
    for kind in (pa.int64(), pa.string()):
        lists = [pa.array([[x if kind == pa.int64() else str(x) for x in c[k]] for c in cells], pa.list_(kind)) for k in (0, 1)]
        batch = pa.RecordBatch.from_arrays(lists, names=["outer_ids", "inner_ids"])
        got = [list(zip(*(c.to_pylist() for c in b.columns))) for b in C._pairs(iter([batch.slice(5), batch.slice(0, 5), batch.slice(0, 0)]))]
        assert sorted(x for b in got for x in b) == sorted((x, y) for o, i in zip(*(c.to_pylist() for c in batch.columns)) for x in o for y in i if x != y)
        assert max(map(len, got)) <= 40


def test_version_candidates_do_not_meet_all_of_a_label(spark):
    known = spark.range(300).selectExpr("id AS source_id", "'h' || id % 7 AS content_sha256", "'L' AS label", "300 - id AS created_at")
    new = spark.range(400).selectExpr("id AS source_id", "'h' || id % 9 AS content_sha256", "'l' AS label")
    df = R.version_candidates(new, known)
    got = {r.source_id: r.version_of for r in df.collect()}
    first = lambda k: min((300 - j, j) for j in range(300) if j % 7 != k % 9)[1]
    assert got == {k: first(k) for k in range(400)}
    assert rows(df) <= 1_000


def test_version_candidates_without_content_or_label(spark):
    known = spark.createDataFrame([(1, None, "a", 1), (2, "x", "a", 2), (3, "x", "A", 3), (4, "y", None, 1)], "source_id long, content_sha256 string, label string, created_at int")
    new = spark.createDataFrame([(11, "x", "a"), (12, "z", "A"), (13, None, "a"), (14, "z", None), (15, "z", "q")], "source_id long, content_sha256 string, label string")
    assert {r.source_id: r.version_of for r in R.version_candidates(new, known).collect()} == {11: None, 12: 2, 13: None, 14: None, 15: None}


def test_small_pdf_files_share_batches(spark):
    """Java sees a batch of pages for many files, not one for each."""
    from lodestrata.sources import pdf as D

    raw = b"%PDF-1.4\n1 0 obj << /Pages 2 0 R >> endobj\n2 0 obj << /Kids [3 0 R 3 0 R] >> endobj\n3 0 obj << /Contents 4 0 R >> endobj\n4 0 obj << /Length 9 >> stream\n(one) Tj \nendstream endobj\ntrailer << /Root 1 0 R >>"

    class Files:
        select = lambda self, *c: self
        mapInArrow = lambda self, f, schema: f

    run = D.pdf_pages(Files())
    table = pa.table({"path": [str(k) for k in range(7000)], "content": [raw if k % 2 else None for k in range(7000)]})
    batches = list(run(iter(table.to_batches(max_chunksize=1000))))
    assert sum(b.num_rows for b in batches) == 7000 and len(batches) == 2
    got = pa.Table.from_batches(batches).to_pylist()
    assert [(r["path"], r["page"], r["text"], r["issue"]) for r in got[:3]] == [("0", 0, None, "unreadable-file"), ("1", 1, "one", None), ("2", 0, None, "unreadable-file")]


def test_pdf_pages_are_read_in_many_tasks(spark):
    from lodestrata.plans.queries import QUERIES

    assert QUERIES["pdf_pages"](spark, "/root/testdata/sf0.001").select(F.spark_partition_id()).distinct().count() >= 16


def test_equal_titles_are_numbered_in_one_pass(spark):
    """A name's next number is remembered: no search from 2 on for each of many equal titles."""
    n = 6_000
    df = spark.range(n).selectExpr("0 AS doc", "id AS k", "CASE WHEN id % 2 = 0 THEN 'Same' ELSE 'sAme' END AS title")
    start = time.monotonic()
    got = {r.k: r.name for r in X.unique_names(df, "doc", "k", "title").collect()}
    seconds = time.monotonic() - start
    assert got == {k: ("sAme" if k % 2 else "Same") + (f" ({k + 1})" if k else "") for k in range(n)}
    assert seconds < 8


def test_names_against_a_plain_walk(spark):
    """Titles that hold numbers themselves, cases that lower and casefold tell apart, and names that are taken."""
    pool = ["a", "A (2)", "a (2)", "a (3)", "a (2) (2)", "a (02)", "a (1)", "Straße", "STRASSE", "strasse (2)", "x", "X"]
    rng = random.Random(5)
    data = [(d, k, rng.choice(pool)) for d in range(12) for k in range(40)]
    df = spark.createDataFrame(data, "doc int, k int, title string")
    want = {}
    for d in range(12):
        gone = {"a (4)", "x"}
        for _, k, stem in sorted(r for r in data if r[0] == d):
            name, m = stem, 2
            while name.casefold() in gone:
                name, m = f"{stem} ({m})", m + 1
            gone.add(name.casefold())
            want[d, k] = name
    got = X.unique_names(df, "doc", "k", "title", F.array(F.lit("A (4)"), F.lit("x"))).collect()
    assert {(r.doc, r.k): r.name for r in got} == want


def test_equal_requests_are_read_once(spark):
    from lodestrata.operators import scopes as S

    blocks = spark.createDataFrame([(["Asia", "Japan end"],), (["Asia", "China end"],)], "heading_path array<string>")
    asked = spark.range(600).selectExpr("id AS query_id", "CASE WHEN id % 3 = 0 THEN 'list \"Japan end\" materials' WHEN id % 3 = 1 THEN NULL ELSE 'list \"Peru end\" materials' END AS content")
    df = S.heading_scopes(blocks, asked)
    got = {r.query_id: (r.state, r.path) for r in df.collect()}
    assert got == {k: [("resolved", ["Asia", "Japan end"]), ("open", None), ("closed", None)][k % 3] for k in range(600)}
    assert counted(df, "pythonNumRowsReceived") <= 20


def test_places_meet_in_place_of_blocks(spark):
    from lodestrata.operators import joins as J

    df = spark.range(3000).selectExpr("'g' AS graph_id", "id AS block_id", "id % 5 AS page", "'Head' AS text", "1D AS x1", "1D AS y1", "2D AS x2", "2D AS y2", "100D AS page_width", "100D AS page_height")
    more = spark.createDataFrame([("g", 1, 9, "head", 1.0, 1.0, 2.0, 2.0, 100.0, 100.0)], df.schema)  # an id that stands at two places
    out = J.same_position(df.unionByName(more))
    assert {r.block_id: r.pages for r in out.collect()} == {k: 6 if k == 1 else 5 for k in range(3000)}
    assert rows(out) <= 10_000


def test_answers_are_measured_without_counting_their_tokens(spark):
    from lodestrata.operators import provider as P

    n = P.MOST_ANSWER
    texts = ["a" * (3 * n), "a" * (3 * n + 1), ("ab\t\n") * n, ("ab ") * (n + 1), "é" * n, "é" * (n + 1), "　 \x1c x \x85\x0b", "\x1f ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: (r.over, r.s, r.state) for r in df.select("k", (P._over(F.col("t"), n)).alias("over"), P._stripped(F.col("t")).alias("s"), P.answer_state(F.col("t"), F.array(F.lit("x"))).alias("state")).collect()}
    assert [got[k][0] for k in range(6)] == [False, True, False, True, False, True]
    assert got[6][1:] == ("x", "ok") and got[7][1:] == ("", "empty") and got[8][2] == "not-text"


def _peak(run) -> int:
    import tracemalloc

    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_long_texts_are_not_all_python_strings_at_once():
    from lodestrata.functions import images as I
    from lodestrata.operators import provider as P

    text = pa.array([f"{k} ![[a.png]] " + "word words" * 1000 for k in range(5000)])  # 50 MB
    found = []
    assert _peak(lambda: found.append(I.image_references.func(text, pa.array(["n.md"] * 5000)))) < 25_000_000
    assert [r["source"].as_py() for r in found[0][7]["images"]] == ["a.png"] and len(found[0]) == 5000
    refs = pa.array([[{"start": 1, "end": 2, "alt": "", "target": "b.png"}]] * 5000)
    assert _peak(lambda: I._replaced.func(text, refs)) < 30_000_000
    given = []

    class Answers:
        schema = {"id": T.StructField("id", T.LongType())}
        select = lambda self, *c: self
        mapInArrow = lambda self, f, kinds: f

    run = P.note_bodies(Answers(), "id")
    batch = pa.record_batch({"id": range(5000), "markdown": text, "weights": [[1, 2]] * 5000})
    assert _peak(lambda: [given.append(b.num_rows) for b in run(iter([batch]))]) < 40_000_000
    assert sum(given) == 10_000 and len(given) > 5


def test_furniture_needs_no_table_of_pages(spark):
    from lodestrata.operators import layout as Y

    data = [("g", 1, "a", "paragraph", "Head ", 0.0, 1.0), ("g", 2, "b", "paragraph", "head", 0.0, 2.0), ("g", 2, "c", "image", "", 0.0, 50.0), ("g", 1, "d", "image", "", 0.0, 50.0), ("g", 1, "e", "paragraph", "one", 49.0, 50.0), ("g", None, "f", "paragraph", "head", 0.0, 1.0), (None, 1, "h", "paragraph", "head", 0.0, 1.0), ("g", 3, "i", "paragraph", "head", 20.0, 30.0), ("g", 3, "j", "image", "", 0.0, 100.0), ("g", 3, "k", "paragraph", None, 0.0, 1.0), ("g", 2, "l", "paragraph", None, 0.0, 1.0)]
    df = spark.createDataFrame(data, "graph_id string, page int, block_id string, kind string, text string, y1 double, y2 double")
    out = Y.furniture(df)
    assert {r.block_id for r in out.collect()} == {"a", "b"}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
