import pytest
from pyspark.sql import functions as F

from lodestrata.operators import aggregates as A
from lodestrata.operators import enumeration as N
from lodestrata.operators import evaluation as V
from lodestrata.operators import filters as L
from lodestrata.operators import joins as J
from lodestrata.operators import layout as Y
from lodestrata.operators import lifecycle as C
from lodestrata.operators import ranking as R


def test_policy_matches_prefixes_by_stage(spark):
    items = spark.createDataFrame([(1, "Secret/a.md", None), (2, "secretx/a.md", None), (3, "b/c.md", "notes/d.md")], "item_id int, source_path string, derived_path string")
    rules = spark.createDataFrame([("r1", "completely-ignore", "secret"), ("r2", "never-send-cloud", "notes")], "rule_id string, kind string, relative_path string")
    at = lambda stage: {r.item_id: r.allowed for r in L.evaluate_policy(items, rules, stage).collect()}
    assert at("index") == {1: False, 2: True, 3: True}
    assert at("outbound") == {1: False, 2: True, 3: False}


def test_fusion_counts_places_and_keeps_semantic_only_hits(spark):
    rows = [(1, "lexical", 1, "a"), (1, "lexical", 2, "a"), (1, "lexical", 3, "b"), (1, "semantic", 1, "c"), (1, "semantic", 2, "b")]
    got = R.fuse(spark.createDataFrame(rows, "query_id int, channel string, rank int, id string"), 3, ["id"], ["id"]).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "a", "c"] and got[0].channels == ["lexical", "semantic"]
    assert got[0].score == round(1 / 63 + 1 / 62, 9)


def test_heading_counts_more_than_body(spark):
    blocks = spark.createDataFrame([(1, 1, "force force", ["x"], []), (2, 1, "other words", ["force"], [])], "document_id int, sequence int, retrieval_text string, heading_path array<string>, tags array<string>")
    posts = R.stemmed(R.postings(blocks, ["document_id", "sequence"], R.index_fields()))
    lengths = posts.groupBy("document_id", "sequence").agg(F.sum("tf").alias("length"))
    query = spark.createDataFrame([(1, "forc", f) for f in R.FIELD_WEIGHTS] + [(1, "force", f) for f in R.FIELD_WEIGHTS], "query_id int, term string, field string")
    assert R.bm25(posts, lengths, query, ["document_id", "sequence"]).orderBy(F.desc("score")).first().document_id == 2


def test_rerank_falls_back_on_a_partial_answer(spark):
    cand = spark.createDataFrame([(q, f"candidate0{k}", k) for q in (1, 2) for k in (1, 2)], "query_id int, candidate_id string, fused_rank int")
    scores = spark.createDataFrame([(1, "candidate01", 0.1), (1, "candidate02", 0.9), (2, "candidate01", 0.3)], "query_id int, candidate_id string, relevance double")
    got = {(r.query_id, r.final_rank): (r.candidate_id, r.status) for r in R.rerank(cand, scores).collect()}
    assert got[1, 1] == ("candidate02", "applied") and got[2, 1] == ("candidate01", "invalid")


def test_packing_stops_at_the_budget(spark):
    rows = spark.createDataFrame([(1, p, p, 1, ("x" * 90 if p != 2 else "  "), 1.0) for p in range(1, 6)], "query_id int, place int, document_id int, sequence int, text string, score double")
    got = R.pack(rows, 8, 80, 200).orderBy("place").collect()
    assert [(r.document_id, len(r.excerpt)) for r in got] == [(1, 80), (3, 80), (4, 40)]


def test_expansion_puts_hits_first(spark):
    blocks = spark.createDataFrame([(1, s, f"t{s}") for s in range(1, 6)], "document_id int, sequence int, text string")
    hits = spark.createDataFrame([(1, 3, 0.5, 1), (1, 2, 0.4, 2)], "document_id int, sequence int, score double, rank int")
    assert [r.sequence for r in R.expand(hits, blocks).orderBy("place").collect()] == [3, 2, 4, 1]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0])], "id int, vector array<double>")
    assert {r.id for r in R.broken_vectors(v).collect()} == {3, 4}
    assert [r.score for r in R.nearest(v.where("id < 3"), [2.0, 0.0], 2, ["id"]).collect()] == [1.0, 0.6]
    for broken in (3, 4):
        with pytest.raises(Exception, match=f"broken vector: {broken}"):
            R.nearest(v.where(f"id IN (1, {broken})"), [2.0, 0.0], 2, ["id"]).collect()


def test_porter(spark):
    pairs = {"nationalization": "nation", "relational": "relat", "happiness": "happi", "adjustment": "adjust", "caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "conditional": "condit", "formaliti": "formal", "electrical": "electr", "replacement": "replac", "adoption": "adopt", "controll": "control", "rate": "rate", "cease": "ceas", "generalizations": "gener", "sky": "sky", "is": "is"}
    df = spark.createDataFrame(list(pairs.items()), "w string, s string")
    assert [(r.w, r.p, r.s) for r in df.select("w", "s", R.porter_stem(F.col("w")).alias("p")).collect() if r.p != r.s] == []
    assert spark.range(1).select(R.folded(F.lit("àéîõüçñ")).alias("t")).first().t == "aeioucn"


def test_expansion_is_per_query(spark):
    blocks = spark.createDataFrame([(1, k, f"t{k}") for k in range(1, 9)], "document_id int, sequence int, text string")
    hits = spark.createDataFrame([(1, 1, 3, 0.9, 1), (2, 1, 7, 0.5, 1)], "query_id int, document_id int, sequence int, score double, rank int")
    got = R.expand(hits, blocks, 2).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.sequence) for r in got] == [(1, 3), (1, 2), (2, 7), (2, 6)]


def test_atoms_clusters_and_batches(spark):
    items = spark.createDataFrame(
        [(1, "planned", "grammar", "h1", 5, "Verb tenses", "a"), (2, "planned", "phrase", "h1", 9, "other", "a"), (3, "planned", "grammar", None, 0, "tense forms", "abc"), (4, "excluded", "grammar", "h4", 5, "x", "a")],
        "ordinal int, disposition string, knowledge_kind string, block_content_sha256 string, token_estimate int, heading string, excerpt string",
    )
    atoms = N.atomic_items(items)
    got = {r.ordinal: r for r in atoms.collect()}
    assert got[1].source_ordinals == [1, 2] and got[1].token_estimate == 9 and got[1].knowledge_kind == "grammar" and got[3].token_estimate == 3
    assert {(r.ordinal, r.cluster) for r in N.candidate_clusters(atoms).collect()} == {(1, 1), (3, 1)}
    batches = N.map_reduce_batches(atoms.withColumn("plan_id", F.lit(1)), 10, 1)
    assert {r.ordinal: r.batch for r in batches.collect()} == {1: 1, 3: 0}
    results = N.execute_coverage(items.withColumn("plan_id", F.lit(1)))
    assert {r.ordinal: r.result for r in results.collect()} == {1: "processed", 2: "duplicate", 3: "duplicate", 4: "excluded"}
    assert N.coverage_status(results).first().status == "excluded"


def test_reconcile_and_versions(spark):
    schema = "document_id string, vault_id string, relative_path string, content_sha256 string, is_current boolean, stale_reason string, observed_mtime_ns long, observed_size long, policy_revision long"
    docs = spark.createDataFrame([("d1", "v", "a.md", "h1", True, None, 1, 1, 1), ("d2", "v", "b.md", "h2", True, None, 1, 1, 1)], schema)
    files = spark.createDataFrame([("a.md", "h9", 2, 1), ("c.md", "h3", 1, 1), ("e.md", "h2", 1, 1)], "relative_path string, content_sha256 string, mtime_ns long, size long")
    got = {r.relative_path: (r.action, r.pending_association) for r in C.reconcile(files, docs, 1).collect()}
    assert got == {"a.md": ("update", False), "b.md": ("missing", False), "c.md": ("index", True), "e.md": ("index", False)}
    new = spark.createDataFrame([("d3", "v", "a.md", "h9", True, None, 2, 1, 1), ("d4", "v", "b.md", "h2", True, None, 1, 1, 1)], schema)
    after = C.upsert_versions(docs, new)
    assert {(r.document_id, r.is_current) for r in after.collect()} == {("d1", False), ("d2", True), ("d3", True)}
    assert C.upsert_versions(after, new).count() == 3


def test_audit_and_gate(spark):
    from lodestrata.functions.text import block_hash

    b = spark.createDataFrame([("d", 1, "x", "l", "", ["h"], 0.5, 1, ""), ("d", 2, "y", "l", "bad", ["h"], 0.5, 1, "")], "document_id string, sequence int, text string, location string, block_content_sha256 string, heading_path array<string>, confidence double, token_estimate int, retrieval_text string")
    assert {(r.sequence, r.code) for r in C.audit_blocks(b).collect()} == {(1, "block-content-sha256-missing"), (2, "block-content-sha256-mismatch")}
    with pytest.raises(Exception, match="inconsistent"):
        C.require_sound(b).collect()
    assert C.require_sound(b.withColumn("block_content_sha256", block_hash(F.col("text")))).count() == 2


def test_embedding_uses_the_cache(spark):
    docs = spark.createDataFrame([("d", True, True, None, False)], "document_id string, is_current boolean, verifiable boolean, stale_reason string, pending_association boolean")
    blocks = spark.createDataFrame([("d", 1, "", "", "same", "h"), ("d", 2, "", "", "same", "h"), ("d", 3, "", "", "![a](b)", "h")], "document_id string, sequence int, contextual_prefix string, retrieval_text string, text string, block_content_sha256 string")
    none = spark.createDataFrame([], "input_sha256 string, vector array<float>, profile_fp string, dimension int")
    cache, vectors = C.embed(docs, blocks, none, "p", lambda texts: [[3.0, 4.0] for _ in texts])
    assert cache.count() == 1 and vectors.count() == 2
    assert [round(x, 6) for x in vectors.first().vector] == [0.6, 0.8]


def test_layout(spark):
    rows = [("g", 1, "b1", "paragraph", "Report", 1, 0.0, 5.0, 50.0, 10.0), ("g", 2, "b2", "paragraph", "running head", 1, 0.0, 0.0, 50.0, 4.0), ("g", 3, "b3", "paragraph", "1.2 Scope", 1, 0.0, 30.0, 50.0, 34.0),
            ("g", 4, "b4", "image", "", 1, 0.0, 40.0, 50.0, 60.0), ("g", 5, "b5", "paragraph", "Figure 1 x", 1, 0.0, 62.0, 50.0, 66.0), ("g", 6, "b6", "paragraph", "end.", 1, 0.0, 90.0, 50.0, 100.0),
            ("g", 7, "b7", "paragraph", "Running  Head", 2, 0.0, 0.0, 50.0, 4.0), ("g", 8, "b8", "paragraph", "tail.", 2, 0.0, 90.0, 50.0, 100.0)]
    b = spark.createDataFrame(rows, "graph_id string, reading_order int, block_id string, kind string, text string, page int, x1 double, y1 double, x2 double, y2 double")
    got = {r.block_id: r for r in Y.normalize(b).collect()}
    assert got["b1"].kind == "heading" and got["b1"].level == 1 and got["b2"].noise and got["b7"].noise
    assert got["b3"].kind == "heading" and got["b3"].level == 2 and got["b5"].kind == "caption"
    assert {r.block_id: r.heading_path for r in Y.heading_context(Y.normalize(b)).collect()}["b8"] == ["Report", "1.2 Scope"]


def test_metrics(spark):
    q = spark.createDataFrame([("q1", ["a", "b"], ["a"], [["a", "b", "c"]], "resolved"), ("q2", [], [], [], "recoverable")], "query_id string, expected_block_ids array<string>, scope_block_ids array<string>, expected_clusters array<array<string>>, expected_status string")
    p = spark.createDataFrame([("q1", ["a", "x"], ["a"], [["a", "b"]], "resolved"), ("q2", [], [], [], "recoverable")], "query_id string, retrieved_block_ids array<string>, scoped_block_ids array<string>, duplicate_clusters array<array<string>>, scope_status string")
    got = {r.query_id: r for r in V.query_metrics(q, p).collect()}
    assert (got["q1"].recall, got["q1"].precision, got["q1"].duplicate_precision, round(got["q1"].duplicate_recall, 3)) == (0.5, 0.5, 1.0, 0.333)
    assert got["q2"].recall == 1.0
    assert {r.problem for r in V.golden_problems(q).collect()} == {"query-count"}


def test_joins_and_percentiles(spark):
    rows = spark.createDataFrame([("i", 1, "a"), ("i", 2, "b")], "item_id string, revision int, v string")
    assert J.latest(rows, ["item_id"], "revision").first().v == "b"
    journal = spark.createDataFrame([("t", "u", "d", "prepared"), ("t", "u", "d", "failed"), ("t", "w", "d", "prepared")], "task_id string, unit_id string, digest string, status string")
    assert [r.unit_id for r in J.unfinished(journal).collect()] == ["w"]
    n = spark.range(1, 11).withColumnRenamed("id", "v")
    assert A.percentile_nearest(n, "v", 0.95).first().v == 10 and A.percentile_nearest(n, "v", 0.5).first().v == 5
    words = spark.createDataFrame([("t", 1, 1, 1, 1, 2, 10, 0, 5, 5, 80.0, "b", 5), ("t", 1, 1, 1, 1, 1, 0, 0, 5, 6, 90.0, "a", 5)], "target_id string, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string, level int")
    line = A.ocr_lines(words).first()
    assert (line.text, line.confidence, line.x2, line.y2) == ("a b", 85.0, 15, 6)
