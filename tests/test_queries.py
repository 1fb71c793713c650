"""Each query against its SQL on the smallest tables, and the queries without SQL for plausible rows."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sql, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), sql.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).values))
    assert rows(got) == rows(want)


def test_chunks_keep_all_texts_in_order(spark):
    """Without headings, tables and wide lines a document's chunks are its lines, packed; nothing is lost."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    chunks: dict = {}
    for r in QUERIES["markdown_chunks"](spark, DATA).orderBy("doc_id", "sequence").collect():
        chunks.setdefault(r.doc_id, []).append(r)
    assert set(chunks) == set(docs)
    for i, rows in chunks.items():
        assert [r.sequence for r in rows] == list(range(1, len(rows) + 1)) and all(0 < len(r.text) <= 800 for r in rows)
        if (docs[i] or "").strip() and "|" not in docs[i]:
            assert "".join("".join(r.text for r in rows).split()) == "".join(docs[i].split())


def test_map_reduce_plan_against_a_plain_walk(spark):
    from lodestrata.operators import enumeration as N

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.select(F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").alias("ordinal"), F.when(F.contains(F.lower("text"), F.lit("license")), "exercise").otherwise("other").alias("knowledge_kind"), F.sha2("text", 256).alias("block_content_sha256"), X.provider_token_estimate(F.col("text")).alias("token_estimate"))
    items: dict = {}
    for r in N.first_of_content(rows, "source").collect():
        items.setdefault(r.source, []).append((N.KINDS.index(r.knowledge_kind), r.ordinal, max(r.token_estimate, 1)))
    expected = {}
    for plan, mine in items.items():
        batch, kind, held = 0, None, 0
        for k, ordinal, cost in sorted(mine):
            if cost <= 4000 and (k != kind or held + cost > 4000):
                batch, kind, held = batch + 1, k, 0
            held += cost if cost <= 4000 else 0
            expected[plan, ordinal] = batch if cost <= 4000 and batch <= 12 else 0
    assert {(r.source, r.ordinal): r.batch for r in QUERIES["map_reduce_plan"](spark, DATA).collect()} == expected


def test_batches_of_one_large_plan_do_not_depend_on_its_size(spark):
    from lodestrata.operators import enumeration as N

    rows = spark.range(3000).select(F.lit("p").alias("plan_id"), F.col("id").alias("ordinal"), F.when(F.col("id") % 2 == 0, "grammar").otherwise("other").alias("knowledge_kind"), (F.col("id") % 7).cast("int").alias("token_estimate"))
    got = {r.ordinal: r.batch for r in N.map_reduce_batches(rows, 20, 5).collect()}
    batch, held, expected = 0, 99, {}
    for k in range(0, 3000, 2):
        cost = max(k % 7, 1)
        batch, held = (batch + 1, cost) if held + cost > 20 else (batch, held + cost)
        expected[k] = batch if batch <= 5 else 0
    assert got == {**dict.fromkeys(range(3000), 0), **expected}


def test_postings_by_stem_do_not_depend_on_the_way(spark):
    from lodestrata.operators import ranking as R

    rows = spark.createDataFrame([(1, ["running", "runs", "the"], ["run"]), (2, None, ["Ran", "runs"]), (3, [], None)], "k int, a array<string>, b array<string>")
    want = sorted(map(tuple, R.stemmed(R.postings(rows, ["k"], {"a": F.col("a"), "b": F.col("b")})).select("k", "field", "term", "tf").collect()))
    for most in (0, 100):
        assert sorted(map(tuple, R.stemmed_postings(rows, ["k"], ["a", "b"], most).select("k", "field", "term", "tf").collect())) == want and len(want) == 5


def test_answers_against_plain_bm25(spark):
    import math
    from collections import Counter

    from lodestrata.operators import ranking as R
    from lodestrata.plans import answering

    index = answering.build_index(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"))
    questions = answering.questions_of(spark, [(1, "Which license does the text name?"), (2, "permission of the stone")])
    tf: dict = {}
    for r in index["terms"].collect():
        tf.setdefault((r.document_id, r.sequence), Counter())[r.term, r.field] += r.tf
    length = {(r.document_id, r.sequence): r.length for r in index["blocks"].collect()}
    mean = sum(length.values()) / len(length)
    weight = {(r.query_id, r.term, r.field) for r in answering.question_terms(questions, index["vocabulary"]).collect()}
    got: dict = {}
    for r in answering.ask(index, questions).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(((r.document_id, r.sequence), r.score))
    for q in (1, 2):
        terms = {t for i, t, _ in weight if i == q}
        hits = {t: {b: sum(R.FIELD_WEIGHTS[f] * c[t, f] for f in R.FIELD_WEIGHTS if (q, t, f) in weight) for b, c in tf.items()} for t in terms}
        score = Counter()
        for t, by in hits.items():
            by = {b: w for b, w in by.items() if w}
            for b, w in by.items():
                score[b] += math.log(1 + (len(length) - len(by) + 0.5) / (len(by) + 0.5)) * w * 2.2 / (w + 1.2 * (0.25 + 0.75 * length[b] / mean))
        best = sorted(((-round(s, 6), b) for b, s in score.items()))[:8]
        assert [b for b, _ in got[q]] == [b for _, b in best] and all(abs(s + t) < 1e-5 for (_, s), (t, _) in zip(got[q], best))


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[:2] == ["query_id", "place"]


def test_duplicate_clusters_of_page_headings(spark, tmp_path):
    texts = ["Alpha one. Shared theorem", "Beta two. shared Theorems here", "Gamma. Nothing", "Delta. 三角函数", "Epsilon five. x 三角函数", "Zeta. Alone", None, "", "Alpha. In another language"]
    rows = [(k, t, "de" if k == 8 else "en") for k, t in enumerate(texts)]
    rows += [(100 + k, f"n{1000 + k}z. n{1001 + k}z", "fr") for k in range(40)]
    html = lambda t: None if t is None else f"<p>common words of all pages</p><H2 class='x'><i>{t}</i></H2><p>common</p>"
    pages = [(k, f"http://{lang}/{k}", html(t)) for k, t, lang in rows]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    terms = {r.doc_id: set(r.t) for r in spark.createDataFrame(rows, "doc_id long, text string, lang string").select("doc_id", X.concept_terms(F.col("text")).alias("t")).collect()}
    root = {k: k for k, _, _ in rows}
    for _ in rows:
        for a, _, x in rows:
            for b, _, y in rows:
                if x == y and terms[a] & terms[b]:
                    root[a] = root[b] = min(root[a], root[b])
    want = {(k, v) for k, v in root.items() if list(root.values()).count(v) > 1}
    assert {(0, 0), (1, 0), (3, 3), (4, 3), (139, 100)} <= want
    got = QUERIES["duplicate_clusters"](spark, str(tmp_path)).collect()
    assert {(r.ordinal, r.cluster) for r in got} == want


def test_an_index_moves_texts_twice_and_its_postings_once(spark):
    import re

    from lodestrata.operators import ranking as R
    from lodestrata.operators.chunking import chunk_markdown

    plan = lambda df: re.findall(r"Exchange (\w+)", df._jdf.queryExecution().executedPlan().toString())
    docs = spark.createDataFrame([(k, "# Head\n\nsome runs\n\n* running\n") for k in range(20)], "doc_id long, text string")
    assert plan(chunk_markdown(docs)) == ["hashpartitioning"] * 2
    rows = spark.range(2500).select(F.col("id").alias("k"), F.expr("array('runs', 'running', concat('w', id % 700), null)").alias("a"), F.expr("if(id % 3 = 0, array('Ran', 'ran'), null)").alias("b")).coalesce(1)
    want = sorted(map(tuple, R.stemmed(R.postings(rows, ["k"], {"a": F.col("a"), "b": F.col("b")})).where("term IS NOT NULL").select("k", "field", "term", "tf").collect()))
    for most in (1, 3000, 10**6):
        posts = R.stemmed_postings(rows, ["k"], ["a", "b"], most)
        assert plan(posts) == ["rangepartitioning"]
        assert sorted(map(tuple, posts.select("k", "field", "term", "tf").collect())) == want
