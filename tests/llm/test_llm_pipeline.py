"""The corpus pipeline stage by stage on the smallest tables, against what each stage should decide."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lodestrata.llm.common import read

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = read(spark, DATA, "documents"), {}
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, DATA).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_columns_and_shrinking(spark, stages):
    docs = read(spark, DATA, "documents")
    for name in ("toxicity", "exact_dedup", "ngram_join", "mixing"):
        assert stages[name].columns == docs.columns
    n = [docs.count()] + [stages[k].count() for k in ("toxicity", "exact_dedup", "ngram_join")]
    assert n == sorted(n, reverse=True) and n[-1] > n[0] // 2


def test_no_copies_and_no_near_copies_are_left(stages):
    rows = stages["ngram_join"].select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    ids = sorted(sets)
    assert not [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] | sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]


def test_clean_documents_stay(spark, stages):
    labels = read(spark, DATA, "labels").where("toxic = 0").select("doc_id")
    gone = labels.join(read(spark, DATA, "documents"), "doc_id").join(stages["toxicity"], "doc_id", "left_anti").count()
    assert gone <= 1


def test_encoding_covers_the_mix(stages):
    assert stages["bpe"].count() == stages["mixing"].count()
    assert {r.doc_id for r in stages["mixing"].collect()} <= {r.doc_id for r in stages["ngram_join"].collect()}
    ends = stages["bpe"].collect()
    import hashlib

    from tokenizers import Tokenizer

    from lodestrata.llm.bpe import word_vocabulary

    library = Tokenizer.from_file(word_vocabulary())
    for r in ends[:20]:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_python_gets_few_rows_at_once(spark):
    """Ten thousand texts at once, in the JVM and in Python, took an executor's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    docs = spark.range(2500).selectExpr("id AS doc_id", "'one text' AS text", "'en' AS lang", "'s' AS source", "8 AS n_chars").coalesce(1)
    try:
        for given, most in (("10000", 1000), ("0", 1000), ("300", 300)):
            spark.conf.set(key, given)
            assert P.encode(spark, docs, DATA).count() == 2500
            assert max(r.n for r in docs.mapInArrow(rows, "n long").collect()) == most
    finally:
        spark.conf.set(key, before)


def test_awkward_rows(spark, tmp_path):
    """Nulls in all columns, empty texts, repeated ids with other texts, clashing names; then no rows at all."""
    words = lambda k: " ".join(np.random.default_rng(k).choice([f"w{j}" for j in range(500)], 60))
    rows = [(k, words(k), "en", "s" if k % 2 else None, 1) for k in range(40)] + [(None, None, None, None, None), (50, "", "en", "s", 0), (50, words(3), "en", "s", 1), (3, words(99), None, None, 1), (51, words(5) + " x", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"score": F.lit("clash"), "size": F.lit("clash"), "id": F.lit("clash"), "component": F.lit("clash")})
    spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(8)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        at = table
        for k, (name, stage) in enumerate(P.STAGES):
            out = stage(spark, at, str(tmp_path))
            assert k == len(P.STAGES) - 1 or out.columns == docs.columns
            path = f"{tmp_path}/{name}{table is docs}"
            out.write.parquet(path)
            at = spark.read.parquet(path)
            if name == "ngram_join" and table is docs:
                kept = {(r.doc_id, r.text) for r in at.collect()}
                assert (3, words(99)) in kept and (3, words(3)) not in kept and (50, words(3)) in kept  # the largest id of equal texts
                assert (5, words(5)) in kept and (51, words(5) + " x") not in kept
        assert (at.count() > 0) == (table is docs)
