from pyspark.sql import functions as F

from lodestrata.functions import paths as P
from lodestrata.functions import text as X
from lodestrata.operators.ranking import porter_stem


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_cjk_tokens_prefer_vocabulary_then_bigrams(spark):
    vocabulary = X.cjk_vocabulary(F.array(F.lit("力的合成"), F.lit("合成")))
    assert values(spark, ["力的合成法", "牛顿第", "光", "plain"], X.cjk_tokens(F.col("x"), vocabulary)) == [["力的合成"], ["牛顿", "顿第"], [], []]


def test_terms_and_stems(spark):
    assert values(spark, ["The re-use of the_x"], X.english_terms(F.col("x"))) == [["the", "re-use", "of", "the_x"]]
    assert values(spark, ["ponies", "hopping", "agreed", "filing", "is", "sky"], porter_stem(F.col("x"))) == ["poni", "hop", "agre", "file", "is", "sky"]
    assert values(spark, ["Review of forces", "Policies and cases"], X.concept_terms(F.col("x"))) == [["force"], ["case", "policy"]]


def test_query_intents(spark):
    asked = ["list all units", "draft a note", "整理", "key concepts", "what are key concepts?", "hello"]
    assert values(spark, asked, X.query_intent(F.col("x"))) == ["completeness", "deep-creation", "knowledge-organization", "knowledge-organization", "source-lookup", "source-lookup"]


def test_token_estimate_counts_scripts_apart(spark):
    assert values(spark, ["", "abcde f!", "漢字"], X.token_estimate(F.col("x"))) == [0, 4, 2]


def test_front_matter_tags(spark):
    texts = ["---\ntags: [a, 'b', a]\n---\nx", '---\ntags:\n  - one\n  - "two"\nother: 1\n---\nx', "---\ntags: a, b\n---\nx", "no tags"]
    assert values(spark, texts, X.tags(F.col("x"))) == [["a", "b"], ["one", "two"], [], []]


def test_block_hash_ignores_line_ends_and_outer_space(spark):
    a, b, c = values(spark, ["x\r\ny", "  x\ny\n", "x y"], X.block_hash(F.col("x")))
    assert a == b != c


def test_paths(spark):
    assert values(spark, ["A\\b/./C", "/abs", "c:\\x", "a/../b", " "], P.normal_path(F.col("x"))) == ["a/b/c", None, None, None, None]
    assert values(spark, ["a/b", "a", "ab"], P.under(F.col("x"), F.lit("a"))) == [True, True, False]
    assert values(spark, ["n.MD", "w.dot", "x.bin", "none"], P.source_kind(F.col("x"))) == ["markdown", "doc", "unsupported", "unsupported"]
    assert values(spark, ["see /etc/passwd", "http://a/b", "C:\\x", "plain"], P.holds_absolute_path(F.col("x"))) == [True, False, True, False]


def test_small_helpers(spark):
    assert values(spark, [0, 25, 26, 701, 702], X.column_letters(F.col("x")), "x int") == ["A", "Z", "AA", "ZZ", "AAA"]
    assert values(spark, ["a", "b"], X.join_wrapped(F.array(F.lit("inter-"), F.lit("nal x"), F.lit("y")))) == ["internal x y"] * 2
    assert values(spark, ["one two three"], X.search_excerpt(F.col("x"), F.lit("TWO"), 2, 5)) == ["e two t"]
    assert values(spark, ['["a","b"]', "bad", None], X.string_list(F.col("x"))) == [["a", "b"], [], []]
    assert values(spark, ["![a](b.png) text", "![[x]]"], X.embedding_input(F.lit("[p]"), F.lit(None).cast("string"), F.col("x"))) == ["[p]\n\ntext", None]
    assert values(spark, ["algebra", "poem"], X.domain_of(F.col("x"))["needs_review"]) == [False, True]
