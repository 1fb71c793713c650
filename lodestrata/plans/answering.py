"""From documents and questions to packed evidence, by way of a stored index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.operators import ranking as R
from lodestrata.operators.chunking import chunk_markdown
from lodestrata.operators.lineage import cut, written


FIELDS = ["en", "cjk", "heading", "tag"]


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> dict[str, DataFrame]:
    """The index of Markdown or plain documents as three tables, to be written once and asked often.

    blocks: document_id, sequence, text and the weighted length. terms: what blocks hold
    (document_id, sequence, field, stem, tf), in ranges of the stem, so that a question
    reads the row groups of its own stems. vocabulary: CJK words of all headings.
    """
    chunks = chunk_markdown(docs, key, text).select(F.col(key).alias("document_id"), "sequence", "text", "heading_path", "contextual_prefix")
    retrieval_text = F.concat_ws("\n", F.when(F.col("contextual_prefix") != "", F.col("contextual_prefix")), "text")
    tagged = lambda rows: rows.withColumn("retrieval_text", retrieval_text).withColumn("tags", F.array().cast("array<string>"))
    fields = R.index_fields()
    # terms are made twice, as to write them with the blocks takes more bytes than the texts
    rows = written(tagged(chunks).withColumns(fields).withColumn("length", R.weighted_length({f: F.col(f) for f in FIELDS})).select(*chunks.columns, "length"))
    blocks = rows.select("document_id", "sequence", "text", "length")
    posts = R.stemmed_postings(tagged(rows).withColumns(fields), ["document_id", "sequence"], FIELDS)
    vocabulary = rows.where(F.size("heading_path") > 0).select(F.explode(X.cjk_vocabulary(F.col("heading_path"))).alias("word")).distinct()
    return {"blocks": blocks, "terms": posts.sortWithinPartitions("term"), "vocabulary": vocabulary}


def question_terms(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_id, term, field): stemmed Latin terms for the English, heading and tag columns, CJK tokens for the others.

    A question's CJK runs are cut by the words of the index's headings that it holds, as the indexed texts are.
    """
    latin = questions.select("query_id", F.explode(F.transform(X.english_terms(F.col("query")), lambda t: R.porter_stem(R.folded(t)))).alias("term"), F.array(*map(F.lit, ["en", "heading", "tag"])).alias("fields"))
    held = questions.join(vocabulary, F.contains(F.col("query"), F.col("word"))).groupBy("query_id").agg(F.collect_set("word").alias("words"))  # questions are few
    own = questions.join(held, "query_id", "left").withColumn("words", X.cjk_vocabulary(F.coalesce("words", F.array().cast("array<string>"))))
    cjk = own.select("query_id", F.explode(X.cjk_tokens(F.col("query"), F.col("words"))).alias("term"), F.array(*map(F.lit, ["cjk", "heading", "tag"])).alias("fields"))
    return latin.unionByName(cjk).select("query_id", "term", F.explode("fields").alias("field")).distinct()


def ask(index: dict[str, DataFrame], questions: DataFrame, k: int = 8) -> DataFrame:
    """Packed evidence per question from a built index: (query_id, place, document_id, sequence, excerpt, score)."""
    blocks, keys = index["blocks"], ["document_id", "sequence"]
    asked = cut(question_terms(questions, index["vocabulary"]))
    stems = [r.term for r in asked.select("term").distinct().collect()]  # of the questions, given by hand
    posts = index["terms"].where(F.col("term").isin(stems))  # pushed down to the files
    scores = R.bm25(posts, blocks.select(*keys, "length"), asked, keys)
    best = R.top_k(scores, k, keys).withColumnRenamed("rank", "place")
    return R.pack(blocks.select(*keys, "text").join(F.broadcast(best), keys), k)  # k blocks for each question


def answer(docs: DataFrame, questions: DataFrame, k: int = 8) -> DataFrame:
    """Builds the index of the documents in the shared folder and asks it."""
    from lodestrata.operators.lineage import shared_folder
    from lodestrata.sources.tables import VersionedTables

    spark = docs.sparkSession
    tables = VersionedTables(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    index = build_index(docs)
    lists = ("terms", "vocabulary")
    tables.write({name: index[name] for name in lists})
    return ask({"blocks": index["blocks"], **{name: tables.read(name) for name in lists}}, questions, k)  # the blocks stand in the folder already


def questions_of(spark: SparkSession, rows: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "query_id int, query string")


def hybrid(lexical: DataFrame, semantic: DataFrame, heading: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """Fusion of three ranked channels with the same key columns."""
    tagged = [df.withColumn("channel", F.lit(name)) for df, name in ((lexical, "lexical"), (semantic, "semantic"), (heading, "heading"))]
    keys = [c for c in lexical.columns if c not in ("query_id", "score", "rank")]
    every = tagged[0].select("query_id", "channel", "rank", *keys)
    for df in tagged[1:]:
        every = every.unionByName(df.select("query_id", "channel", "rank", *keys))
    return R.fuse(every, limit, keys, order)
