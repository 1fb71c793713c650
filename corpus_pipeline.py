"""From raw documents to token ids: five operators in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. Between stages the rows are written as Parquet
and read again, so a stage never recomputes its predecessors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.bpe import encode_texts, word_vocabulary
from lodestrata.llm.common import Workspace, read
from lodestrata.llm.exact_dedup import keep_one
from lodestrata.llm.mixing import mixed
from lodestrata.llm.ngram_join import link_components
from lodestrata.llm.toxicity import fitted, score_texts
from lodestrata.shipping import ship

#: Rows that Spark hands to Python at once, at most. A batch is held by the JVM and by the Python worker, for each task of an
#: executor; ten thousand whole texts, Spark's default, are tens of MB in both.
ROWS_AT_ONCE = 1000

#: Documents that score this much or more go.
TOXIC = 0.7


def prepare(spark: SparkSession) -> None:
    """Ships the package, and lowers the session's rows of an Arrow batch if they are more (0: no bound). No result depends on them."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_AT_ONCE:
        spark.conf.set(key, ROWS_AT_ONCE)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity score rejects go, each by its own text."""
    prepare(spark)
    machine = fitted(spark, docs, read(spark, sf_dir, "labels"))
    score = "_".join(["score", *docs.columns])  # no column has this name
    return score_texts(spark, docs, machine, out_col=score).where(F.col(score) < TOXIC).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    prepare(spark)
    return keep_one(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-copies link, the one with the smallest id stays, and so does each document without links.

    Rows that repeat an id are told apart by a hash of their text; rows with a null id stay.
    """
    prepare(spark)
    gone = link_components(spark, docs).where("id != component").select("id", "mark").distinct()
    same = (docs["doc_id"] == gone["id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["mark"])
    return docs.join(gone, same, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    prepare(spark)
    return mixed(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and a hash of what they decode to."""
    prepare(spark)
    out = encode_texts(spark, docs.select("doc_id", "source", "text"), word_vocabulary(), remember=30_000, keep_text=False)  # workers hold what earlier stages left, too
    return out.select("doc_id", "source", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can state neither the learned scores nor the merges of the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``."""
    ws = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = ws.table(docs, name)
    return docs
