"""Exact deduplication as a stateful stream with native DataFrame operators only.

A file stream feeds a keyed aggregation whose state lives in RocksDB, without a
watermark, so no key ever expires. Per text digest the state retains the largest
stable identifier with its content locator (file and row) and a row count. Every
micro-batch publishes the keys it touched; the aggregates only grow, so the last
published value of a key is its largest. Then the full bytes of the rows that hit a
digest seen before are fetched by their locators and compared, and a digest that
stands for different texts is settled on the texts themselves.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import Workspace, fold_ascii

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",  # each store sets an eighth of it aside at once
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no room set aside for each
}

#: Bits of the table of rows whose bytes are compared: 4 MB.
BITS = 1 << 25


def sha256_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _keyed(rows: DataFrame, digest: Callable[[Column], Column], id_col: str, text_col: str) -> DataFrame:
    """id, digest, locator and folded text of each row."""
    folded = fold_ascii(F.col(text_col))
    return rows.select(
        F.struct(F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("loc"),
        digest(folded).alias("digest"),
        folded.alias("folded"),
    )


def _run_stream(spark: SparkSession, checkpoint: str, stream: DataFrame, out: str) -> None:
    """Folds the stream into the keyed state and publishes the keys that each batch touched."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        state = stream.groupBy("digest").agg(F.max("loc").alias("keep"), F.count("*").alias("n"))

        def publish(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        query = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(publish).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _as_pattern(path: str) -> str:
    """The path as a pattern that fits it alone: a file stream takes a plain path for a directory."""
    head, _, last = path.rstrip("/").rpartition("/")
    plain = lambda x: re.sub(r"([\\\\*?\[\]{}])", r"\\\1", x)
    return f"{plain(head)}/{{{plain(last)}}}"


def _hit_rows(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows that a bit table of the hits' locators lets pass: all hits, and few others while it is sparse.

    The table is ``BITS`` bits at most, in pieces of 2**15, so it may go to all tasks.
    """
    place = F.pmod(F.xxhash64("loc.file", "loc.row"), F.lit(BITS))
    piece, bit = F.bitmap_bucket_number(place).alias("piece"), F.bitmap_bit_position(place)
    table = hits.select(piece, bit.alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumns({"piece": piece, "bit": bit}).join(F.broadcast(table), "piece")
    return found.where(F.call_function("shiftright", byte, (F.col("bit") % 8).cast("int")).bitwiseAND(1) == 1).drop("piece", "bit", "bits")


def dedup_path(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_of,
    max_bytes_per_trigger: int = 64 << 30,
    state: str | None = None,
) -> DataFrame:
    """Decides for each row of the Parquet table at ``path`` whether it stays.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts the row with the largest id stays; rows that repeat both id and
    text tie, and the one with the largest locator stays. A null id is smaller than
    any other. An empty table gives an empty result. Other columns, whatever their
    names, are not read.

    ``state`` is a folder for the stream's state, in a store that all executors share. A
    later call with the same folder reads only files that came since, and these meet
    the digests of all earlier ones. Without it the state lasts for this call.

    Returns id, keep_id, group_size, kept, text_sha256, file, row: one line per row.
    """
    path = _as_pattern(path)
    schema = spark.read.parquet(path).select(id_col, text_col).schema
    names = {"digest": T.BinaryType(), "keep": T.StructType([T.StructField("id", schema[id_col].dataType), T.StructField("file", T.StringType()), T.StructField("row", T.LongType())]), "n": T.LongType(), "batch": T.IntegerType()}
    ws = Workspace(spark, "exact-dedup")
    state = state or ws.path("state")
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes_per_trigger)).parquet(path)
    out = f"{state}/touched"
    _run_stream(spark, f"{state}/checkpoint", _keyed(stream, digest, id_col, text_col).drop("folded"), out)
    spark.createDataFrame([], T.StructType([T.StructField(k, v) for k, v in names.items() if k != "batch"])).write.mode("overwrite").parquet(f"{out}/batch=-1")
    touched = spark.read.schema(T.StructType([T.StructField(k, v) for k, v in names.items()])).parquet(out)
    groups = ws.table(touched.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("n").alias("n")), "groups")
    rows = _keyed(spark.read.schema(schema).parquet(path), digest, id_col, text_col)
    slim = ws.table(rows.select("loc", "digest", F.sha2("folded", 256).alias("sha")), "slim")
    # full bytes of the hits alone: the least and the greatest text of a digest are the same bytes, or it stands for two texts
    hits = ws.table(slim.join(groups.where("n > 1").select("digest"), "digest", "left_semi").select("loc", "digest"), "hits")
    texts = _hit_rows(rows.select("loc", "folded"), hits).join(hits, "loc")
    clashes = ws.table(texts.groupBy("digest").agg((F.min("folded") == F.max("folded")).alias("same")).where("NOT same").select("digest"), "clashes")
    settled = slim.join(groups, "digest")
    if not clashes.isEmpty():
        exact = texts.join(clashes, "digest", "left_semi")
        best = exact.groupBy("folded").agg(F.max("loc").alias("keep"), F.count("*").alias("n"))
        own = exact.join(best, "folded").select("loc", "keep", "n", F.sha2("folded", 256).alias("sha"))
        settled = settled.join(clashes, "digest", "left_anti").select("loc", "keep", "n", "sha").unionByName(own)
    return settled.select(
        F.col("loc.id").alias("id"),
        F.col("keep.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("loc") == F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("loc.file").alias("file"),
        F.col("loc.row").alias("row"),
    )


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names."""
    ws = Workspace(spark, "exact-keep")
    table = ws.table(docs, "docs")
    kept = dedup_path(spark, table._written_at, id_col, text_col).where("kept").select(F.struct("file", "row").alias("at"))
    rows = table.select(F.struct(*table.columns).alias("doc"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"))
    return rows.join(kept, "at", "left_semi").select("doc.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_path(spark, f"{sf_dir}/documents.parquet")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY folded) AS keep_id, count(*) OVER (PARTITION BY folded) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY folded) AS kept, sha256(folded) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM documents)
"""
