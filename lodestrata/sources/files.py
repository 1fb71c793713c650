"""Files of a vault as tables: listings, kinds, content hashes, Markdown texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import paths


def _relative(root: str):
    return F.regexp_replace(F.col("path"), f"^(?:file:)?/*{root.removeprefix('file:').strip('/')}/", "")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, size, modified_at of all files below the root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(_relative(root).alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))


def scan(spark: SparkSession, root: str, ignored: list[str] = []) -> DataFrame:  # noqa: B006
    """Files with kind, category and sha256 of their bytes; ignored directories are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.select(_relative(root).alias("relative_path"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_sha256"))
    for p in ignored:
        rows = rows.where(~paths.under(F.col("relative_path"), F.lit(p)))
    kind = paths.source_kind(F.col("relative_path"))
    return rows.withColumn("kind", kind).withColumn("category", F.when(F.col("kind") == "unsupported", "unsupported").otherwise("supported"))


def find_by_hash(files: DataFrame, digest: str) -> DataFrame:
    return files.where(F.col("content_sha256") == digest).select("relative_path").orderBy("relative_path")


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """relative_path and text of all Markdown files."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).select(_relative(root).alias("relative_path"), "text")


def read_ocr_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Recognised words of tab-separated recognition output, one file per target."""
    schema = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"
    return spark.read.option("sep", "\t").option("header", "true").option("quote", "").schema(schema).csv(path).withColumn("target_id", F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]*$", 1))
