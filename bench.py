"""Times the headline queries once each after a warm-up and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lodestrata.operators.lineage import shared_folder
from lodestrata.plans import answering
from lodestrata.plans.queries import QUERIES, QUESTIONS
from lodestrata.sources.tables import VersionedTables

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["answer_question", "markdown_chunks", "content_groups", "term_statistics", "lexical_top8", "vector_top50", "fused_top8", "task_overview", "latest_revision", "first_reference", "policy_decisions", "coverage_plan", "duplicate_clusters", "map_reduce_plan", "recall_at_8", "nearest_rank_p95", "daily_events"]


def knn(spark: SparkSession, rows: int = 20_000, size: int = 1024, questions: int = 256, repeat: int = 11) -> dict[str, float]:
    """Exact neighbours over seeded vectors kept as blocks: the median of one question and of many at once, and the drift of their halves."""
    import statistics

    from pyspark.sql import functions as F

    from lodestrata.operators.vector_blocks import nearest_in_blocks, vector_blocks

    drawn = spark.range(0, rows + questions, 1, int(CPUS)).select("id", F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: (F.xxhash64(F.col("id"), k, F.lit(7)) / F.lit(2.0**63)).cast("float")).alias("vector")).cache()
    blocks = vector_blocks(drawn.where(F.col("id") < rows), "id").cache()
    blocks.count()
    out = {}
    for name, n in (("one", 1), ("many", questions)):
        asked = drawn.where((F.col("id") >= rows) & (F.col("id") < rows + n)).select(F.col("id").alias("query_id"), "vector").cache()
        asked.count()
        took = []
        for _ in range(repeat + 1):
            began = time.time()
            nearest_in_blocks(blocks, asked, 8).collect()
            took.append(time.time() - began)
        took = took[1:]  # the first warms up
        halves = [statistics.median(took[: repeat // 2]), statistics.median(took[repeat // 2 :])]
        out[f"{name}_ms"] = round(1000 * statistics.median(took) / n, 3)
        out[f"{name}_drift"] = round(abs(halves[0] - halves[1]) / min(halves), 3)
    spark.catalog.clearCache()
    return out


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    sink(QUERIES["content_groups"](spark, SF_DIR))
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        sink(QUERIES[name](spark, SF_DIR))
        seconds[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    index = answering.build_index(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text"))
    stored = VersionedTables(spark, f"{shared_folder(spark)}/bench-index-{os.getpid()}")
    stored.write(index)
    began = time.time()
    sink(answering.ask({name: stored.read(name) for name in index}, answering.questions_of(spark, QUESTIONS)))
    seconds["ask_stored_index"] = round(time.time() - began, 3)
    neighbours = knn(spark)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rstrip("/").rpartition("sf")[2], "knn_20000x1024": neighbours}))
    spark.stop()


if __name__ == "__main__":
    main()
