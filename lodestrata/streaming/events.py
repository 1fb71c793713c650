"""Streams: a resumable event log, incremental indexing, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def after_cursor(events: DataFrame, cursor: int) -> DataFrame:
    """Events past a cursor, in order: the batch form of the resumable log."""
    return events.where(F.col("event_id") > cursor).orderBy("event_id")


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New files of events as a stream; the checkpoint holds the cursor."""
    return spark.readStream.schema(schema).parquet(path)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what is new to Parquet and stops; a rerun goes on where this one ended."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def index_incrementally(spark: SparkSession, stream: DataFrame, tables, checkpoint: str, build) -> StreamingQuery:
    """Folds batches of changed documents into versioned tables; a batch that runs twice changes nothing more."""
    from lodestrata.operators.lifecycle import upsert_versions

    def apply(batch: DataFrame, _: int) -> None:
        incoming = build(batch)
        old = tables.read("documents") if tables.version() else incoming.limit(0)
        tables.write({"documents": upsert_versions(old, incoming)})

    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events per day and type with a watermark: an extension of this engine, in batch and stream alike."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def queue_once(jobs: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested jobs that no pending or running job covers already."""
    keys = ["vault_id", "paths_key", "reason"]
    return requested.dropDuplicates(keys).join(jobs.where(F.col("status").isin("pending", "running")), keys, "left_anti")


def recover(jobs: DataFrame) -> DataFrame:
    """After a crash: running jobs failed, with the reason."""
    hit = F.col("status") == "running"
    return jobs.withColumn("error", F.when(hit, "interrupted").otherwise(F.col("error"))).withColumn("status", F.when(hit, "failed").otherwise(F.col("status")))


#: What a task does again after it was interrupted, by the phase it was in (fixed values).
AGAIN = {"parsing": "restart-parse", "ocr": "restart-ocr", "deriving-markdown": "restart-derivation", "committing": "retry-commit"}


def recover_journals(journals: DataFrame, now) -> DataFrame:
    """The journals with a ``failed`` entry for each unit that was prepared and has no end yet.

    journals: task_id, unit_id, snapshot_digest, status, reason, created_at. A unit that
    is prepared twice fails once; running it again changes nothing.
    """
    key = ["task_id", "unit_id", "snapshot_digest"]
    ended = journals.where("status IN ('committed', 'failed')").select(*key).distinct()
    open_ = journals.where("status = 'prepared'").select(*key).distinct().join(ended, key, "left_anti")
    reason = F.lit("interrupted before its result was recorded")
    return journals.unionByName(open_.select(*key, F.lit("failed").alias("status"), reason.alias("reason"), now.cast(journals.schema["created_at"].dataType).alias("created_at")))


def recover_tasks(tasks: DataFrame, now) -> DataFrame:
    """After a crash: running tasks can be recovered, by the action that their phase needs; others stay as they are.

    tasks: task_id, lifecycle, phase, recovery_action, failure_reason, updated_at.
    """
    hit = F.col("lifecycle") == "running"
    again = F.create_map(*[F.lit(x) for kv in AGAIN.items() for x in kv])
    action = F.coalesce(F.try_element_at(again, F.col("phase")), F.lit("restart-scan"))
    new = {"recovery_action": action, "failure_reason": F.concat_ws(" ", F.lit("interrupted in"), "phase"), "phase": F.lit("interrupted"), "lifecycle": F.lit("recoverable"), "updated_at": now.cast(tasks.schema["updated_at"].dataType)}
    return tasks.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in tasks.columns])
