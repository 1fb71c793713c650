"""The job queue, listings with filters, and the state of answers that are being made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def next_jobs(jobs: DataFrame, per: str = "vault_id") -> DataFrame:
    """Per vault the oldest pending job; a vault with a running job has none, as one job runs at a time."""
    busy = jobs.where("status = 'running'").select(per).distinct()
    oldest = jobs.where("status = 'pending'").groupBy(per).agg(F.min(F.struct("created_at", "job_id")).alias("j"))
    return oldest.join(busy, per, "left_anti").select(per, "j.job_id", "j.created_at")


def newest_failed(jobs: DataFrame, keys: list[str] = ["vault_id", "paths_key"]) -> DataFrame:  # noqa: B006
    """The newest failed job of each scope that nothing newer has replaced: what a retry would repeat."""
    last = jobs.groupBy(*keys).agg(F.max(F.struct("created_at", "job_id", "status", "reason")).alias("j"))
    return last.where("j.status = 'failed'").select(*keys, "j.job_id", "j.reason", "j.created_at")


def recent_activity(events: DataFrame, most: int = 12, per: str = "vault_id") -> DataFrame:
    """The latest events of each vault, newest first; the limit is the report's."""
    w = W.partitionBy(per).orderBy(F.desc("created_at"), F.desc("event_id"))
    return events.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def in_turn(jobs: DataFrame, per: str = "vault_id") -> DataFrame:
    """Each vault's jobs with their place in a queue that one consumer serves first in, first out."""
    w = W.partitionBy(per).orderBy("created_at", "job_id")
    return jobs.where("status = 'pending'").withColumn("place", F.row_number().over(w))


def invalidate_generations(generations: DataFrame, changes: DataFrame) -> DataFrame:
    """Running answers whose snapshot or scope changed after they began are void, with the reason of the earliest change."""
    hit = generations.join(changes, "snapshot_id").where("status IN ('queued', 'running') AND changed_at >= started_at")
    first = hit.groupBy("generation_id").agg(F.min(F.struct("changed_at", "reason")).alias("c"))
    out = generations.join(first, "generation_id", "left")
    void = F.col("c").isNotNull()
    return out.withColumn("status", F.when(void, "invalidated").otherwise(F.col("status"))).withColumn("invalid_reason", F.col("c.reason")).drop("c")


def session_page(sessions: DataFrame, number: int, size: int, text: str = "", archived: bool | None = None, sort: str = "updated_at") -> DataFrame:
    """One page of sessions: filtered by title and state, newest first or by title without regard to case."""
    from lodestrata.operators.ranking import page

    rows = sessions.where(F.contains(F.lower("title"), F.lit(text.lower()))) if text else sessions
    if archived is not None:
        rows = rows.where(F.col("archived") == archived)
    order = [F.lower("title"), F.col("session_id")] if sort == "title" else [F.desc(sort), F.col("session_id")]
    return page(rows, order, number, size)


def file_page(files: DataFrame, number: int, size: int, kind: str | None = None, text: str = "", descending: bool = False) -> DataFrame:
    """One page of files in path order without regard to case, of one preview kind if given."""
    from lodestrata.functions.paths import preview_kind
    from lodestrata.operators.ranking import page

    rows = files if kind is None else files.where(preview_kind(F.col("relative_path")) == kind)
    if text:
        rows = rows.where(F.contains(F.lower("relative_path"), F.lit(text.lower())))
    key = F.lower("relative_path")
    return page(rows, [key.desc() if descending else key.asc(), F.col("relative_path")], number, size)
