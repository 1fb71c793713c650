"""Counters, health reports, groupings and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.filters import eligible


def task_counters(items: DataFrame, ocr: DataFrame, notes: DataFrame, suggestions: DataFrame) -> DataFrame:
    """One row per task: items by category, identity, parse state, open checks, notes, doubtful suggestions."""
    from lodestrata.operators.joins import latest

    n = lambda c: F.count_if(c)
    own = items.groupBy("task_id").agg(
        F.count("*").alias("discovered"),
        *[n(F.col("category") == c).alias(c) for c in ("supported", "skipped", "unsupported", "failed")],
        n(F.col("identity_status") == "new").alias("new_count"),
        n(F.col("identity_status") == "duplicate").alias("duplicate_count"),
        n(F.col("version_candidate_source_id").isNotNull()).alias("possible_version_count"),
        n(F.col("identity_status") == "identity-failed").alias("identity_failed_count"),
        n(F.col("parse_status") == "parsed").alias("parsed_count"),
        n(F.col("parse_status") == "parse-failed").alias("parse_failed_count"),
        (n(F.col("parse_issue_count") > 0) + n(F.col("conversion_status") == "rejected")).alias("item_checks"),
    )
    owner = items.select("item_id", "task_id")
    scans = ocr.join(owner, "item_id").groupBy("task_id").agg(
        n((F.col("issue_count") > 0) & F.col("decision").isNull()).alias("ocr_checks"),
        n(F.col("status") == "completed").alias("ocr_completed_count"),
        n(F.col("status") == "failed").alias("ocr_failed_count"),
        n(F.col("decision") == "excluded").alias("confirmed_gap_count"),
    )
    derived = notes.where("invalidated_at IS NULL").groupBy("task_id").agg(F.count_distinct("item_id").alias("derived_note_count"))
    doubtful = latest(suggestions.where("invalidated_at IS NULL"), ["task_id", "item_id"], "revision").groupBy("task_id").agg(n((F.col("confidence") < 0.75) & F.col("decision").isNull()).alias("classification_checks"))
    out = own.join(scans, "task_id", "left").join(derived, "task_id", "left").join(doubtful, "task_id", "left").na.fill(0)
    return out.withColumn("required_check_count", F.col("item_checks") + F.col("ocr_checks")).drop("item_checks", "ocr_checks")


def health_status() -> Column:
    return F.when(F.col("failed") > 0, "failed").when((F.col("stale") > 0) | (F.col("pending") > 0), "stale").when(F.col("current") > 0, "healthy").otherwise("not-initialized")


def index_health(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per vault: current, stale, failed and pending counts, and the state they amount to.

    Current documents are those that wait for no association, stale ones among them;
    jobs that failed or still run count as failed.
    """
    now = F.col("is_current")
    d = documents.groupBy("vault_id").agg(F.count_if(now & ~F.col("pending_association")).alias("current"), F.count_if(now & F.col("stale_reason").isNotNull()).alias("stale"), F.count_if(now & F.col("pending_association")).alias("pending"))
    j = jobs.groupBy("vault_id").agg(F.count_if(F.col("status").isin("failed", "running")).alias("failed"))
    return d.join(j, "vault_id", "full_outer").na.fill(0).withColumn("status", health_status())


def health_samples(documents: DataFrame, jobs: DataFrame, most: int = 10) -> DataFrame:
    """vault_id, kind, place, path, detail: the newest stale and pending documents and failed jobs of each vault, as examples.

    documents: vault_id, relative_path, is_current, stale_reason, pending_association,
    indexed_at; jobs: vault_id, relative_path, status, updated_at. Ties go by path.
    """
    from pyspark.sql import Window as W

    row = lambda df, kind, when, detail: df.select("vault_id", F.lit(kind).alias("kind"), F.col("relative_path").alias("path"), detail.alias("detail"), F.col(when).alias("at"))
    none = F.lit(None).cast("string")
    now = documents.where("is_current")
    rows = row(now.where("stale_reason IS NOT NULL"), "stale", "indexed_at", F.col("stale_reason")).unionByName(row(now.where("pending_association"), "pending", "indexed_at", none)).unionByName(row(jobs.where("status IN ('failed', 'running')"), "failed", "updated_at", F.col("status")))
    w = W.partitionBy("vault_id", "kind").orderBy(F.desc("at"), "path")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("at")


def semantic_coverage(documents: DataFrame, blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Blocks that the best-covered profile has vectors for, out of all eligible blocks."""
    known = blocks.join(documents.where(eligible()).select("document_id", "vault_id"), "document_id")
    total = known.groupBy("vault_id").agg(F.count("*").alias("eligible_blocks"))
    hit = vectors.join(known.select("document_id", "sequence", "block_content_sha256", "vault_id"), ["document_id", "sequence", "block_content_sha256"])
    best = hit.groupBy("vault_id", "profile_fp").agg(F.count("*").alias("n")).groupBy("vault_id").agg(F.max("n").alias("covered_blocks"))
    out = total.join(best, "vault_id", "left").withColumn("covered_blocks", F.coalesce("covered_blocks", F.lit(0)))
    return out.withColumn("status", F.when(F.col("covered_blocks") == 0, "unavailable").when(F.col("covered_blocks") < F.col("eligible_blocks"), "partial").otherwise("available"))


def scope_preview(blocks: DataFrame, by: str = "material_type") -> DataFrame:
    """Documents and blocks per material type; unlabelled ones are counted under a name of their own."""
    return blocks.groupBy(F.coalesce(by, F.lit("unlabelled")).alias(by)).agg(F.count_distinct("document_id").alias("documents"), F.count("*").alias("blocks"))


def evidence_groups(evidence: DataFrame) -> DataFrame:
    """Derived evidence by source, native by content, in order of first sight."""
    key = F.when(F.col("document_kind") == "derived", F.concat(F.lit("source:"), F.col("source_id"))).otherwise(F.concat(F.lit("content:"), F.col("content_sha256")))
    return evidence.groupBy(key.alias("group")).agg(F.min("ordinal").alias("first"), F.count("*").alias("n"), F.sort_array(F.collect_list("ordinal")).alias("ordinals"))


def ocr_lines(words: DataFrame) -> DataFrame:
    """Lines of recognised words (level 5): text in word order, mean confidence, common box."""
    w = words.where((F.col("level") == 5) & (F.trim("text") != ""))
    box = {"x1": F.min("left"), "y1": F.min("top"), "x2": F.max(F.col("left") + F.col("width")), "y2": F.max(F.col("top") + F.col("height"))}
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_num", "text"))), lambda s: s["text"]), " ")
    return w.groupBy("target_id", "page_num", "block_num", "par_num", "line_num").agg(text.alias("text"), F.avg("conf").alias("confidence"), *[v.alias(k) for k, v in box.items()])


def needs_fallback(confidence: Column, issues: Column) -> Column:
    """Whether the next recognition engine should try: little confidence, or a telling issue."""
    return (confidence < 70) | F.arrays_overlap(issues, F.array(*map(F.lit, ["ocr-empty-result", "ocr-low-confidence", "ocr-garbled-text", "ocr-confidence-unavailable"])))


def percentile_nearest(values: DataFrame, column: str, fraction: float, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The nearest-rank percentile: the value at ceil(n * fraction), counted from 1.

    Counts per value come first, so the ranks are running sums over distinct values.
    """
    from pyspark.sql import Window as W

    counts = values.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("__n"))
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    upto = F.sum("__n").over(part.orderBy(column).rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("__n").over(part)
    ranked = counts.withColumn("__upto", upto).withColumn("__want", F.greatest(F.ceil(total * F.lit(fraction)), F.lit(1)))
    return ranked.where("__upto >= __want").groupBy(*keys).agg(F.min(column).alias(column))


def median(values: DataFrame, column: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    return values.groupBy(*keys).agg(F.percentile(column, 0.5).alias(column))


def macro_average(metrics: DataFrame, *columns: str) -> DataFrame:
    return metrics.agg(*[F.avg(c).alias(c) for c in columns])


def workbench(tasks: DataFrame) -> DataFrame:
    """Per vault: how many tasks run, need attention or are done, and the last change."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return tasks.groupBy("vault_id").agg(F.count("*").alias("total"), n("running", "queued").alias("running"), n("blocked", "failed").alias("attention"), n("completed").alias("completed"), F.max("updated_at").alias("last_change"))


def vault_states(vaults: DataFrame, health: DataFrame, tasks: DataFrame) -> DataFrame:
    """vault_id, state: what a vault's row in the overview says, the first that holds of inactive, unavailable, attention, running and healthy.

    vaults: vault_id, authorization_status, access_status; health: as ``index_health``
    gives it (a vault without a row, or one that is not open, needs attention); tasks:
    vault_id, lifecycle, failure_reason, failed_count. A task needs attention if it
    failed, can be recovered, has a reason of failure, or items that failed.
    """
    troubled = F.coalesce(F.col("lifecycle").isin("failed", "recoverable"), F.lit(False)) | (F.coalesce("failure_reason", F.lit("")) != "") | (F.coalesce("failed_count", F.lit(0)) > 0)
    t = tasks.groupBy("vault_id").agg(F.bool_or(troubled).alias("troubled"), F.bool_or(F.col("lifecycle") == "running").alias("runs"))
    h = health.select("vault_id", ((F.col("failed") + F.col("stale") + F.col("pending")) > 0).alias("faulty"))
    rows = vaults.join(h, "vault_id", "left").join(t, "vault_id", "left")
    state = (
        F.when(~F.col("authorization_status").eqNullSafe("active"), "inactive")
        .when(~F.col("access_status").eqNullSafe("available"), "unavailable")
        .when(F.coalesce("faulty", F.lit(True)) | F.coalesce("troubled", F.lit(False)), "attention")
        .when(F.coalesce("runs", F.lit(False)), "running")
        .otherwise("healthy")
    )
    return rows.select("vault_id", state.alias("state"))


def embedding_preview(documents: DataFrame, blocks: DataFrame, policy: DataFrame) -> DataFrame:
    """Files and blocks that a batch would embed, blocked files, and a task id that depends on the choice alone."""
    d = documents.where(eligible()).join(policy.select("document_id", "allowed"), "document_id", "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))
    per = d.join(blocks.groupBy("document_id").agg(F.count("*").alias("n")), "document_id")
    chosen = F.sha2(F.to_json(F.sort_array(F.collect_list(F.when(F.col("allowed"), F.col("document_id"))))), 256)
    return per.groupBy("vault_id").agg(F.count_if("allowed").alias("files"), F.sum(F.when(F.col("allowed"), F.col("n")).otherwise(0)).alias("blocks"), F.count_if(~F.col("allowed")).alias("blocked_files"), chosen.alias("task_id"))


def one_dimension(cache: DataFrame) -> DataFrame:
    """Profiles whose cached vectors have more than one length; must be empty."""
    return cache.groupBy("profile_fp").agg(F.count_distinct("dimension").alias("dimensions")).where("dimensions > 1")


def latest_event(events: DataFrame) -> DataFrame:
    return events.agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("event_id"))
