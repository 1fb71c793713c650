"""Eligibility, scope and policy filters over the document index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import paths

#: Which stages a rule of each kind blocks (fixed values).
BLOCKED_STAGES = {"completely-ignore": ["import", "index", "retrieval", "outbound"], "do-not-index": ["index", "retrieval"], "never-send-cloud": ["outbound"]}
IDENTITY = ["document_id", "relative_path", "content_sha256", "document_kind", "source_id", "source_sha256"]


def eligible() -> Column:
    """A current, verifiable document that is neither stale nor waits for an association."""
    return F.col("is_current") & F.col("verifiable") & F.col("stale_reason").isNull() & ~F.col("pending_association")


def embedding_eligible() -> Column:
    return eligible() & (F.size("blocks") > 0)


def snapshot_eligible() -> Column:
    """Native documents, and derived ones that can be traced to their source."""
    return (F.col("document_kind") == "native") | (F.col("verifiable") & F.col("source_id").isNotNull() & F.col("source_sha256").isNotNull() & F.col("source_path").isNotNull())


def allowed(rows: DataFrame, allowed_paths: DataFrame) -> DataFrame:
    """Rows whose relative_path is on the list; an empty list allows none."""
    return rows.join(allowed_paths.select("relative_path").distinct(), "relative_path", "left_semi")


def exact_blocks(meta: DataFrame, documents: DataFrame, blocks: DataFrame, subject: str, grade: str, unit: int, material: str | None = None) -> DataFrame:
    """Accepted blocks of one subject, grade and unit, in path and block order."""
    chosen = meta.where((F.col("subject") == subject) & (F.col("grade_volume") == grade) & (F.col("unit_no") == unit) & (F.col("meta_status") == "accepted"))
    if material is not None:
        chosen = chosen.where(F.col("material_type") == material)
    out = chosen.join(documents.where(eligible()), "document_id").join(blocks, ["document_id", "sequence"])
    return out.orderBy("relative_path", "sequence")


def in_scope(rows: DataFrame, scope: str | None, column: str = "relative_path") -> DataFrame:
    """Rows at or below a directory; no directory means the whole vault."""
    return rows if scope is None else rows.where(paths.under(F.col(column), F.lit(scope)))


def embedding_scope(rows: DataFrame, scope: str) -> DataFrame:
    """As in_scope without regard to case, over the note's or its source's path."""
    want = F.lower(F.lit(scope))
    return rows.where(paths.under(F.lower("relative_path"), want) | F.coalesce(paths.under(F.lower("source_path"), want), F.lit(False)))


def evaluate_policy(items: DataFrame, rules: DataFrame, stage: str, id_col: str = "item_id") -> DataFrame:
    """allowed, rule ids and kinds for each item (source_path, derived_path) at one stage.

    A rule matches a path at or below its own. Each path is exploded into its
    ancestors, so the match is an equi-join and no theta join.
    """
    each = items.select(id_col, F.explode(F.array_distinct(F.array_compact(F.array(paths.normal_path(F.col("source_path")), paths.normal_path(F.col("derived_path")))))).alias("path"))
    steps = F.split("path", "/")
    above = each.select(id_col, F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))).alias("rule_path")).distinct()
    hits = above.join(rules.select("rule_id", "kind", F.col("relative_path").alias("rule_path")), "rule_path")
    blocks = F.col("kind").isin([k for k, stages in BLOCKED_STAGES.items() if stage in stages])
    found = hits.groupBy(id_col).agg(F.array_sort(F.collect_set("rule_id")).alias("rule_ids"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.bool_or(blocks).alias("blocked"))
    none = F.array().cast("array<string>")
    reason = (
        F.when(~F.coalesce("blocked", F.lit(False)), "no rule blocks this stage")
        .when(F.array_contains("kinds", "completely-ignore"), "ignored at every stage")
        .when(F.lit(stage).isin("index", "retrieval"), "not to be indexed or retrieved")
        .otherwise("not to leave this machine")
    )
    out = items.join(found, id_col, "left")
    return out.select(*[items[c] for c in items.columns], (~F.coalesce("blocked", F.lit(False))).alias("allowed"), F.coalesce("rule_ids", none).alias("rule_ids"), F.coalesce("kinds", none).alias("kinds"), reason.alias("reason"))


def in_manifest(documents: DataFrame, manifest: DataFrame, keys: list[str] = IDENTITY) -> DataFrame:
    """Documents whose identity is in a frozen manifest; null matches null."""
    d, m = documents.alias("d"), manifest.select(*keys).distinct().alias("m")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"d.{k}").eqNullSafe(F.col(f"m.{k}"))
    return d.join(m, same, "left_semi")


def under_heading(rows: DataFrame, scope: list[str], column: str = "heading_path") -> DataFrame:
    """Rows whose heading path starts with the scope, case and punctuation aside."""
    from lodestrata.functions.text import normal_heading

    want = F.transform(F.array(*map(F.lit, scope)), normal_heading)
    return rows.where((F.size(column) >= len(scope)) & (F.slice(F.transform(column, normal_heading), 1, len(scope)) == want))


def search(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows one of whose columns holds the text, case aside."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return rows.where(hit)


def rerank_view(rows: DataFrame) -> DataFrame:
    """What a reranker may see: never a path or an identity, and no text that holds an absolute path."""
    shown = ["candidate_id", "heading_path", "block_kind", "text", "allowed_tags", "fused_rank"]
    leaks = paths.holds_absolute_path(F.coalesce("text", F.lit("")))
    for c in ("heading_path", "allowed_tags"):  # each value as it is: escapes of a rendering are no paths
        leaks = leaks | F.coalesce(F.exists(c, lambda x: F.coalesce(paths.holds_absolute_path(x), F.lit(False))), F.lit(False))
    return rows.where(~leaks).select(*shown)
