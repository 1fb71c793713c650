"""Complete coverage of a scope, exact and near duplicates, budgets and batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.operators.joins import sharing_terms
from lodestrata.operators.lineage import cut

#: Kinds in the order in which batches are filled (fixed values).
KINDS = ["grammar", "vocabulary", "phrase", "sentence-pattern", "exercise", "other"]


def coverage(documents: DataFrame, blocks: DataFrame, budget: int | None = None) -> DataFrame:
    """Every block of every document in scope, numbered in path order, with what happens to it.

    Blocks beyond the budget are listed as uncovered and never dropped. Documents say
    whether a policy excludes them (``excluded``).
    """
    from lodestrata.operators.sorting import with_rank

    rows = blocks.join(documents.select("document_id", "relative_path", "excluded"), "document_id")
    rows = with_rank(rows, ["relative_path", "sequence"]).withColumn("ordinal", F.col("rank") + 1).drop("rank")
    fate = F.when(F.col("excluded"), "excluded")
    if budget is not None:
        fate = fate.when(F.col("ordinal") > budget, "uncovered")
    return rows.withColumn("disposition", fate.otherwise("planned")).withColumn("knowledge_kind", X.knowledge_kind(F.col("heading_path")))


def atomic_items(items: DataFrame) -> DataFrame:
    """Planned items merged by content: the first one's kind and heading, all ordinals, the largest estimate."""
    key = F.coalesce("block_content_sha256", F.concat(F.lit("coverage:"), F.col("ordinal").cast("string")))
    cost = F.when(F.col("token_estimate") > 0, F.col("token_estimate")).otherwise(F.greatest(F.length(F.coalesce("excerpt", F.lit(""))), F.lit(1)))
    planned = items.where("disposition = 'planned'").withColumn("key", key).withColumn("cost", cost)
    g = planned.groupBy("key").agg(F.min("ordinal").alias("first_ordinal"), F.min_by("knowledge_kind", "ordinal").alias("knowledge_kind"), F.min_by("heading", "ordinal").alias("heading"), F.sort_array(F.collect_list("ordinal")).alias("source_ordinals"), F.max("cost").alias("token_estimate"))
    return g.withColumn("concept_terms", X.concept_terms(F.coalesce("heading", F.lit("")))).withColumnRenamed("first_ordinal", "ordinal").drop("key", "heading")


def candidate_clusters(items: DataFrame) -> DataFrame:
    """(ordinal, cluster): items of one kind that shared terms connect, by least labels; single items are left out.

    Pairs chain the items of each term, so they grow with the items. Labels travel to
    neighbours until none changes; each round starts from a checkpoint.
    """
    pairs = sharing_terms(items)
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("cluster")).withColumnRenamed("a", "ordinal"))
    while True:
        seen = both.join(labels.withColumnRenamed("ordinal", "b"), "b").groupBy("a").agg(F.min("cluster").alias("near")).withColumnRenamed("a", "ordinal")
        step = labels.join(seen, "ordinal").select("ordinal", "cluster", F.least("cluster", "near").alias("new"))
        jump = labels.select(F.col("ordinal").alias("new"), F.col("cluster").alias("root"))
        new = cut(step.join(jump, "new").select("ordinal", "cluster", F.least("new", "root").alias("new")))
        done = new.where("new <> cluster").isEmpty()
        labels = new.select("ordinal", F.col("new").alias("cluster"))
        if done:
            return labels


def first_of_content(items: DataFrame, per: str) -> DataFrame:
    """The items of each plan without those whose content an earlier one has: per, ordinal, knowledge_kind, token_estimate.

    The first one stands for all, with the largest estimate. Items without a content hash
    are each their own.
    """
    key = F.coalesce("block_content_sha256", F.concat(F.lit("item:"), F.col("ordinal").cast("string")))
    return items.groupBy(per, key.alias("key")).agg(F.min("ordinal").alias("ordinal"), F.min_by("knowledge_kind", "ordinal").alias("knowledge_kind"), F.max("token_estimate").alias("token_estimate")).drop("key")


def map_reduce_batches(items: DataFrame, available: int, most: int, per: str = "plan_id") -> DataFrame:
    """(plan, ordinal, batch): items packed by kind under a token budget; batch 0 means uncovered.

    A batch holds items of one kind, in order, as far as the budget reaches; batches are
    numbered through all kinds, and those after the last allowed one, like items above
    the budget, stay uncovered. Where a batch ends depends on where the one before did,
    so a plan's packing is one group, but only of items that a batch can still reach:
    ``most`` batches hold ``most`` budgets at most, so whatever comes later in the plan's
    running sum is uncovered whatever the cuts are. An estimate counts as one token at
    least, so a group has ``most`` times ``available`` items at most, however large the plan.
    """
    from lodestrata.operators.sorting import with_running

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(batch=0).sort_values(["kind", "ordinal"])
        made = 0
        for _, rows in pdf.groupby("kind"):
            ends, at = rows["cost"].cumsum().to_numpy(), 0
            while at < len(ends) and made < most:
                end = max(at + 1, ends.searchsorted((ends[at - 1] if at else 0) + available, "right"))
                made += 1
                pdf.loc[rows.index[at:end], "batch"] = made
                at = end
        return pdf[[per, "ordinal", "batch"]]

    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("knowledge_kind"))
    rows = items.select(per, "ordinal", place.alias("kind"), F.greatest(F.col("token_estimate"), F.lit(1)).cast("long").alias("cost"))
    rows = with_running(rows.withColumn("fits", (F.col("cost") <= available).cast("long") * F.col("cost")), per, ["kind", "ordinal"], "fits")
    type_ = {c: items.schema[c].dataType.simpleString() for c in (per, "ordinal")}
    near = rows.where((F.col("fits") > 0) & (F.col("before") < most * available)).select(per, "ordinal", "kind", "cost")
    batches = near.groupBy(per).applyInPandas(number, f"{per} {type_[per]}, ordinal {type_['ordinal']}, batch int").where("batch > 0")
    return rows.join(batches, [per, "ordinal"], "left").select(per, "ordinal", F.coalesce("batch", F.lit(0)).alias("batch"))


def execute_coverage(items: DataFrame) -> DataFrame:
    """What became of each item: failed if blank, processed if first of its content, duplicate after that."""
    first = items.where("disposition = 'planned'").groupBy("block_content_sha256").agg(F.min("ordinal").alias("first"))
    out = items.join(first, "block_content_sha256", "left")
    result = F.when(F.col("disposition") != "planned", F.col("disposition")).when(F.trim(F.coalesce("excerpt", F.lit(""))) == "", "failed").when(F.col("ordinal") == F.col("first"), "processed").otherwise("duplicate")
    return out.withColumn("result", result).drop("first")


def coverage_status(results: DataFrame, per: str = "plan_id") -> DataFrame:
    has = lambda v: F.bool_or(F.col("result") == v)
    status = F.when(has("failed"), "failed").when(has("uncovered"), "uncovered").when(has("excluded"), "excluded").when(F.count_if(F.col("result") == "processed") == 0, "empty").otherwise("complete")
    return results.groupBy(per).agg(status.alias("status"), F.count("*").alias("items"))


def section_plan(evidence: DataFrame, sources: int = 128, most: int = 256, title: str = "organize") -> DataFrame:
    """Evidence grouped by the parent folder of its path, or its path where it has none; limits on sources and evidence are the plan's feature."""
    from lodestrata.functions.paths import parent

    w = W.partitionBy("plan_id").orderBy("relative_path", "sequence")
    rows = evidence.withColumn("place", F.row_number().over(w)).withColumn("source_no", F.dense_rank().over(W.partitionBy("plan_id").orderBy("relative_path"))).where((F.col("place") <= most) & (F.col("source_no") <= sources))
    section = F.coalesce(F.nullif(parent(F.col("relative_path")), F.lit("")), F.col("relative_path"))
    return rows.groupBy("plan_id", section.alias("section")).agg(F.count("*").alias("evidence"), F.count_distinct("relative_path").alias("sources"), F.min("place").alias("first")).withColumn("objective", F.concat_ws(": ", F.lit(title), "section"))


def deep_creation_sections(evidence: DataFrame, requests: DataFrame, sources: int = 128, most: int = 256) -> tuple[DataFrame, DataFrame]:
    """(sections, limits): the folders of a request's evidence as sections to write, and whether it exceeded its limits.

    requests: plan_id, content. The objective names the first 200 characters of the
    request. Sections are numbered by folder; they hold the evidence within the limits,
    which are the plan's feature, and ``limits`` says for each plan what there was.
    """
    plan = section_plan(evidence, sources, most).drop("objective", "first")
    objective = F.concat(F.lit("根据请求进行深度创作："), F.substring("content", 1, 200))
    w = W.partitionBy("plan_id").orderBy("section")
    sections = plan.join(requests, "plan_id").select("plan_id", F.row_number().over(w).alias("ordinal"), "section", "evidence", "sources", objective.alias("objective"))
    found = evidence.groupBy("plan_id").agg(F.count("*").alias("evidence"), F.count_distinct("relative_path").alias("sources"))
    limits = requests.select("plan_id").join(found, "plan_id", "left").na.fill(0, ["evidence", "sources"])
    return sections, limits.withColumn("exceeded", (F.col("sources") > sources) | (F.col("evidence") > most))
