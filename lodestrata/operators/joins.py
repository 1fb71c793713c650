"""Joins of the index tables. All are equi-joins; Catalyst picks the strategy from sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_blocks(meta: DataFrame, documents: DataFrame, blocks: DataFrame) -> DataFrame:
    return meta.join(documents, "document_id").join(blocks, ["document_id", "sequence"])


def vectors_of(vectors: DataFrame, documents: DataFrame, blocks: DataFrame, profile: str, dimension: int) -> DataFrame:
    """Vectors of one profile and dimension with their current blocks."""
    chosen = vectors.where((F.col("profile_fp") == profile) & (F.col("dimension") == dimension))
    return chosen.join(documents, "document_id").join(blocks.drop("block_content_sha256"), ["document_id", "sequence"])


def projection_blocks(projections: DataFrame, blocks: DataFrame) -> DataFrame:
    return projections.join(blocks, ["vault_id", "graph_id", "revision"])


def blocks_by_location(blocks: DataFrame, projection: DataFrame) -> DataFrame:
    """Each block with the projection row of its location, and whether that is missing or ambiguous."""
    key = F.regexp_extract("location", r"^(.*?)(?:#chunk:.*)?$", 1)
    per = projection.groupBy(F.col("location").alias("key")).agg(F.count("*").alias("found"), F.min("graph_block_id").alias("graph_block"))
    out = blocks.withColumn("key", key).join(per, "key", "left")
    issue = F.when(F.coalesce("found", F.lit(0)) == 0, "graph-block-missing").when(F.col("found") > 1, "graph-block-ambiguous")
    return out.select(*blocks.columns, F.when(F.col("found") == 1, F.col("graph_block")).alias("matched_block"), issue.alias("issue"))


def latest(rows: DataFrame, keys: list[str], revision: str) -> DataFrame:
    """The row of the highest revision per key, found by one aggregation and no self-join."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(revision)).alias("r"))
    return top.select(*keys, "r.*").select(*rows.columns)


def without(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that have no partner: orphans of a cache, of a source, of a journal."""
    return rows.join(other.select(*keys).distinct(), keys, "left_anti")


def unfinished(journal: DataFrame, keys: list[str] = ["task_id", "unit_id", "digest"]) -> DataFrame:  # noqa: B006
    """Prepared entries without a committed or failed one."""
    return without(journal.where(F.col("status") == "prepared"), journal.where(F.col("status").isin("committed", "failed")), keys)


def first_reference(sources: DataFrame, references: DataFrame) -> DataFrame:
    """Each source with the earliest task that refers to it."""
    first = references.groupBy("source_id").agg(F.min(F.struct("created_at", "task_id")).alias("f")).select("source_id", F.col("f.task_id").alias("first_task_id"))
    return sources.join(first, "source_id", "left")


def with_count(rows: DataFrame, parts: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with the number of their parts, 0 where there are none."""
    return rows.join(parts.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def neighbours(hits: DataFrame, blocks: DataFrame) -> DataFrame:
    """The blocks before and after each hit, with the hit's rank and the offset."""
    asked = hits.select("document_id", F.col("rank").alias("hit_rank"), F.col("score").alias("hit_score"), F.explode(F.array(F.struct(F.lit(0).alias("o"), (F.col("sequence") - 1).alias("s")), F.struct(F.lit(1).alias("o"), (F.col("sequence") + 1).alias("s")))).alias("n"))
    return asked.select("document_id", "hit_rank", "hit_score", F.col("n.o").alias("offset"), F.col("n.s").alias("sequence")).join(blocks, ["document_id", "sequence"])


def along_path(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Files with what the index knows about them, by path without regard to case."""
    known = documents.select(F.lower("source_path").alias("key"), "document_id", "indexed_at").groupBy("key").agg(F.count("*").alias("notes"), F.max("indexed_at").alias("indexed_at"))
    return files.withColumn("key", F.lower("relative_path")).join(known, "key", "left").drop("key").withColumn("notes", F.coalesce("notes", F.lit(0)))


def sharing_terms(items: DataFrame) -> DataFrame:
    """Pairs of items (ordinal, knowledge_kind, concept_terms) of one kind with a term in common.

    Each item is linked to the least item of each of its terms instead of to all: the
    pairs link the same components, and grow with the items of a term, not with their
    square. The least item is a partial aggregate, so a frequent term meets in no task.
    """
    each = items.select("ordinal", "knowledge_kind", F.explode("concept_terms").alias("term"))
    least = each.groupBy("knowledge_kind", "term").agg(F.min("ordinal").alias("a"))
    return each.join(least, ["knowledge_kind", "term"]).where("a <> ordinal").select("a", F.col("ordinal").alias("b")).distinct()


def same_position(blocks: DataFrame, tolerance: float = 0.05, keys: list[str] = ["graph_id"]) -> DataFrame:  # noqa: B006
    """Margin texts with the number of other pages that hold the same text at the same place of the page.

    Rows: keys, block_id, page, text, x1, y1, x2, y2 and the page's width and height. Boxes
    are compared as shares of the page. Each is put into a cell of the tolerance's size and
    into its neighbours, so the join is on equal text and cell, with the exact distances after.
    Blocks of one page with one text and box are one place: places meet, not blocks.
    """
    from lodestrata.functions.text import compare_key

    rel = {"rx": F.col("x1") / F.col("page_width"), "ry": F.col("y1") / F.col("page_height"), "sx": F.col("x2") / F.col("page_width"), "sy": F.col("y2") / F.col("page_height")}
    place = [*keys, "key", "page", *rel]
    blocks = blocks.select(*keys, "block_id", "page", compare_key(F.col("text")).alias("key"), *[v.alias(k) for k, v in rel.items()])
    rows = blocks.select(*place).distinct()
    cell = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    mine = rows.withColumns({"cx": cell("rx"), "cy": cell("ry")})
    around = lambda c: F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.col(c) + d)).alias(c)
    theirs = mine.select(*keys, "key", F.col("page").alias("page2"), *[F.col(c).alias(f"{c}2") for c in rel], around("cx"), "cy")
    theirs = theirs.select(*[c for c in theirs.columns if c != "cy"], around("cy"))
    near = F.lit(True)
    for c in rel:
        near = near & (F.abs(F.col(c) - F.col(f"{c}2")) <= tolerance)
    met = mine.join(theirs, [*keys, "key", "cx", "cy"]).where((F.col("page") != F.col("page2")) & near).select(*place, "page2").distinct()
    # a block stands at one place; an id that stands at several has the pages of all
    spots = blocks.groupBy(*keys, "block_id").agg(F.collect_set(F.struct(*place[len(keys) :])).alias("at"))
    each = spots.select(*keys, "block_id", F.size("at").alias("spots"), F.explode("at").alias("at")).select(*keys, "block_id", "spots", "at.*")
    one = each.where("spots = 1").join(met.groupBy(*place).agg(F.count("*").alias("pages")), place).select(*keys, "block_id", "pages")
    several = each.where("spots > 1").join(met, place).groupBy(*keys, "block_id").agg(F.count_distinct("page2").alias("pages"))
    return one.unionByName(several)


def diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value is new, gone or different."""
    both = before.select(key, F.col(value).alias("old")).join(after.select(key, F.col(value).alias("new")), key, "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("change", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed"))
