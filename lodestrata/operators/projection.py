"""From recognised page blocks to the projection that the index reads: runs of blocks under one heading, cut by size.

Blocks are rows (graph_id, reading_order, block_id, kind, text, page, level) without noise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.operators.layout import ORDER, heading_context

#: Kinds that stand alone, whatever their size.
ALONE = ["table", "image", "code", "formula"]


def projected(blocks: DataFrame) -> DataFrame:
    """graph_id, sequence, reading_order, graph_block_id, kind, text, heading_path, location, context_before, context_after.

    Headings shape the path of what follows and are rows themselves; noise is left out.
    The location names the nearest heading, or the page where there is none.
    """
    rows = heading_context(blocks.where("kind <> 'noise' AND NOT coalesce(noise, false)") if "noise" in blocks.columns else blocks.where("kind <> 'noise'"))
    w = W.partitionBy("graph_id").orderBy(ORDER)
    head = F.element_at("heading_path", -1)
    location = F.when(F.size("heading_path") > 0, F.concat(F.lit("heading:"), head)).otherwise(F.concat(F.lit("page:"), F.coalesce(F.col("page"), F.lit(1)).cast("string")))
    return rows.select(
        "graph_id", F.row_number().over(w).alias("sequence"), F.col(ORDER), F.col("block_id").alias("graph_block_id"), "kind", "text", "page", "heading_path", location.alias("location"),
        F.lag("block_id").over(w).alias("context_before"), F.lead("block_id").over(w).alias("context_after"),
    )


def projection_chunks(blocks: DataFrame, most: int = 800) -> DataFrame:
    """graph_id, chunk, kind, heading_path, text, first and last sequence, location: neighbours of one heading and kind, packed by size.

    A chunk holds what fits below ``most`` characters counted from its run's start, so cuts
    are running sums; kinds that stand alone, and texts above the size, are chunks of their own.
    """
    rows = projected(blocks).where("kind <> 'heading'")
    w = W.partitionBy("graph_id").orderBy("sequence")
    alone = F.col("kind").isin(ALONE) | (F.length("text") > most)
    new = alone | F.coalesce(F.lag(alone).over(w), F.lit(True)) | (F.lag("kind").over(w) != F.col("kind")) | (F.lag("heading_path").over(w) != F.col("heading_path"))
    rows = rows.withColumn("run", F.sum(new.cast("int")).over(w))
    inside = W.partitionBy("graph_id", "run").orderBy("sequence")
    size = F.sum(F.length("text") + 2).over(inside.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("part", F.floor((size - 1) / (most + 2)).cast("int"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("sequence", "text"))), lambda s: s["text"])
    out = rows.groupBy("graph_id", "run", "part").agg(F.min_by("kind", "sequence").alias("kind"), F.min_by("heading_path", "sequence").alias("heading_path"), F.array_join(texts, "\n\n").alias("text"), F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.min_by("location", "sequence").alias("location"))
    return out.select("graph_id", F.row_number().over(W.partitionBy("graph_id").orderBy("first")).alias("chunk"), "kind", "heading_path", "text", "first", "last", "location", X.context_prefix(F.col("heading_path")).alias("contextual_prefix"))


def fused_answers(lines: DataFrame, keys: list[str], order: str = "place") -> DataFrame:
    """Numbered questions with the answers that follow them as one unit, up to the next question.

    Question lines start with a number or a question mark's label; answer lines with a label of an answer.
    """
    w = W.partitionBy(*keys).orderBy(order)
    asks = F.col("text").rlike(QUESTION)
    rows = lines.withColumn("is_question", asks).withColumn("is_answer", F.col("text").rlike(ANSWER)).withColumn("unit", F.sum(asks.cast("int")).over(w))
    open_ = F.max(F.col("is_answer").cast("int")).over(W.partitionBy(*keys, "unit"))
    rows = rows.withColumn("fused", (F.col("unit") > 0) & (open_ == 1)).withColumn("group", F.when(F.col("fused"), F.concat(F.lit("q"), F.col("unit").cast("string"))).otherwise(F.concat(F.lit("l"), F.col(order).cast("string"))))
    texts = F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda s: s["text"])
    return rows.groupBy(*keys, "group").agg(F.min(order).alias(order), F.array_join(texts, "\n").alias("text"), F.count("*").alias("lines"), F.bool_or("fused").alias("fused")).drop("group")


# How questions and answers begin.
QUESTION = r"^\s*(?:(?:Q|问|问题)\s*\d*\s*[:：.．、]|\d+\s*[.．、)）]\s*\S.*[?？]\s*$)"
ANSWER = r"^\s*(?:A|答|答案|Answer)\s*\d*\s*[:：.．、]"
# End of fixed values.


def line_kind(text) -> F.Column:
    """What a converted line is: a heading, list item, table row, image, caption, blank or paragraph."""
    from lodestrata.operators.layout import CAPTION, inferred_heading

    t = F.trim(text)
    return (
        F.when(t == "", "blank")
        .when(t.rlike(r"^!\[[^\]]*\]\([^)]*\)$|^!\[\[[^\]]+\]\]$"), "image")
        .when(t.rlike(r"^\|.*\|$"), "table")
        .when(t.rlike(CAPTION), "caption")
        .when(inferred_heading(t).isNotNull(), "heading")
        .when(t.rlike(r"^(?:[-*+•]|\d+[.)])\s+\S"), "list")
        .otherwise("paragraph")
    )


# How the lines of a page begin that are headings, questions, answers and list items.
PAGE_HEADING = r"(?i)^(?:chapter|unit|section|lesson)\b"
PAGE_QUESTION = r"(?i)^(?:q(?:uestion)?[.:]|[0-9]+[.)])\s*"
PAGE_ANSWER = r"(?i)^(?:a(?:nswer)?[.:])\s*"
PAGE_ITEM = r"^(?:[-*+]|[0-9]+[.)])\s+"
# End of fixed values.


def page_units(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, order, kind, text: the lines of pages as units; a question and the answer right behind it are one.

    Blank lines are left out first. A page's first line may be a heading: by its first
    word, or if it is short and all in capitals. Where questions and answers could be
    paired in more than one way, the earlier line pairs first.
    """
    rows = lines.select(*keys, order, F.trim(F.regexp_replace("text", "^\\s+|\\s+$", "")).alias("text")).where("text <> ''")
    w = W.partitionBy(*keys).orderBy(order)
    asks = F.col("text").rlike(PAGE_QUESTION) | F.col("text").endswith("?")
    rows = rows.withColumn("pairs", F.coalesce(asks & F.lead("text").over(w).rlike(PAGE_ANSWER), F.lit(False))).withColumn("n", F.row_number().over(w))
    # in a stretch of lines that could all pair with the next, every other one does
    rows = rows.withColumn("since", F.col("n") - F.coalesce(F.max(F.when(~F.col("pairs"), F.col("n"))).over(w), F.lit(0)))
    rows = rows.withColumn("starts", F.col("pairs") & (F.col("since") % 2 == 1))
    rows = rows.withColumn("eaten", F.coalesce(F.lag("starts").over(w), F.lit(False))).withColumn("after", F.lead("text").over(w))
    head = (F.col("n") == 1) & (F.col("text").rlike(PAGE_HEADING) | ((F.length("text") <= 90) & (F.upper("text") == F.col("text")) & (F.lower("text") != F.col("text"))))
    kind = F.when(F.col("starts"), "question-answer").when(head, "heading").when(F.col("text").rlike(PAGE_ITEM), "list-item").when(F.contains("text", F.lit("\t")) | F.contains("text", F.lit(" | ")), "table-row").otherwise("paragraph")
    return rows.where("NOT eaten").select(*keys, order, kind.alias("kind"), F.when(F.col("starts"), F.concat_ws("\n", "text", "after")).otherwise(F.col("text")).alias("text"))


def private_candidates(blocks: DataFrame, allowed: DataFrame) -> DataFrame:
    """What the private index may offer to an outbound request: blocks of allowed documents, without path, hashes or identities."""
    rows = blocks.join(allowed.where("outbound_allowed").select("document_id").distinct(), "document_id", "left_semi")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "sequence")
    return rows.withColumn("candidate", F.row_number().over(w)).select("query_id", "candidate", "heading_path", "kind", "text", "score")
