"""Page layout of recognised documents: furniture, headings, titles, captions, fragments.

Blocks are rows (graph_id, reading_order, block_id, kind, text, page, x1, y1, x2, y2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions import text as X

# Patterns of captions, headings and sentence ends.
CAPTION = r"(?i)^(?:图|表|Figure|Fig\.?|Table)\s*[-.：:]?\s*[0-9一二三四五六七八九十]+"
MARKDOWN_HEADING = r"^\s*(#{1,6})\s+(\S.*)$"
NUMBERED_HEADING = r"^\s*(\d+(?:[.．]\d+){1,5})(?:[.．、):：]\s*|\s+|(?=[A-Za-z㐀-鿿]))(.+?)\s*$"
CHAPTER_HEADING = r"^\s*第\s*\d+\s*([编篇章部卷节条款])\s*(.+?)\s*$"
SENTENCE_END = r"[.!?。！？；;:]$"
LIST_ITEM = r"^[ \t]*(?:[-+*]|[0-9]+[.)])[ \t]+.+?\s*$"
PAGE_NUMBER = r"^(?:[-–—]\s*)?\d{1,5}(?:\s*[-–—/]\s*\d{0,5})?$|^(?:page|p\.)\s*\d{1,5}$|^第\s*\d{1,5}\s*页$"
# End of fixed values.

ORDER = "reading_order"


def page_bounds(blocks: DataFrame) -> DataFrame:
    """Right and lower end of each page's blocks, 1 at least."""
    one = F.lit(1.0)
    return blocks.where("page IS NOT NULL").groupBy("graph_id", "page").agg(F.greatest(F.max("x2"), one).alias("page_width"), F.greatest(F.max("y2"), one).alias("page_height"))


def at_margin(margin: float = 0.1) -> Column:
    return (F.col("y2") <= F.col("page_height") * margin) | (F.col("y1") >= F.col("page_height") * (1 - margin))


def furniture(blocks: DataFrame, margin: float = 0.1, most: int = 100) -> DataFrame:
    """Short margin paragraphs whose text stands on two pages or more: running heads and feet."""
    # the page's height comes by one sort of narrow rows, in place of a table of pages and a join
    height = F.greatest(F.max("y2").over(W.partitionBy("graph_id", "page")), F.lit(1.0))
    short = (F.col("kind") == "paragraph") & (F.length("text") <= most)
    rows = blocks.where("graph_id IS NOT NULL AND page IS NOT NULL").select("graph_id", "page", "block_id", "y1", "y2", short.alias("short"), F.when(short, X.compare_key(F.col("text"))).alias("key"))
    near = rows.withColumn("page_height", height).where("short").where(at_margin(margin)).select("graph_id", "page", "block_id", "key")
    often = near.groupBy("graph_id", "key").agg(F.min("page").alias("first"), F.max("page").alias("last")).where("first <> last")
    return near.join(often, ["graph_id", "key"], "left_semi").select("graph_id", "block_id")


def page_numbers(blocks: DataFrame, margin: float = 0.1) -> DataFrame:
    """Margin paragraphs that are nothing but a page number."""
    near = blocks.where(F.col("kind") == "paragraph").join(page_bounds(blocks), ["graph_id", "page"]).where(at_margin(margin))
    return near.where(F.trim("text").rlike(PAGE_NUMBER)).select("graph_id", "block_id")


def mark_noise(blocks: DataFrame) -> DataFrame:
    noise = furniture(blocks).unionByName(page_numbers(blocks)).distinct().withColumn("noise", F.lit(True))
    return blocks.join(noise, ["graph_id", "block_id"], "left").withColumn("noise", F.coalesce("noise", F.lit(False)))


def inferred_heading(text: Column) -> Column:
    """Struct of level and title where a text is written as a heading, else null."""
    sound = lambda t: (t != "") & (F.length(t) <= 180) & ~t.rlike(SENTENCE_END)
    marks, title = F.regexp_extract(text, MARKDOWN_HEADING, 1), F.trim(F.regexp_extract(text, MARKDOWN_HEADING, 2))
    unit, chapter = F.regexp_extract(text, CHAPTER_HEADING, 1), F.trim(F.regexp_extract(text, CHAPTER_HEADING, 2))
    number, rest = F.regexp_extract(text, NUMBERED_HEADING, 1), F.trim(F.regexp_extract(text, NUMBERED_HEADING, 2))
    made = lambda level, t: F.struct(level.cast("int").alias("level"), t.alias("title"))
    depth = F.when(unit == "节", 2).when(unit == "条", 3).when(unit == "款", 4).otherwise(1)
    return (
        F.when(marks != "", F.when(sound(title), made(F.length(marks), title)))
        .when(unit != "", F.when(sound(chapter), made(depth, F.trim(text))))
        .when(number != "", F.when(sound(rest), made(F.length(F.regexp_replace(number, "[^.．]", "")) + 1, F.trim(text))))
    )


def infer_headings(blocks: DataFrame) -> DataFrame:
    h = F.when(F.col("kind") == "paragraph", inferred_heading(F.col("text")))
    return blocks.withColumn("h", h).withColumn("kind", F.when(F.col("h").isNotNull(), "heading").otherwise(F.col("kind"))).withColumn("level", F.col("h.level")).withColumn("text", F.coalesce("h.title", "text")).drop("h")


def promote_title(blocks: DataFrame) -> DataFrame:
    """The first heading or paragraph becomes the title if it is a short paragraph at the top of page 1."""
    rows = blocks.join(page_bounds(blocks), ["graph_id", "page"], "left")
    lead = F.col("kind").isin("heading", "paragraph") & ~F.coalesce("noise", F.lit(False))
    first = F.min(F.when(lead, F.col(ORDER))).over(W.partitionBy("graph_id"))
    fits = (F.col(ORDER) == first) & (F.col("kind") == "paragraph") & (F.col("page") == 1) & (F.length("text") <= 100) & ~F.contains("text", F.lit("\n")) & ~F.col("text").rlike(SENTENCE_END) & ~F.col("text").rlike(LIST_ITEM) & (F.col("y1") <= F.col("page_height") * 0.15)
    return rows.withColumn("title", F.coalesce(fits, F.lit(False))).withColumn("level", F.when(F.col("title"), 1).otherwise(F.col("level"))).withColumn("kind", F.when(F.col("title"), "heading").otherwise(F.col("kind"))).drop("title", "page_width", "page_height")


def mark_captions(blocks: DataFrame) -> DataFrame:
    """Paragraphs written as captions with exactly one image of the same page beside them."""
    w = W.partitionBy("graph_id").orderBy(ORDER)
    image = lambda step: F.coalesce((F.lag("kind", step).over(w) == "image") & (F.lag("page", step).over(w) == F.col("page")), F.lit(False)).cast("int")
    caption = (F.col("kind") == "paragraph") & F.col("text").rlike(CAPTION) & (image(1) + image(-1) == 1)
    return blocks.withColumn("kind", F.when(caption, "caption").otherwise(F.col("kind")))


def merge_fragments(blocks: DataFrame) -> DataFrame:
    """Joins a paragraph to the one before where that breaks off in mid-sentence right above it.

    The test looks at neighbours only, so runs of fragments are sums over a window.
    """
    w = W.partitionBy("graph_id").orderBy(ORDER)
    was = lambda c: F.lag(c).over(w)
    overlap = F.least("x2", was("x2")) - F.greatest("x1", was("x1"))
    narrow = F.least(F.col("x2") - F.col("x1"), was("x2") - was("x1"))
    height = F.least(F.col("y2") - F.col("y1"), was("y2") - was("y1"))
    gap = F.col("y1") - was("y2")
    noisy = F.coalesce("noise", F.lit(False)) if "noise" in blocks.columns else F.lit(False)
    goes_on = ~noisy & (F.col("kind") == "paragraph") & (was("kind") == "paragraph") & (F.col("page") == was("page")) & ~was("text").rlike(SENTENCE_END) & (overlap >= 0.8 * narrow) & (gap >= 0) & (gap <= 1.5 * height)
    runs = blocks.withColumn("run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w))
    texts = F.transform(F.sort_array(F.collect_list(F.struct(ORDER, "text"))), lambda s: s["text"])
    boxes = {"x1": F.min("x1"), "y1": F.min("y1"), "x2": F.max("x2"), "y2": F.max("y2"), "text": F.when(F.count("*") > 1, X.join_wrapped(texts)).otherwise(F.min("text")), ORDER: F.min(ORDER)}
    rest = [c for c in blocks.columns if c != "graph_id"]
    return runs.groupBy("graph_id", "run").agg(*[(boxes[c] if c in boxes else F.min_by(c, ORDER)).alias(c) for c in rest], F.count("*").alias("parts")).drop("run")


def normalize(blocks: DataFrame) -> DataFrame:
    """Headings, then noise, then the title, then captions, then fragments: the order matters."""
    return merge_fragments(mark_captions(promote_title(mark_noise(infer_headings(blocks)))))


def heading_context(blocks: DataFrame) -> DataFrame:
    """Each block with the open headings above it.

    Headings are numbered; their stack is a fold over a graph's headings alone, and a
    block takes the stack of the last heading by its number.
    """
    w = W.partitionBy("graph_id").orderBy(ORDER)
    rows = blocks.withColumn("__head", F.sum((F.col("kind") == "heading").cast("int")).over(w))
    heads = rows.where("kind = 'heading'").groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("__head", F.coalesce("level", F.lit(1)).alias("level"), "text"))).alias("heads"))

    def push(acc: Column, h: Column) -> Column:
        stack = F.concat(F.slice(acc["stack"], F.lit(1), h["level"] - 1), F.array(h["text"]))
        return F.struct(stack.alias("stack"), F.concat(acc["all"], F.array(F.struct(h["__head"].alias("__head"), stack.alias("heading_path")))).alias("all"))

    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<__head:bigint,heading_path:array<string>>>").alias("all"))
    paths = heads.select("graph_id", F.inline(F.aggregate("heads", start, push, lambda a: a["all"])))
    out = rows.join(paths, ["graph_id", "__head"], "left")
    return out.withColumn("heading_path", F.coalesce("heading_path", F.array().cast("array<string>"))).select(*blocks.columns, "heading_path")
