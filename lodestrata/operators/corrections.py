"""Corrections of a recognised document: new revisions of its blocks, and recognised text replaced by reviewed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.operators.lineage import cut

ZERO = "\x00"


def stable_id(attempt: Column, producer: Column, anchor: Column) -> Column:
    """The id of a block that an attempt, an object and a place in it always get."""
    return F.sha2(F.concat_ws(ZERO, attempt, producer, anchor), 256)


def block_fingerprint(columns: list[str]) -> Column:
    """A hash of a block's content, by its columns in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def corrected_graphs(graphs: DataFrame, blocks: DataFrame, replacements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graphs, blocks) of the next revision of each graph that has replacements; the old rows stay as they are.

    graphs: graph_id, revision, base_graph_id, attempt_id; blocks: graph_id, block_id,
    reading_order and content columns; replacements: graph_id, block_id and content
    columns. A replacement takes the place of its block under an id that follows from
    the block, the revision and its content, and says which block it supersedes. A
    replacement for a block that its graph does not hold, or two for one block, is an error.
    """
    content = [c for c in blocks.columns if c not in ("graph_id", "block_id", "reading_order", "supersedes_block_id")]
    given = replacements.select("graph_id", "block_id", *[F.col(c).alias(f"new_{c}") for c in content], block_fingerprint(content).alias("print"))
    given = given.withColumn("copies", F.count("*").over(W.partitionBy("graph_id", "block_id")))
    unknown = given.join(blocks, ["graph_id", "block_id"], "left_anti").select("graph_id").distinct().withColumn("unknown", F.lit(True))
    prints = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_id", "print"))), lambda s: F.concat(F.lit('"'), s["block_id"], F.lit('":"'), s["print"], F.lit('"'))), ",")
    said = given.groupBy("graph_id").agg(prints.alias("prints"), F.max("copies").alias("copies"))
    g = graphs.join(said, "graph_id").join(unknown, "graph_id", "left")
    bad = F.when(F.coalesce("unknown", F.lit(False)), F.raise_error(F.lit("a correction targets a block that its graph does not hold"))).when(F.col("copies") > 1, F.raise_error(F.lit("two corrections target one block")))
    new = F.col("revision") + 1
    text = F.concat(F.lit('{"base_graph_id":"'), F.col("graph_id"), F.lit('","graph_revision":'), new.cast("string"), F.lit(',"replacements":{'), F.col("prints"), F.lit("}}"))
    g = g.select(F.coalesce(bad, F.sha2(text, 256)).alias("new_graph_id"), "graph_id", new.cast(graphs.schema["revision"].dataType).alias("revision"), F.coalesce("base_graph_id", "graph_id").alias("base_graph_id"), "attempt_id")
    rows = blocks.join(g.select("graph_id", "new_graph_id", "revision", "attempt_id"), "graph_id").join(given.drop("copies"), ["graph_id", "block_id"], "left")
    replaced = F.col("print").isNotNull()
    anchor = F.concat_ws(":", "block_id", F.col("revision").cast("string"), "print")
    block = F.when(replaced, stable_id(F.col("attempt_id"), F.lit("review-correction"), anchor)).otherwise(F.col("block_id"))
    old = F.col("supersedes_block_id") if "supersedes_block_id" in blocks.columns else F.lit(None).cast("string")
    out = rows.select(F.col("new_graph_id").alias("graph_id"), block.alias("block_id"), "reading_order", *[F.when(replaced, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in content], F.when(replaced, F.col("block_id")).otherwise(old).alias("supersedes_block_id"))
    return g.select(F.col("new_graph_id").alias("graph_id"), "revision", "base_graph_id", "attempt_id"), out


def newest_blocks(links: DataFrame) -> DataFrame:
    """block_id, newest, steps: for every block named in ``links`` (block_id, supersedes_block_id) the block that finally replaces it.

    Pointers double in length each round, so a chain of n corrections takes log n rounds.
    Rows that repeat a link count once. Two blocks that supersede the same one, and a
    chain that closes in a circle, are errors.
    """
    said = links.where("supersedes_block_id IS NOT NULL AND block_id IS NOT NULL").select(F.col("supersedes_block_id").alias("block_id"), F.col("block_id").alias("newest")).distinct()
    one = said.groupBy("block_id").agg(F.min("newest").alias("newest"), F.count("*").alias("n"))
    to = cut(one.select("block_id", F.when(F.col("n") > 1, F.raise_error(F.lit("two blocks supersede one"))).otherwise(F.col("newest")).alias("newest"), F.lit(1).cast("long").alias("steps")))
    total = to.count()
    reached = 1
    while True:
        onward = to.select(F.col("block_id").alias("newest"), F.col("newest").alias("further"), F.col("steps").alias("more"))
        rows = to.join(onward, "newest", "left")
        new = cut(rows.select("block_id", F.coalesce("further", "newest").alias("newest"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("further").isNotNull().alias("moved")))
        if new.where("moved").isEmpty():
            break
        reached *= 2
        if reached > 2 * total:  # no chain has more links than there are
            raise ValueError("corrections supersede each other in a circle")
        to = new.drop("moved")
    heads = to.select(F.col("newest").alias("block_id")).distinct().select("block_id", F.col("block_id").alias("newest"), F.lit(0).cast("long").alias("steps"))
    return to.unionByName(heads)


def with_recognised_corrections(units: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """key, ordinal (from 1), kind, text, locator, page, corrected: units with reviewed text in place of the recognised one.

    units: key, ordinal, kind, text, locator, page; corrections: key, place (their order),
    locator, page, text; the last correction of a locator counts. A correction whose
    locator no unit has becomes a paragraph before the first unit of a later page, or at
    the end. Corrections that go to one place stand by page, then by order; one without
    a page goes to the end, behind those that came before it.
    """
    by = W.partitionBy(key, "locator").orderBy(F.desc("place"))
    given = corrections.withColumn("__r", F.row_number().over(by)).select(key, "locator", F.col("page").alias("c_page"), F.col("text").alias("c_text"), F.first("place").over(W.partitionBy(key, "locator").orderBy("place")).alias("place"), "__r").where("__r = 1").drop("__r")
    none = F.lit(None)
    rows = units.join(given.select(key, "locator", "c_text"), [key, "locator"], "left")
    kept = rows.select(key, F.col("ordinal").cast("long").alias("at"), F.lit(1).alias("own"), F.lit(0).alias("by_page"), F.lit(0).cast("long").alias("place"), "kind", F.coalesce("c_text", "text").alias("text"), "locator", "page", F.col("c_text").isNotNull().alias("corrected"))
    left = given.join(units.select(key, "locator").distinct(), [key, "locator"], "left_anti")
    # the first unit of a later page: the least ordinal among units whose page is greater
    firsts = units.where("page IS NOT NULL").groupBy(key, F.col("page").alias("u_page")).agg(F.min("ordinal").alias("at"))
    back = W.partitionBy(key).orderBy(F.desc("u_page")).rowsBetween(W.unboundedPreceding, 0)
    firsts = firsts.select(key, F.col("u_page").alias("page"), F.min("at").over(back).alias("at"))
    pages = left.select(key, F.col("c_page").alias("page")).where("page IS NOT NULL").distinct().withColumn("asked", F.lit(True))
    events = firsts.withColumn("asked", F.lit(False)).unionByName(pages.withColumn("at", none.cast(firsts.schema["at"].dataType)).select(key, "page", "at", "asked"))
    ahead = W.partitionBy(key).orderBy(F.desc("page")).rangeBetween(W.unboundedPreceding, -1)  # pages strictly greater
    found = events.withColumn("to", F.min("at").over(ahead)).where("asked").select(key, F.col("page").alias("c_page"), "to")
    placed = left.join(found, [key, "c_page"], "left").withColumn("at", F.coalesce(F.col("to").cast("long"), F.lit(2**62)))
    so_far = W.partitionBy(key, "at").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("by_page", F.coalesce("c_page", F.max("c_page").over(so_far), F.lit(-1)).cast("int"))
    new = placed.select(key, "at", F.lit(0).alias("own"), "by_page", F.col("place").cast("long").alias("place"), F.lit("paragraph").alias("kind"), F.col("c_text").alias("text"), "locator", F.col("c_page").alias("page"), F.lit(True).alias("corrected"))
    both = kept.unionByName(new)
    order = W.partitionBy(key).orderBy("at", "own", "by_page", "place")
    return both.select(key, F.row_number().over(order).alias("ordinal"), "kind", "text", "locator", "page", "corrected")
