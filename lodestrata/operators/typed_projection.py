"""Chunks of a document graph that follow its typed blocks: paragraphs packed, lists and tables cut between their rows.

Blocks are rows (graph_id, revision, reading_order, block_id, kind, text, selected,
retrievable, confidence, structure). ``structure`` says what the block is made of: its
kind (heading, list, table or atomic) and the heading's level and text, the list's items,
or the table's header and rows; it is null for blocks of old graphs.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import text as X
from lodestrata.operators.chunking import LEAST, LIST_LEAST, LIST_MOST, MOST, TARGET, run_cuts

STRUCTURE = "struct<kind:string,level:int,title:string,items:array<string>,header:array<string>,rows:array<array<string>>>"
# Markers of list items, and where a text may be cut.
MARKER = re.compile(r"(?:[-*+]|\d+[.)])[ \t]+(.+)$")
BOUNDARY = re.compile(r"[\n。！？!?.]|[^\S\r]")
# End of fixed values.


def offset_cuts(text: str) -> list[tuple[int, int]]:
    """Stretches of up to MOST characters that follow each other without a gap, cut behind a sentence end or space.

    The last such place up to TARGET counts, else the last up to MOST, else MOST itself.
    """
    places = [m.end() for m in BOUNDARY.finditer(text)] if len(text) > MOST else []
    cuts = [0]
    while len(text) - cuts[-1] > MOST:
        start = cuts[-1]
        for far in (start + TARGET, start + MOST):
            k = bisect_right(places, far) - 1
            if k >= 0 and places[k] > start:
                cuts.append(places[k])
                break
        else:
            cuts.append(start + MOST)
    return list(zip(cuts, [*cuts[1:], len(text)]))


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().removeprefix("|").removesuffix("|").split("|")]


def _list_pieces(lines: list[str], items: list[str]) -> list[tuple[str, str]] | None:
    """Runs of list lines, or None where the lines are not the items one by one."""
    bare = [m[1].strip() if (m := MARKER.match(x.strip())) else x.strip() for x in lines]
    if not lines or bare != [i.strip() for i in items] or any(not x.strip() or len(x) > MOST for x in lines):
        return None
    return [("".join(lines[i:j]),) * 2 for i, j in run_cuts([*map(len, lines)], 0, MOST, TARGET, items=(LIST_LEAST, LIST_MOST))]


def _table_pieces(lines: list[str], header: list[str], rows: list[list[str]]) -> list[tuple[str, str]] | None:
    """Runs of table lines, each read with the header, or None where the lines are not the rows one by one."""
    typed = [header] * bool(header) + rows
    plain = lambda row: row and not any(re.search(r"[\n\r|]", c) for c in row)
    if not typed or len(lines) != len(typed) or not all(plain(t) and _cells(x) == [c.strip() for c in t] for x, t in zip(lines, typed)):
        return None
    head, body = (lines[0], lines[1:]) if header else ("", lines)
    if len(head) > MOST or any(not x.strip() or len(head) + len(x) > MOST for x in body):
        return None
    if not body:
        return [(head, head)] if head.strip() else None
    n = len(head)
    runs = ["".join(body[i:j]) for i, j in run_cuts([*map(len, body)], 0, MOST - n, TARGET - n, max(LEAST - n, 0))]
    return [(head + r if k == 0 else r, head + r) for k, r in enumerate(runs)]


def fragments(text: str, kind: str | None, items: list[str] | None = None, header: list[str] | None = None, rows: list[list[str]] | None = None) -> list[tuple[str, str]]:
    """(text, text to search by) of a block's pieces; blank pieces are left out."""
    lines = text.splitlines(keepends=True)
    pieces = None
    if kind == "list":
        pieces = _list_pieces(lines, [*(items or [])])
    elif kind == "table":
        pieces = _table_pieces(lines, [*(header or [])], [*(rows or [])])
    pieces = pieces or [(text[a:b],) * 2 for a, b in offset_cuts(text)]
    return [p for p in pieces if p[0].strip()]


PIECES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("retrieval", T.StringType())]))


@F.arrow_udf(PIECES)
def _fragments(text: pa.Array, structure: pa.Array) -> pa.Array:
    pieces = [fragments(t or "", s["kind"], s["items"], s["header"], s["rows"]) for t, s in zip(text.to_pylist(), structure.to_pylist())]
    return pa.array([[{"text": a, "retrieval": b} for a, b in p] for p in pieces], pa.list_(pa.struct({"text": pa.string(), "retrieval": pa.string()})))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _packs(lengths: pd.Series) -> pd.Series:
    """For each block of a run the number of its pack."""
    return lengths.map(lambda n: [k for k, (i, j) in enumerate(run_cuts([*n], 2, MOST, TARGET, LEAST)) for _ in range(i, j)])


def open_headings(blocks: DataFrame) -> DataFrame:
    """The blocks with heading_path and heading_level, by the headings up to each of them.

    Headings are numbered, their stack is a fold over the headings alone, and each block
    takes the stack of the last one by its number.
    """
    w = W.partitionBy("graph_id").orderBy("reading_order")
    title = F.trim("structure.title")
    counts = (F.col("structure.kind") == "heading") & F.col("structure.level").isNotNull() & (title != "")
    rows = blocks.withColumn("is_head", F.coalesce(counts, F.lit(False))).withColumn("head", F.sum(F.col("is_head").cast("int")).over(w))
    heads = rows.where("is_head").groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("head", F.col("structure.level").alias("level"), title.alias("title")))).alias("h"))
    none = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<head:bigint,level:int,path:array<string>>>").alias("all"))

    def push(a, h):
        stack = F.concat(F.slice(a["stack"], F.lit(1), h["level"] - 1), F.array(h["title"]))
        return F.struct(stack.alias("stack"), F.concat(a["all"], F.array(F.struct(h["head"].alias("head"), h["level"].alias("level"), stack.alias("path")))).alias("all"))

    paths = heads.select("graph_id", F.inline(F.aggregate("h", none, push, lambda a: a["all"])))
    out = rows.join(paths, ["graph_id", "head"], "left")
    return out.withColumn("heading_path", F.coalesce("path", F.array().cast("array<string>"))).withColumnRenamed("level", "heading_level").drop("path", "is_head", "head")


def typed_chunks(blocks: DataFrame) -> DataFrame:
    """graph_id, sequence, block_id, kind, heading_path, heading_level, location, text, retrieval_text, contextual_prefix, token_estimate, confidence.

    Paragraphs that follow each other under one heading, with nothing between them, are
    packed by size. Lists and tables are cut between rows, and table pieces are searched
    with their header, but only where the typed rows are the text's lines one by one; any
    other text is cut by offsets, so pieces put together are the text. Blocks that are
    not selected or not retrievable break a run and give nothing. Blocks without a
    structure come back whole.
    """
    rows = open_headings(blocks)
    w = W.partitionBy("graph_id").orderBy("reading_order")
    use = F.coalesce("selected", F.lit(True)) & F.coalesce("retrievable", F.lit(True))
    packs = use & (F.col("kind") == "paragraph") & (F.col("structure.kind") == "atomic") & (F.length("text") <= MOST)
    rows = rows.withColumn("use", use).withColumn("packs", F.coalesce(packs, F.lit(False)))
    same = F.lag("packs").over(w) & (F.lag("heading_path").over(w) == F.col("heading_path")) & F.lag("heading_level").over(w).eqNullSafe(F.col("heading_level"))
    rows = rows.withColumn("run", F.sum(F.when(F.col("packs") & F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))
    keep = ["graph_id", "revision", "reading_order", "block_id", "kind", "heading_path", "heading_level", "confidence"]
    place = F.concat_ws(":", F.lit("graph"), "graph_id", F.col("revision").cast("string"), "block_id")
    # runs of paragraphs: sizes alone decide which blocks go together
    runs = rows.where("packs").groupBy("graph_id", "run").agg(F.sort_array(F.collect_list(F.struct("reading_order", F.length("text").alias("n")))).alias("b"))
    pack = runs.select("graph_id", F.explode(F.arrays_zip(F.col("b.reading_order").alias("reading_order"), _packs("b.n").alias("pack"))).alias("x"), "run").select("graph_id", "run", "x.*")
    paragraphs = rows.where("packs").join(pack, ["graph_id", "run", "reading_order"])
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("reading_order", "text"))), lambda s: s["text"]), "\n\n")
    first = [F.min_by(c, "reading_order").alias(c) for c in keep if c not in ("graph_id", "reading_order", "confidence")]
    paragraphs = paragraphs.groupBy("graph_id", "run", "pack").agg(*first, F.min("reading_order").alias("reading_order"), F.min("confidence").alias("confidence"), texts.alias("text"))
    paragraphs = paragraphs.where(F.trim(F.translate("text", "\r\n\t", "   ")) != "").select(*keep, F.lit(1).alias("part"), "text", F.col("text").alias("retrieval_text"))
    typed = rows.where("use AND NOT packs AND structure IS NOT NULL").select(*keep, F.posexplode(_fragments("text", "structure")).alias("at", "f"))
    typed = typed.select(*keep, (F.col("at") + 1).alias("part"), F.col("f.text").alias("text"), F.col("f.retrieval").alias("retrieval_text"))
    old = rows.where("use AND structure IS NULL").select(*keep, F.lit(None).cast("int").alias("part"), "text", F.col("text").alias("retrieval_text"))
    old = old.withColumn("heading_path", F.array().cast("array<string>")).withColumn("heading_level", F.lit(None).cast("int"))
    every = paragraphs.unionByName(typed).unionByName(old)
    location = F.concat(place, F.when(F.col("part").isNull(), "").otherwise(F.concat(F.lit("#chunk:"), F.col("part").cast("string"))))
    order = W.partitionBy("graph_id").orderBy("reading_order", "part")
    prefix = X.context_prefix(F.col("heading_path"))
    return every.select(
        "graph_id", F.row_number().over(order).alias("sequence"), "block_id", "kind", "heading_path", "heading_level", location.alias("location"), "text", "retrieval_text",
        prefix.alias("contextual_prefix"), X.token_estimate(F.trim(F.concat_ws(" ", prefix, "retrieval_text"))).alias("token_estimate"), "confidence",
    )
