"""HTML tables with row and column spans: reading, laying out on a grid, and rendering back."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = T.StructType([T.StructField("text", T.StringType()), T.StructField("rowspan", T.IntegerType()), T.StructField("colspan", T.IntegerType())])
TABLE = T.StructType([T.StructField("header", T.BooleanType()), T.StructField("rows", T.ArrayType(T.ArrayType(CELL)))])


class _Reader(HTMLParser):
    """Collects the cells of the rows of a table; whatever stands outside a cell is left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.row, self.cell, self.header = [], None, None, False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            spans = {n: int(v) if (v := dict(attrs).get(n) or "").isdecimal() and int(v) > 0 else 1 for n in ("rowspan", "colspan")}
            self.cell = {"text": "", **spans}
            self.header |= tag == "th"
        elif tag == "br" and self.cell is not None:
            self.cell["text"] += "\n"

    def handle_data(self, data):
        if self.cell is not None:
            self.cell["text"] += data

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None and self.row is not None:
            self.row.append({**self.cell, "text": self.cell["text"].strip()})
            self.cell = None
        elif tag == "tr" and self.row is not None:
            self.rows += [self.row] if self.row else []
            self.row = None


def read_html_table(html: str | None) -> dict | None:
    """header (whether any cell is a heading) and rows of cells; None where there is no row."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return {"header": reader.header, "rows": reader.rows} if reader.rows else None


@F.pandas_udf(TABLE)
def html_table(html: pd.Series) -> pd.DataFrame:
    """The first to last row of a table as cells with their spans; rows is null without a row."""
    read = [read_html_table(h) or {"header": None, "rows": None} for h in html]
    return pd.DataFrame({"header": pd.Series([r["header"] for r in read], dtype=object), "rows": [r["rows"] for r in read]})


def grid_places(rows: list[list[tuple[int, int]]]) -> list[list[int]]:
    """The first column of each cell, from 0, given the (rowspan, colspan) of the cells row by row.

    A cell goes to the first column that no cell of an earlier row still covers. Where a
    wide cell reaches over a covered column, both hold it. ``until`` holds for each
    column the first row in which it is free again.
    """
    until: list[int] = []
    out = []
    for r, row in enumerate(rows):
        places, c = [], 0
        for down, across in row:
            while c < len(until) and until[c] > r:
                c += 1
            places.append(c)
            until += [0] * (c + across - len(until))
            until[c : c + across] = [max(u, r + down) for u in until[c : c + across]]
            c += across
        out.append(places)
    return out


@F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _places(rows: pa.Array) -> pa.Array:
    return pa.array([t and grid_places([[(c["rowspan"], c["colspan"]) for c in r] for r in t]) for t in rows.to_pylist()], pa.list_(pa.list_(pa.int32())))


def table_cells(tables: DataFrame, html: str, keys: list[str]) -> DataFrame:
    """keys, row, column, rowspan, colspan, text, is_header: each cell at its place on the table's grid, from 0.

    Spans that reach below the last row are kept as stated. ``is_header``: the cell stands
    in the first row of a table that has heading cells.
    """
    read = tables.select(*keys, html_table(html).alias("t")).where("t.rows IS NOT NULL").withColumn("at", _places("t.rows"))
    rows = read.select(*keys, "t.header", F.posexplode(F.arrays_zip(F.col("t.rows").alias("cells"), F.col("at"))).alias("row", "r"))
    cells = rows.select(*keys, "header", "row", F.explode(F.arrays_zip(F.col("r.cells").alias("cell"), F.col("r.at").alias("column"))).alias("c"))
    return cells.select(*keys, "row", F.col("c.column").alias("column"), F.col("c.cell.rowspan").alias("rowspan"), F.col("c.cell.colspan").alias("colspan"), F.col("c.cell.text").alias("text"), (F.col("header") & (F.col("row") == 0)).alias("is_header"))


def covered_cells(cells: DataFrame, keys: list[str], most: int = 1_000_000) -> DataFrame:
    """keys, row, column, text: every place of the grid that a cell covers, with the cell's text.

    Spans reach no further than the table has rows. A place that two cells cover is there
    twice. A span over ``most`` columns is an error.
    """
    last = cells.groupBy(*keys).agg(F.max("row").alias("last"))
    wide = F.when(F.col("colspan") > most, F.raise_error(F.lit("a cell spans too many columns"))).otherwise(F.col("colspan"))
    rows = cells.join(last, keys).withColumn("r", F.explode(F.sequence(F.col("row"), F.least(F.col("row") + F.col("rowspan") - 1, F.col("last")))))
    return rows.withColumn("c", F.explode(F.sequence(F.col("column"), F.col("column") + wide - 1))).select(*keys, F.col("r").alias("row"), F.col("c").alias("column"), "text")


def _markup(table: dict) -> str:
    tag = lambda r: "th" if table["header"] and r == 0 else "td"
    span = lambda c: "".join(f' {n}="{c[n]}"' for n in ("rowspan", "colspan") if c[n] > 1)
    lines = ["<tr>" + "".join(f"<{tag(r)}{span(c)}>{escape(c['text'])}</{tag(r)}>" for c in row) + "</tr>" for r, row in enumerate(table["rows"])]
    return "\n".join(["<table>", *lines, "</table>"])


@F.arrow_udf(T.StringType())
def _html(table: pa.Array) -> pa.Array:
    return pa.array([t and _markup(t) for t in table.to_pylist()], pa.string())


def render_tables(tables: DataFrame, html: str, keys: list[str]) -> DataFrame:
    """keys, markdown: each HTML table as Markdown, with pipes, or as clean HTML where a cell spans.

    The first row of a pipe table is its header; rows of unequal width are an error. A
    text without a table row gives null.
    """
    from lodestrata.sources.tables import escape_cell

    read = tables.select(*keys, html_table(html).alias("t"))
    rows = F.col("t.rows")
    spans = F.exists(rows, lambda r: F.exists(r, lambda c: (c["rowspan"] > 1) | (c["colspan"] > 1)))
    read = read.select(*keys, "t", F.when(spans, F.col("t")).alias("spanned")).withColumn("html", _html("spanned"))
    width = F.size(F.get(rows, 0))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: escape_cell(c["text"])), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    uneven = F.exists(rows, lambda r: F.size(r) != width)
    pipes = F.when(uneven, F.raise_error(F.lit("rows of a plain table need one width")).cast("string")).otherwise(F.array_join(F.concat(F.array(line(F.get(rows, 0)), rule), F.transform(F.slice(rows, F.lit(2), F.size(rows)), line)), "\n"))
    return read.select(*keys, F.when(rows.isNull(), F.lit(None).cast("string")).when(F.col("html").isNotNull(), F.col("html")).otherwise(pipes).alias("markdown"))
