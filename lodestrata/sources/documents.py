"""Recorded converter output and office files as block tables."""

from __future__ import annotations

import functools
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYOUT_PAGES = "pages array<struct<page_index:int,width:int,height:int,parsing_res_list:array<struct<block_label:string,block_content:string,block_bbox:array<double>,block_id:string,block_order:int>>>>"
#: Block kinds by label of the layout engines (fixed values).
LABELS = {"doc_title": "heading", "paragraph_title": "heading", "title": "heading", "text": "paragraph", "table": "table", "image": "image", "figure": "image", "figure_title": "caption", "formula": "formula", "list": "list", "code": "code", "header": "noise", "footer": "noise", "number": "noise"}
WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
MATH_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
#: What makes a paragraph count without text, the built-in date formats of sheets, and the day 0 of their serial numbers (fixed values).
DRAWN = [f"{WORD_NS}drawing", f"{WORD_NS}pict", f"{WORD_NS}object", f"{MATH_NS}oMath", f"{MATH_NS}oMathPara"]
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
EPOCH = datetime(1899, 12, 30)


def layout_blocks(results: DataFrame, column: str = "json", key: str = "graph_id") -> DataFrame:
    """Blocks of recorded layout pages; unordered blocks follow the ordered ones, and empty texts are left out."""
    labels = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    page = results.select(key, F.explode(F.from_json(column, LAYOUT_PAGES)["pages"]).alias("p"))
    block = page.select(key, (F.col("p.page_index") + 1).alias("page"), F.posexplode("p.parsing_res_list").alias("at", "b"))
    order = F.struct("page", F.coalesce("b.block_order", F.lit(2**31 - 1)).alias("o"), "at")
    kind = F.coalesce(labels[F.col("b.block_label")], F.lit("paragraph"))
    rows = block.select(key, order.alias("reading_order"), F.concat_ws(":", F.col("page").cast("string"), "b.block_id").alias("block_id"), kind.alias("kind"), F.col("b.block_content").alias("text"), "page", *[F.get("b.block_bbox", k).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])
    return rows.where("kind IN ('table', 'image') OR trim(coalesce(text, '')) <> ''").withColumn("text", F.coalesce("text", F.lit("")))


def _docx_body(raw: bytes) -> ElementTree.Element:
    return ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{WORD_NS}body")


def _docx(raw: bytes) -> list[tuple[str, str]]:
    """Paragraphs and cells in order. A cell's text is that of its own paragraphs; tables inside it are left to it."""
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{WORD_NS}t")).strip()
    own = lambda cell: "\n".join(text(p) for p in cell.findall(f"{WORD_NS}p")).strip()
    out, tables, lines = [], 0, 0
    for e in _docx_body(raw):
        if e.tag == f"{WORD_NS}p":
            lines += 1
            out.append((f"paragraph:{lines}", text(e)))
        elif e.tag == f"{WORD_NS}tbl":
            tables += 1
            out += [(f"table:{tables}/row:{r}/cell:{c}", own(cell)) for r, row in enumerate(e.findall(f"{WORD_NS}tr"), 1) for c, cell in enumerate(row.findall(f"{WORD_NS}tc"), 1)]
    return [(a, t) for a, t in out if t]


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a serial number as a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode") or "") for f in root.iter(f"{SHEET_NS}numFmt")}
    dates = DATE_FORMATS | {k for k, code in own.items() if re.search("[ymdhs]", code, re.I)}
    styles = root.find(f"{SHEET_NS}cellXfs")
    return set() if styles is None else {k for k, x in enumerate(styles) if int(x.get("numFmtId") or 0) in dates}


def _xlsx_sheets(z: zipfile.ZipFile) -> list[str]:
    return sorted((n for n in z.namelist() if n.startswith("xl/worksheets/sheet")), key=lambda n: int("".join(filter(str.isdigit, n)) or 0))


def _xlsx(raw: bytes) -> list[tuple[str, str]]:
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in s.iter(f"{SHEET_NS}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    out, dated = [], _date_styles(z)
    for k, name in enumerate(_xlsx_sheets(z), 1):
        for c in ElementTree.fromstring(z.read(name)).iter(f"{SHEET_NS}c"):
            formula, value = c.find(f"{SHEET_NS}f"), c.find(f"{SHEET_NS}v")
            if formula is None and value is not None and c.get("t") in (None, "n") and int(c.get("s") or 0) in dated:
                out.append((f"sheet:{k}/cell:{c.get('r')}", (EPOCH + timedelta(seconds=round(float(value.text) * 86400))).isoformat(sep=" ")))
                continue
            text = "=" + (formula.text or "") if formula is not None else shared[int(value.text)] if c.get("t") == "s" and value is not None else "".join(t.text or "" for t in c.iter(f"{SHEET_NS}t")) if c.get("t") == "inlineStr" else value.text if value is not None else ""
            if text:
                out.append((f"sheet:{k}/cell:{c.get('r')}", text))
    return out


def office_units(files: DataFrame) -> DataFrame:
    """(path, place, location, text, issue) of word and sheet files (path, kind, content); a broken file gives one issue row."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, kind, raw in zip(pdf["path"], pdf["kind"], pdf["content"]):
                try:
                    out += [(path, k, a, t, None) for k, (a, t) in enumerate((_docx if kind == "docx" else _xlsx)(bytes(raw)), 1)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError) as e:
                    out.append((path, 0, None, None, f"unreadable: {type(e).__name__}"))
            yield pd.DataFrame(out, columns=["path", "place", "location", "text", "issue"])

    return files.where(F.col("kind").isin("docx", "xlsx")).select("path", "kind", "content").mapInPandas(parse, "path string, place int, location string, text string, issue string")


def _counts(kind: str, raw: bytes) -> dict:
    if kind == "docx":
        body = _docx_body(raw)
        full = [p for p in body.findall(f"{WORD_NS}p") if "".join(p.itertext()).strip() or any(p.find(f".//{t}") is not None for t in DRAWN)]
        return {"paragraphs": len(full), "tables": len(body.findall(f"{WORD_NS}tbl"))}
    z = zipfile.ZipFile(io.BytesIO(raw))
    places = [[re.fullmatch("([A-Z]+)([0-9]+)", c.get("r") or "") for c in ElementTree.fromstring(z.read(n)).iter(f"{SHEET_NS}c")] for n in _xlsx_sheets(z)]
    number = lambda letters: functools.reduce(lambda a, c: 26 * a + ord(c) - 64, letters, 0)
    return {"sheets": len(places), "rows": [max((int(m[2]) for m in p if m), default=0) for p in places], "columns": [max((number(m[1]) for m in p if m), default=0) for p in places]}


def preflight(files: DataFrame) -> DataFrame:
    """path, kind, sha256, paragraphs, tables, sheets, rows, columns, issue: what a file holds, counted before it is parsed.

    files: path, kind, content. ``rows`` and ``columns`` hold the extent of each sheet. A
    broken file, and a kind that is not read, has no counts and an issue.
    """
    names = ["paragraphs", "tables", "sheets", "rows", "columns"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for kind, raw in zip(batch.column("kind").to_pylist(), batch.column("content")):
                try:
                    found.append(_counts(kind, raw.as_py() or b"") if kind in ("docx", "xlsx") else {"issue": "unsupported-kind"})
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError, TypeError) as e:
                    found.append({"issue": f"unreadable: {type(e).__name__}"})
            lists = {"rows", "columns"}
            columns = [pa.array([f.get(n) for f in found], pa.list_(pa.int32()) if n in lists else pa.int32()) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("kind"), batch.column("sha256"), *columns, pa.array([f.get("issue") for f in found], pa.string())], names=["path", "kind", "sha256", *names, "issue"])

    rows = files.select("path", "kind", F.sha2("content", 256).alias("sha256"), "content")
    return rows.mapInArrow(count, "path string, kind string, sha256 string, paragraphs int, tables int, sheets int, rows array<int>, columns array<int>, issue string")


def parse_confidence(issues):
    """0.95 less a quarter for each issue, 0 at least."""
    return F.greatest(F.lit(0.0), F.lit(0.95) - 0.25 * issues)
