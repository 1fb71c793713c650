"""Text of PDF pages, with the issues that a reader of them must see.

A small reader of the file format: objects are found by scanning the file, so a broken
cross-reference table does no harm; object streams are opened; page text comes from the
operators that show it, decoded by the font's own map to Unicode or as Latin text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.operators.projection import page_units

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")
TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]{}]|/[^\x00\t\n\f\r ()<>\[\]{}/%]*|\(|<[0-9A-Fa-f\s]*>|[^\x00\t\n\f\r ()<>\[\]{}/%]+")
PAREN = re.compile(rb"[()]|\\(?:[0-7]{1,3}|\r\n|.)", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
LINK = re.compile(rb"\s+\d+\s+R\b")
WHOLE = re.compile(rb"\d+")
NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
TRAILER = re.compile(rb"\btrailer\b")
STREAM, ENDSTREAM = re.compile(rb"\s*stream\r?\n?"), re.compile(rb"\s*endstream")
CODE = re.compile(rb"#([0-9A-Fa-f]{2})")
BLANKS = re.compile(r"[ \t]+")
#: Rows and letters of a batch of pages.
ROWS, LETTERS = 5_000, 4_000_000
END = object()


class Name(str):
    """A name as opposed to a string."""


class Ref(int):
    """A reference to an object by its number."""


class Word(bytes):
    """An operator or keyword."""


class Broken(ValueError):
    """A part of the file that cannot be read."""


class Scanner:
    """Values from a stretch of bytes, one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def token(self) -> bytes | object:
        while m := TOKEN.search(self.data, self.at):
            self.at = m.end()
            if not m[0].startswith(b"%"):
                return m[0]
        self.at = len(self.data)
        return END

    def text(self) -> bytes:
        """The string whose opening parenthesis has been read."""
        depth, out, start = 1, [], self.at
        for m in PAREN.finditer(self.data, self.at):
            out.append(self.data[start : m.start()])
            start = m.end()
            if m[0] in b"()":
                depth += 1 if m[0] == b"(" else -1
                if not depth:
                    self.at = start
                    return b"".join(out)
                out.append(m[0])
            else:
                code = m[0][1:]
                out.append(bytes([int(code, 8) & 255]) if code[:1].isdigit() and code[0] < 56 else ESCAPES.get(code, code))
        raise Broken("a string does not end")

    def value(self):
        t = self.token()
        if t is END or t in (b">>", b"]"):
            return END
        if t == b"<<":
            items = list(iter(self.value, END))
            return dict(zip(items[::2], items[1::2]))
        if t == b"[":
            return list(iter(self.value, END))
        if t == b"(":
            return self.text()
        if t[:1] == b"/":
            return Name(CODE.sub(lambda m: bytes([int(m[1], 16)]), t[1:]).decode("latin-1"))
        if t[:1] == b"<":
            digits = b"".join(t[1:-1].split())
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if WHOLE.fullmatch(t) and (m := LINK.match(self.data, self.at)):
            self.at = m.end()
            return Ref(t)
        if NUMBER.fullmatch(t):
            return float(t) if b"." in t else int(t)
        return {b"true": True, b"false": False, b"null": None}.get(t, Word(t))


class Pdf:
    """The objects and pages of a file."""

    def __init__(self, raw: bytes):
        if b"%PDF-" not in raw[:1024]:
            raise Broken("no PDF header")
        self.raw, self.packed = raw, {}
        self.places = {int(m[1]): m.end() for m in OBJECT.finditer(raw)}
        tops = [Scanner(raw, m.end()).value() for m in TRAILER.finditer(raw)]
        for number in list(self.places):
            head = self.get(Ref(number))
            if isinstance(head, dict) and head.get("Type") == "XRef":
                tops.append(head)
            elif isinstance(head, dict) and head.get("Type") == "ObjStm":
                self._open(number, head)
        self.top = {k: v for t in tops if isinstance(t, dict) for k, v in t.items()}
        if "Encrypt" in self.top:
            raise Broken("encrypted")

    def _open(self, number: int, head: dict) -> None:
        data = self.stream(Ref(number))
        first = self.get(head["First"])
        numbers = list(map(int, data[:first].split()[: 2 * self.get(head["N"])]))
        for n, at in zip(numbers[::2], numbers[1::2]):
            self.packed.setdefault(n, (data, first + at))

    def get(self, x):
        """The value that a reference stands for; other values as they are."""
        for _ in range(100):
            if not isinstance(x, Ref):
                return x
            if int(x) in self.places:
                x = Scanner(self.raw, self.places[int(x)]).value()
            elif int(x) in self.packed:
                x = Scanner(*self.packed[int(x)]).value()
            else:
                return None
        raise Broken("references without end")

    def stream(self, ref: Ref) -> bytes:
        """The decoded bytes of a stream object."""
        scan = Scanner(self.raw, self.places[int(ref)])
        head = scan.value()
        m = STREAM.match(self.raw, scan.at)
        if not m or not isinstance(head, dict):
            raise Broken("no stream")
        size = self.get(head.get("Length"))
        end = m.end() + size if isinstance(size, int) and ENDSTREAM.match(self.raw, m.end() + size) else self.raw.find(b"endstream", m.end())
        data = self.raw[m.end() : end]
        filters = self.get(head.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if f in ("FlateDecode", "Fl"):
                data = zlib.decompressobj().decompress(data)
            elif f in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.partition(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                raise Broken(f"filter {f}")
        return data

    def pages(self) -> list[dict]:
        """The pages in order, each with what it inherits."""
        root = self.get(self.top.get("Root"))
        out, todo, seen = [], [(self.get(root).get("Pages"), {})] if isinstance(root, dict) else [], set()
        while todo:
            ref, given = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and int(ref) in seen):
                continue
            seen.add(int(ref) if isinstance(ref, Ref) else -len(seen) - 1)
            given = {**given, **{k: node[k] for k in ("Resources",) if k in node}}
            if "Kids" in node:
                todo += [(k, given) for k in reversed(self.get(node["Kids"]) or [])]
            else:
                out.append({**given, **node})
        return out

    def text(self, page: dict) -> str:
        """The page's shown text, a line for each baseline."""
        contents = page.get("Contents")
        target = self.get(contents)
        parts = target if isinstance(target, list) else [contents] if contents is not None else []
        data = b"\n".join(self.stream(p) for p in parts)
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        maps = {name: self._decoder(self.get(f)) for name, f in fonts.items()}
        out: list[str] = []
        scan, args, decode = Scanner(data), [], latin
        while (v := scan.value()) is not END or scan.at < len(data):
            if not isinstance(v, Word):
                args.append(v)
                continue
            if v == b"BI":  # an image's bytes are no operators
                scan.at = (m.end() if (m := re.compile(rb"\sEI\b").search(data, scan.at)) else len(data))
            elif v == b"Tf" and len(args) >= 2:
                decode = maps.get(args[-2], latin)
            elif v in (b"Td", b"TD") and len(args) >= 2:
                out.append("\n" if args[-1] else " " if args[-2] else "")
            elif v in (b"T*", b"BT", b"Tm"):
                out.append("\n")
            elif v in (b"Tj", b"'", b'"') and args and isinstance(args[-1], bytes):
                out += ["" if v == b"Tj" else "\n", decode(args[-1])]
            elif v == b"TJ" and args and isinstance(args[-1], list):
                out += [decode(x) if isinstance(x, bytes) else " " if isinstance(x, (int, float)) and x < -200 else "" for x in args[-1]]
            args = []
        lines = (BLANKS.sub(" ", x).strip() for x in "".join(out).split("\n"))
        return "\n".join(x for x in lines if x)

    def _decoder(self, font):
        """From a font's bytes to text: its own map, else Latin; fonts of wide codes without a map are an error when used."""
        if not isinstance(font, dict):
            return latin
        if isinstance(font.get("ToUnicode"), Ref):
            return unicode_map(self.stream(font["ToUnicode"]))
        return unmapped if font.get("Subtype") == "Type0" else latin


def latin(raw: bytes) -> str:
    return raw.decode("cp1252", "replace")


def unmapped(raw: bytes) -> str:
    raise Broken("a font has no map to text")


def unicode_map(data: bytes):
    """A decoder from a character map: single codes and ranges, of one or more bytes."""
    table: dict[bytes, str] = {}
    wide = lambda b: b.decode("utf-16-be", "replace")
    for kind, body in re.findall(rb"beginbf(char|range)(.*?)endbf", data, re.S):
        values = list(iter(Scanner(body).value, END)) if b"[" not in body else list(_all(body))
        step = 2 if kind == b"char" else 3
        for at in range(0, len(values) - step + 1, step):
            lo, to = values[at], values[at + step - 1]
            hi = values[at + 1] if step == 3 else lo
            for k in range(min(int.from_bytes(hi, "big") - int.from_bytes(lo, "big"), 65535) + 1):
                code = (int.from_bytes(lo, "big") + k).to_bytes(len(lo), "big")
                table[code] = wide(to[k]) if isinstance(to, list) else wide(to[:-2] + ((int.from_bytes(to[-2:], "big") + k) & 0xFFFF).to_bytes(len(to[-2:]), "big"))
    sizes = sorted({len(c) for c in table}, reverse=True) or [1]

    def decode(raw: bytes) -> str:
        out, at = [], 0
        while at < len(raw):
            size = next((n for n in sizes if raw[at : at + n] in table), sizes[-1])
            out.append(table.get(raw[at : at + size], "�"))
            at += size
        return "".join(out)

    return decode


def _all(body: bytes):
    scan = Scanner(body)
    while (v := scan.value()) is not END:
        yield v


COLUMNS = "path string, page int, text string, issue string, message string"


def pdf_pages(files: DataFrame) -> DataFrame:
    """path, page (from 1), text, issue, message: one row per page of each file (path, content).

    ``issue`` is null, ``page-unreadable`` where a page's text cannot be had, or
    ``empty-page`` where it has none. A file without pages gives one row of page 0 with
    ``missing-pages``, a file that is no PDF, is encrypted or null one with
    ``unreadable-file``. A task parses one file at a time, and gives the pages of many small files in one batch.
    """

    def read(raw: bytes | None) -> Iterator[tuple]:
        try:
            pdf = Pdf(raw or b"")
            pages = pdf.pages()
        except Exception as e:  # whatever a broken file causes is told in its row
            yield 0, None, "unreadable-file", f"{type(e).__name__}: {e}"
            return
        if not pages:
            yield 0, None, "missing-pages", "the file has no readable pages"
        for n, page in enumerate(pages, 1):
            try:
                text = pdf.text(page)
            except Exception as e:
                yield n, "", "page-unreadable", type(e).__name__
            else:
                yield n, text, None if text else "empty-page", None

    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "page", "text", "issue", "message"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, letters = [], 0
        for batch in batches:
            for path, raw in zip(batch.column(0), batch.column(1)):
                name = path.as_py()
                for row in read(raw.as_py()):
                    rows.append((name, *row))
                    letters += len(row[1] or "")
                    if len(rows) >= ROWS or letters >= LETTERS:
                        yield pack(rows)
                        rows, letters = [], 0
        if rows:
            yield pack(rows)

    return files.select("path", "content").mapInArrow(run, COLUMNS)


def pdf_units(pages: DataFrame) -> DataFrame:
    """path, place, page, kind, text: the lines of each file's pages as units, in order; a question and its answer are one."""
    lines = pages.where("text <> ''").select("path", "page", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    w = W.partitionBy("path").orderBy("page", "at")
    return page_units(lines, ["path", "page"], "at").select("path", F.row_number().over(w).alias("place"), "page", "kind", "text")


def pdf_evidence(pages: DataFrame) -> DataFrame:
    """path, pages, text_pages, text_coverage, issues, confidence: what a file's reading is worth.

    Confidence is 0.95 less a quarter for each issue, 0 at least.
    """
    from lodestrata.sources.documents import parse_confidence

    count = lambda c: F.count_if(c)
    rows = pages.groupBy("path").agg(count(F.col("page") > 0).alias("pages"), count(F.coalesce("text", F.lit("")) != "").alias("text_pages"), count(F.col("issue").isNotNull()).alias("issues"))
    share = F.when(F.col("pages") > 0, F.col("text_pages") / F.col("pages")).otherwise(0.0)
    return rows.select("path", "pages", "text_pages", share.alias("text_coverage"), "issues", parse_confidence(F.col("issues")).alias("confidence"))
