"""PDF pages of files made here: locators, issues, compressed objects, character maps and broken files."""

import zlib

from lodestrata.operators.projection import page_units
from lodestrata.sources import pdf as P


def stream(data, extra="", packed=False):
    data = zlib.compress(data) if packed else data
    return f"<< /Length {len(data)} {'/Filter /FlateDecode' if packed else ''} {extra} >>\nstream\n".encode() + data + b"\nendstream"


def file(objects, top="/Root 1 0 R"):
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o if isinstance(o, bytes) else o.encode()) for n, o in objects.items()) + f"trailer\n<< {top} >>\nstartxref\n0\n%%EOF".encode()


def pages(*contents, fonts="/F1 << /Type /Font /Subtype /Type1 >>", packed=False):
    """A file whose pages show the content streams given; None for a page without one."""
    kids = " ".join(f"{10 + 2 * k} 0 R" for k in range(len(contents)))
    objects = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{kids}] /Count {len(contents)} /Resources << /Font << {fonts} >> >> >>"}
    for k, c in enumerate(contents):
        objects[10 + 2 * k] = f"<< /Type /Page /Parent 2 0 R {f'/Contents {11 + 2 * k} 0 R' if c is not None else ''} >>"
        if c is not None:
            objects[11 + 2 * k] = c if c.startswith(b"<<") else stream(c, packed=packed)
    return objects


def show(*lines):
    return b"BT /F1 12 Tf 72 720 Td " + b" 0 -14 Td ".join(b"(" + x + b") Tj" for x in lines) + b" ET"


def test_pages_keep_their_places_and_issues(spark):
    text = [show(b"Chapter One", b"1. List \\(point\\) \\101\\\n!"), show(b"Question: What?", b"Answer: It."), None, b"BT /F1 1 Tf ET", b"<< /Length 3 /Filter /LZWDecode >>\nstream\nabc\nendstream"]
    files = {
        "plain": file(pages(*text)),
        "packed": file(pages(*text[:2], packed=True)),
        "none": file({1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [] /Count 0 >>"}),
        "rootless": file({5: "<< >>"}, ""),
        "loop": file({1: "<< /Pages 2 0 R >>", 2: "<< /Kids [2 0 R 3 0 R] >>", 3: "3 0 R"}),
        "locked": file(pages(text[0]), "/Root 1 0 R /Encrypt 9 0 R"),
        "other": b"no file of this kind",
        "cut": file(pages(*text[:1]))[:300],
        "null": None,
    }
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None, "x") for k, v in files.items()], "path string, content binary, page string")
    read = P.pdf_pages(df)
    got = {}
    for r in read.orderBy("path", "page").collect():
        got.setdefault(r.path, []).append((r.page, r.text, r.issue))
    first, second = "Chapter One\n1. List (point) A!", "Question: What?\nAnswer: It."
    assert got["plain"] == [(1, first, None), (2, second, None), (3, "", "empty-page"), (4, "", "empty-page"), (5, "", "page-unreadable")]
    assert got["packed"] == [(1, first, None), (2, second, None)]
    assert got["none"] == got["rootless"] == [(0, None, "missing-pages")]
    assert got["locked"] == got["other"] == got["null"] == [(0, None, "unreadable-file")]
    assert got["loop"] in ([(0, None, "missing-pages")], [(0, None, "unreadable-file")]) and got["cut"][0][2] is not None
    units = [(r.page, r.kind, r.text) for r in P.pdf_units(read.where("path = 'plain'")).orderBy("place").collect()]
    assert units == [(1, "heading", "Chapter One"), (1, "list-item", "1. List (point) A!"), (2, "question-answer", "Question: What?\nAnswer: It.")]
    worth = {r.path: r for r in P.pdf_evidence(read).collect()}
    assert (worth["plain"].pages, worth["plain"].text_pages, worth["plain"].text_coverage, worth["plain"].issues) == (5, 2, 0.4, 3) and abs(worth["plain"].confidence - 0.2) < 1e-9
    assert worth["packed"].confidence == 0.95 and worth["none"].pages == 0
    assert P.pdf_pages(df.limit(0)).count() == 0


def test_lines_pair_as_in_a_walk(spark):
    import random
    import re

    rng = random.Random(12)
    pool = ["Q: a", "A: b?", "a. c", "1) d", "plain", "ALL CAPS", "Unit 3", "x | y", "- item", "why?", " ", "answer: yes"]
    pages_ = [[rng.choice(pool) for _ in range(rng.randrange(9))] for _ in range(200)]
    want = []
    for d, lines in enumerate(pages_):
        lines, k = [x.strip() for x in lines if x.strip()], 0
        while k < len(lines):
            x = lines[k]
            asks = re.match(r"(?i)(?:q(?:uestion)?[.:]|[0-9]+[.)])\s*", x) or x.endswith("?")
            if asks and k + 1 < len(lines) and re.match(r"(?i)(?:a(?:nswer)?[.:])\s*", lines[k + 1]):
                want.append((d, "question-answer", f"{x}\n{lines[k + 1]}"))
                k += 2
                continue
            head = k == 0 and (re.match(r"(?i)(?:chapter|unit|section|lesson)\b", x) or len(x) <= 90 and x.isupper())
            want.append((d, "heading" if head else "list-item" if re.match(r"(?:[-*+]|[0-9]+[.)])\s+", x) else "table-row" if " | " in x else "paragraph", x))
            k += 1
    df = spark.createDataFrame([(d, k, x) for d, p in enumerate(pages_) for k, x in enumerate(p)], "doc int, k int, text string")
    assert [(r.doc, r.kind, r.text) for r in page_units(df, ["doc"], "k").orderBy("doc", "k").collect()] == want


def test_operators_that_move_and_show():
    pdf = P.Pdf(file(pages(b"q BI /W 1 ID (x) Tj EI Q BT /F1 9 Tf [(He) -20 (llo) -300 (there)] TJ 5 0 Td (same) Tj T* (next) Tj (quote) ' 1 2 (double) \" <48 69> Tj 1 0 0 1 0 0 Tm (end%) Tj ET % (no) Tj")))
    assert pdf.text(pdf.pages()[0]) == "Hello there same\nnext\nquote\ndoubleHi\nend%"
    for odd in (b" \n", b"BT (a) Tj ET \n\n", b"] >> (a) Tj \n", b"(a) Tj (open"):
        pdf = P.Pdf(file(pages(odd)))
        try:
            assert pdf.text(pdf.pages()[0]) in ("", "a")
        except P.Broken:
            assert b"open" in odd


def test_character_maps():
    cmap = b"2 beginbfchar <0001> <4E2D> <02> <00660066> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange 1 beginbfrange <20> <21> [<0058> <D83DDE00>] endbfrange"
    decode = P.unicode_map(cmap)
    assert decode(bytes.fromhex("0001 02 0010 0012 20 21 ff")) == "中ffacX😀�"
    objects = pages(b"BT /F2 9 Tf <00010011> Tj ET", b"BT /F3 9 Tf <0001> Tj ET", fonts="/F2 << /Subtype /Type0 /ToUnicode 90 0 R >> /F3 << /Subtype /Type0 >>")
    objects[90] = stream(cmap, packed=True)
    pdf = P.Pdf(file(objects))
    assert pdf.text(pdf.pages()[0]) == "中b"
    try:
        pdf.text(pdf.pages()[1])
        raise AssertionError
    except P.Broken:
        pass


def test_objects_in_streams():
    inner = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Kids [3 0 R] >>", 3: "<< /Type /Page /Contents [4 0 R 5 0 R] >>"}
    body, index = b"", b""
    for n, o in inner.items():
        index += b"%d %d " % (n, len(body))
        body += o.encode() + b" "
    objects = {4: stream(b"BT (a) Tj"), 5: stream(b"(b) Tj ET"), 8: stream(index + body, f"/Type /ObjStm /N 3 /First {len(index)}", packed=True), 9: stream(b"", "/Type /XRef /Root 1 0 R")}
    pdf = P.Pdf(file(objects, "/Size 10"))
    assert [pdf.text(p) for p in pdf.pages()] == ["ab"]
