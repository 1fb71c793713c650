"""Chunks for a model, answers, notes, corrections and scopes against walks that state them plainly."""

import hashlib
import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.operators import corrections as C
from lodestrata.operators import notes as N
from lodestrata.operators import provider as P
from lodestrata.operators import scopes as S


# --- chunks for a model


def walk(tokens, chars, least, target, most, most_chars=None, most_units=None):
    """The chunks' ends, unit by unit."""
    total = rest = sum(tokens)
    fewest = max(1, -(-total // most), -(-sum(chars) // most_chars) if most_chars else 0, -(-len(tokens) // most_units) if most_units else 0)
    left, out, i = min(max((total + target // 2) // target, 1, fewest), max(fewest, total // least)), [], 0
    while i < len(tokens):
        share, held, size, n = -(-rest // left), 0, 0, 0
        while i < len(tokens):
            full = held + tokens[i] > most or most_chars and size + chars[i] > most_chars or most_units and n >= most_units
            if n and (full or held >= least and held + tokens[i] > share and rest - held <= (left - 1) * most):
                break
            held, size, n, i = held + tokens[i], size + chars[i], n + 1, i + 1
        out.append(i)
        rest, left = rest - held, max(1, left - 1)
    return out


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_chunk_ends_are_those_of_a_walk(data):
    tokens = data.draw(st.lists(st.integers(0, 30), min_size=1, max_size=25))
    chars = [3 * t + 1 for t in tokens]
    least, target, most = sorted(data.draw(st.lists(st.integers(1, 20), min_size=3, max_size=3)))
    limits = data.draw(st.sampled_from([(None, None), (40, None), (None, 4), (25, 3)]))
    assert P.chunk_ends(tokens, chars, least, target, most, *limits) == walk(tokens, chars, least, target, most, *limits)


def test_chunk_ends_of_fixed_cases():
    assert P.chunk_ends([1000] * 33, [1000] * 33) == [16, 33]
    assert P.chunk_ends([500] * 30, [500] * 30) == [30]
    assert P.chunk_ends([30_000, 1], [1, 1]) == [1, 2]
    assert P.chunk_ends([], []) == []


def plain_units(text):
    """First and end line of each unit, by a walk over the lines."""
    lines, i, out = text.splitlines(keepends=True), 0, []
    table = lambda k: k + 1 < len(lines) and "|" in lines[k] and P.SEPARATOR.match(lines[k + 1])
    while i < len(lines):
        if not lines[i].strip():
            i += 1
            continue
        first = i
        i += 1
        if fence := P.FENCE.match(lines[first]):
            while i < len(lines) and not ((m := P.FENCE.match(lines[i])) and m[1][0] == fence[1][0]):
                i += 1
            i = min(i + 1, len(lines))
        elif table(first):
            i += 1
            while i < len(lines) and lines[i].strip() and "|" in lines[i]:
                i += 1
        elif P.ITEM.match(lines[first]) or P.QUOTE.match(lines[first]):
            while i < len(lines) and lines[i].strip() and (P.ITEM.match(lines[i]) or P.QUOTE.match(lines[i]) or lines[i][0].isspace()):
                i += 1
        else:
            while i < len(lines) and lines[i].strip() and not (P.HEADING.match(lines[i]) or P.FENCE.match(lines[i]) or P.ITEM.match(lines[i]) or table(i)):
                i += 1
        out.append((first + 1, i))
    return out


LINES = ["text", "  indented", "", " ", "# Title", "### Sub ###", "- item", "1. one", "> said", "| a | b |", "| --- | --- |", "```", "~~~", "```py", "  ```", "a | b", "#", "---"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(LINES), max_size=14), st.booleans())
def test_units_are_those_of_a_walk_over_lines(lines, end):
    text = "\n".join(lines) + "\n" * end
    assert [(u[3], u[4]) for u in P.source_units(text)] == plain_units(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!\n中。#", max_size=120), st.integers(1, 12), st.sampled_from([None, 7, 20]))
def test_oversize_units_keep_every_letter(text, most, most_chars):
    units = P.source_units(text, most, most_chars)
    gaps = "".join(text[a:b] for a, b in zip([0, *(u[2] for u in units)], [*(u[1] for u in units), len(text)]))
    assert not gaps.strip() and all(a[2] <= b[1] for a, b in zip(units, units[1:]))
    for u in units:
        piece = text[u[1] : u[2]]
        assert piece and u[5] == P.provider_tokens(piece)
        if u[0].count("-") == 2 and len(piece) > 1:
            assert u[5] <= most and len(piece) <= (most_chars or len(piece))


def test_pieces_end_at_sentences():
    units = P.source_units("First sentence. Second sentence. Third sentence.", most_chars=20)
    assert [(u[0], u[1]) for u in units] == [("unit-1-1", 0), ("unit-1-2", 16), ("unit-1-3", 33)]


def test_chunks_of_documents(spark):
    body = "# Book\n\n## Lesson\n\n" + "A complete sentence. " * 12
    docs = spark.createDataFrame([(1, body, "x"), (2, None, "x"), (3, " \n", "x"), (4, "中" * 30, "x"), (4, "#\n\n### Deep\n\n# Top\n\nx", "x")], "id long, text string, chunk string")
    rows = [r.asDict(True) for r in P.provider_chunks(docs, "id", "text", most_chars=50).orderBy("id", "chunk").collect()]
    one = [r for r in rows if r["id"] == 1]
    assert "".join(r["text"] for r in one).split() == body.split() and all(r["text"] in body for r in one)
    assert [r["chunk"] for r in one] == [*range(1, len(one) + 1)]
    assert one[0]["heading_context"] == [] and one[1]["heading_context"] == [{"level": 1, "text": "Book"}, {"level": 2, "text": "Lesson"}]
    assert {r["id"] for r in rows} == {1, 4}
    units = P.provider_units(docs, "id", "text").where("id = 4").orderBy("start").collect()
    assert [(u.level, u.title) for u in units if u.level] == [(3, "Deep"), (1, "Top")]
    assert P.provider_chunks(docs.limit(0), "id", "text").count() == 0
    with pytest.raises(ValueError):
        P.provider_chunks(docs, "id", "text", least=5, target=4)


def test_answers_are_checked_rule_by_rule(spark):
    cases = [(None, ["a"], "not-text"), (" \n ", ["a"], "empty"), ("w " * 25_000, ["w"], "too-long"), (' {"a": 1} ', ["a"], "json"), ("[1]", ["1"], "json"), ("12", ["12"], "ok"), ("x <!-- Source-Unit 1 --> a", ["a"], "source-markers"), ("a", [], "no-source"), ("a", None, "no-source"), ("b c", ["a", " "], "not-preserved"), ("see  the\n\nline here", ["nothing", " the line "], "ok")]
    df = spark.createDataFrame([(k, a, u) for k, (a, u, _) in enumerate(cases)], "k int, answer string, units array<string>")
    got = {r.k: r.s for r in df.select("k", P.answer_state(F.col("answer"), F.col("units")).alias("s")).collect()}
    assert got == {k: s for k, (*_, s) in enumerate(cases)}


def test_alignment_tells_noise_from_rewording(spark):
    blocks = ["Header", "One", "Footer", "Header", "Two", "Footer", "Gone"]
    assert P.aligned_blocks(blocks, "Header\nOne\nTwo") == [("Header", False), ("One", False), ("", True), ("", True), ("Two", False), ("", True), ("Gone", False)]
    rng = random.Random(5)
    for _ in range(300):
        some = [rng.choice(["a", "bb", "a b", "c", ""]) for _ in range(8)]
        answer = " ".join(rng.sample(some, 5))
        cursor = 0
        for b, (text, noise) in zip(some, P.aligned_blocks(some, answer)):
            here = answer.find(b, cursor) >= 0
            assert noise == (not here and some.count(b) > 1 and b != "") and text == ("" if noise else b)
            cursor = answer.index(b, cursor) + len(b) if here else cursor
    rows = spark.createDataFrame([(g, k, "noise" if b == "skip" else "paragraph", b) for g, bs in (("g", blocks), ("h", ["skip", "x"])) for k, b in enumerate(bs)], "graph_id string, reading_order int, kind string, text string")
    said = spark.createDataFrame([("g", "\n Header\nOne\nTwo \n"), ("h", "y")], "graph_id string, answer string")
    out = P.align_answers(rows, said, "graph_id").orderBy("graph_id", "reading_order").collect()
    assert [(r.aligned, r.noise) for r in out] == [*P.aligned_blocks(blocks, "Header\nOne\nTwo"), ("x", False)]
    with pytest.raises(Exception, match="empty"):
        P.align_answers(rows, spark.createDataFrame([("g", " ")], said.schema), "graph_id").collect()


def test_bodies_are_cut_at_the_nearest_blank_line(spark):
    def plain(markdown, weights):
        out, start, total = [], 0, max(sum(weights), 1)
        for w in weights[:-1]:
            target = start + round(len(markdown) * w / total)
            places = [m.start() + 2 for m in re.finditer(r"\n\s*\n", markdown) if m.start() + 2 > start]
            cut = min(places, key=lambda b: abs(b - target), default=target)
            out.append(markdown[start:cut].strip())
            start = cut
        return [*out, markdown[start:].strip()]

    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice(["word ", "\n", "\n\n", "x", " \n"]) for _ in range(rng.randrange(40)))
        weights = [rng.randrange(9) for _ in range(rng.randint(1, 5))]
        assert P.body_parts(text, weights) == plain(text, weights)
    df = spark.createDataFrame([(1, "a\n\nb", [1, 1]), (2, None, [1]), (3, "c", [])], "id int, markdown string, weights array<int>")
    assert [tuple(r) for r in P.note_bodies(df, "id").orderBy("id", "note").collect()] == [(1, 1, "a"), (1, 2, "b"), (2, 1, ""), (3, 1, "c")]


# --- notes


def plain_notes(units):
    size = lambda g: sum(len(units[k][1]) for k in g)
    whole = {"list-item", "table-row", "table-cell", "question-answer"}

    def safe(a, b):
        (ka, ta), (kb, tb) = units[a], units[b]
        asks = re.match(r"(?i)(?:q(?:uestion)?[.:]|[0-9]+[.)])\s*", ta) or ta.rstrip().endswith("?")
        return not (ka in whole or kb in whole or asks and re.match(r"(?i)(?:a(?:nswer)?[.:])\s*", tb))

    def at_heads(group, heads):
        out = []
        for k in group:
            if out and heads(units[k][0]) and safe(out[-1][-1], k):
                out.append([k])
            else:
                out = out or [[]]
                out[-1].append(k)
        return out

    everything = list(range(len(units)))
    if size(everything) <= N.MOST:
        return [everything]
    parts = []
    for section in at_heads(everything, lambda k: k in ("heading", "heading-1", "heading-2")):
        parts += [section] if size(section) <= N.MOST else at_heads(section, lambda k: k.startswith("heading-") and k not in ("heading-1", "heading-2"))
    notes = [[]]
    for part in parts:
        if notes[-1] and size(notes[-1]) >= N.LEAST and size(notes[-1]) + size(part) > N.MOST:
            notes.append([])
        notes[-1] += part
    if len(notes) > 1 and size(notes[-1]) < N.LEAST:
        notes[-2:] = [notes[-2] + notes[-1]]
    return notes


def test_notes_are_those_of_a_walk(spark):
    rng = random.Random(11)
    docs = {0: [("paragraph", "x" * 8000)], 1: [("paragraph", "x" * 8001)]}
    for d in range(2, 60):
        kinds = ["heading-1", "heading-2", "heading-3", "heading", "paragraph", "paragraph", "list-item", "table-row"]
        docs[d] = [(rng.choice(kinds), rng.choice(["Q: why", "is it so?", "A. yes", "t"]) + "x" * rng.choice([0, 10, 900, 2500, 5000])) for _ in range(rng.randint(1, 16))]
    rows = spark.createDataFrame([(d, k, *u) for d, us in docs.items() for k, u in enumerate(us)], "doc int, ordinal int, kind string, text string")
    notes = N.default_notes(rows, "doc")
    got = {}
    for r in notes.orderBy("doc", "ordinal").collect():
        got.setdefault(r.doc, {}).setdefault(r.note, []).append(r.ordinal)
    assert {d: list(g.values()) for d, g in got.items()} == {d: plain_notes(u) for d, u in docs.items()}
    assert all(list(g) == [*range(1, len(g) + 1)] for g in got.values())
    assert N.default_notes(rows.limit(0), "doc").count() == 0


def test_notes_are_merged_and_split_at_safe_places(spark):
    units = [("paragraph", "a"), ("paragraph", "is it?"), ("paragraph", "A: it is"), ("list-item", "l"), ("paragraph", "z"), ("paragraph", "y")]
    note = [1, 1, 1, 2, 2, 3]
    rows = spark.createDataFrame([(d, k, *u, n) for d in range(1, 9) for k, (u, n) in enumerate(zip(units, note))], "doc int, ordinal int, kind string, text string, note int")
    by = lambda df: {d: ([r.note for r in g], g[0].refused) for d in range(1, 9) if (g := [r for r in df.orderBy("doc", "ordinal").collect() if r.doc == d])}
    merged = by(N.merge_notes(rows, spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 0)], "doc int, before int"), "doc"))
    assert merged[1] == ([1, 1, 1, 1, 1, 2], None) and merged[2] == ([1, 1, 1, 2, 2, 2], None)
    assert merged[3] == merged[4] == (note, "no-adjacent-note") and merged[5] == (note, None)
    split = by(N.split_notes(rows, spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 2, 3), (5, 9, 1), (6, 1, 5), (7, 3, 5)], "doc int, sequence int, after int"), "doc"))
    assert split[1] == ([1, 2, 2, 3, 3, 4], None) and split[8] == (note, None)
    assert [split[d][1] for d in range(2, 8)] == ["unsafe-boundary", "no-boundary-there", "unsafe-boundary", "no-such-note", "no-boundary-there", "no-boundary-there"]
    assert [(r.note, r.after) for r in N.safe_splits(rows.where("doc = 1"), "doc").collect()] == [(1, 0)]


# --- corrections


def test_corrected_graphs_have_stable_ids(spark):
    graphs = spark.createDataFrame([("g", 1, None, "att"), ("h", 3, "g0", "att")], "graph_id string, revision int, base_graph_id string, attempt_id string")
    blocks = spark.createDataFrame([(g, f"{g}{k}", k, "paragraph", f"t{k}") for g in "gh" for k in range(3)], "graph_id string, block_id string, reading_order int, kind string, text string")
    new = spark.createDataFrame([("g", "g1", "paragraph", "fixed"), ("h", "h0", "noise", None), ("h", "h2", "paragraph", "t2")], "graph_id string, block_id string, kind string, text string")
    g, b = C.corrected_graphs(graphs, blocks, new)
    g = {r.base_graph_id: r for r in g.collect()}
    assert g["g"].revision == 2 and g["g0"].revision == 4
    mark = hashlib.sha256(json.dumps({"kind": "paragraph", "text": "fixed"}, separators=(",", ":")).encode()).hexdigest()
    state = {"base_graph_id": "g", "graph_revision": 2, "replacements": {"g1": mark}}
    assert g["g"].graph_id == hashlib.sha256(json.dumps(state, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    rows = b.where(F.col("graph_id") == g["g"].graph_id).orderBy("reading_order").collect()
    assert [r.text for r in rows] == ["t0", "fixed", "t2"] and [r.supersedes_block_id for r in rows] == [None, "g1", None]
    assert rows[1].block_id == hashlib.sha256(f"att\0review-correction\0g1:2:{mark}".encode()).hexdigest()
    for bad, why in (([("g", "none", "x", "y")], "does not hold"), ([("g", "g1", "x", "y"), ("g", "g1", "x", "z")], "two corrections")):
        with pytest.raises(Exception, match=why):
            C.corrected_graphs(graphs, blocks, spark.createDataFrame(bad, new.schema))[0].collect()


def test_newest_blocks_follow_chains_of_any_length(spark):
    links = [("b1", "b0"), ("b1", "b0"), ("solo", None)] + [(f"c{k + 1}", f"c{k}") for k in range(21)] + [(f"d{k + 1}", f"d{k}") for k in range(3)]
    df = spark.createDataFrame(links, "block_id string, supersedes_block_id string")
    got = {r.block_id: (r.newest, r.steps) for r in C.newest_blocks(df).collect()}
    assert got == {"b0": ("b1", 1), "b1": ("b1", 0), **{f"c{k}": ("c21", 21 - k) for k in range(22)}, **{f"d{k}": ("d3", 3 - k) for k in range(4)}}
    assert C.newest_blocks(df.limit(0)).count() == 0
    for circle in ([("a", "a")], [("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "a"), ("z", "y")]):
        with pytest.raises(ValueError, match="circle"):
            C.newest_blocks(spark.createDataFrame(circle, df.schema))
    with pytest.raises(Exception, match="two blocks"):
        C.newest_blocks(spark.createDataFrame([("a", "x"), ("b", "x")], df.schema)).collect()


def test_recognised_text_is_corrected_in_place(spark):
    rng = random.Random(4)
    units, given, expected = [], [], []
    for d in range(80):
        mine = [(f"l{k}", rng.choice([None, *range(6)]), f"u{k}") for k in range(rng.randrange(8))]
        locators = rng.sample([f"l{k}" for k in range(14)], 5)
        pages = dict((loc, page) for loc, page, _ in mine)
        fixes = [(loc, pages.get(loc, rng.choice([None, *range(7)])), f"c{loc}") for loc in locators]
        units += [(d, k + 1, "paragraph", text, loc, page) for k, (loc, page, text) in enumerate(mine)]
        given += [(d, k, loc, page, text) for k, (loc, page, text) in enumerate(fixes)]
        now = [(loc, page, dict((a, c) for a, _, c in fixes).get(loc, text)) for loc, page, text in mine]
        for loc, page, text in fixes:
            if loc not in pages:
                later = [k for k, u in enumerate(now) if page is not None and u[1] is not None and u[1] > page]
                now.insert(later[0] if later else len(now), (loc, page, text))
        expected += [(d, k + 1, loc, page, text) for k, (loc, page, text) in enumerate(now)]
    u = spark.createDataFrame(units, "doc int, ordinal int, kind string, text string, locator string, page int")
    c = spark.createDataFrame(given, "doc int, place int, locator string, page int, text string")
    out = C.with_recognised_corrections(u, c, "doc").orderBy("doc", "ordinal").collect()
    assert [(r.doc, r.ordinal, r.locator, r.page, r.text) for r in out] == expected


# --- scopes


def test_parts_have_one_form():
    assert [S.part_number(x) for x in ("3", "03", "A", "十", "十二", "二十", "三十一", "九", "一二", "", "百")] == ["3", "3", "a", "10", "12", "20", "31", "9", None, None, None]
    assert set(S.scope_prefixes("请列出第二章的全部内容")) & set(S.scope_prefixes("Chapter 2 Methods"))
    assert S.alias_groups("Unit 1 and unit 1, U2") == [("unit1", "u1", "第1单元", "1单元"), ("unit2", "u2", "第2单元", "2单元")]


def test_requests_meet_the_headings_they_name(spark):
    paths = [["Grammar", "Unit 1"], ["Grammar", "Unit 2", "Verbs"], ["Words", "第二单元"], ["Romania"], ["Oman", "Unit 1"], ["grammar!", "unit 1"], ["A long heading about rivers", "x"], []]
    requests = {
        1: ('list "Romania" materials', "resolved", [["Romania"]]),  # a longer name contains Oman
        2: ("Summarize Grammar unit 2 overview", "resolved", [["Grammar", "Unit 2"]]),
        3: ("整理第二单元的资料", "resolved", [["Words", "第二单元"]]),  # a heading in these letters stands before one of this kind
            11: ("整理第2单元的资料", "resolved", [["Grammar", "Unit 2"], ["Words", "第二单元"]]),
        4: ('list "Romania" and "Oman" materials', "closed", []),  # no path holds both
        5: ('list "Romania north" materials', "closed", []),  # letters that nothing explains
        6: ("what is the weather", "open", []),
        7: ("tell me of unit 9", "closed", []),
        8: ("grammar of unit 1", "resolved", [["Grammar", "Unit 1"]]),
        9: ("what does a long heading about rivers say", "resolved", [["A long heading about rivers"]]),
        10: (None, "open", []),
    }
    blocks = spark.createDataFrame([(p,) for p in paths + paths[:2]], "heading_path array<string>")
    asked = spark.createDataFrame([(k, v[0]) for k, v in requests.items()], "query_id int, content string")
    got = {}
    for r in S.heading_scopes(blocks, asked).collect():
        got.setdefault(r.query_id, (r.state, []))[1].extend([r.path] if r.path else [])
    assert {k: (s, sorted(p)) for k, (s, p) in got.items()} == {k: (s, sorted(p)) for k, (_, s, p) in requests.items()}
    assert {r.state for r in S.heading_scopes(blocks.limit(0), asked.where("query_id IN (1, 6)")).collect()} == {"closed", "open"}


def test_scope_blocks_fall_back_to_the_named_heading(spark):
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [("d", 1, "text", "heading:Old;2", ["New"], h("text")), ("d", 2, "text", "heading: Old ;2", ["New"], "0" * 64), ("d", 3, "text", "line:3", None, h("text")), ("d", 4, "  ", "heading:Gone", ["New"], h("  ")), ("d", 5, "text", "heading:  ", [], h("text")), ("d", 6, "text", "heading:Old", [], h("text")), ("e", 1, "text", "heading:Old", ["New"], h("text"))]
    blocks = spark.createDataFrame([(*r, 0.9, 4, "") for r in rows], "document_id string, sequence int, text string, location string, heading_path array<string>, block_content_sha256 string, confidence double, token_estimate int, retrieval_text string")
    docs = spark.createDataFrame([("d", True), ("e", False)], "document_id string, is_current boolean")
    out = {r.sequence: (r.heading_path, r.structured) for r in S.scope_blocks(docs, blocks).collect()}
    assert out == {1: (["New"], True), 2: (["Old"], False), 6: (["Old"], False)}
