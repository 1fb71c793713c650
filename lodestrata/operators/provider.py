"""Markdown for a model and back: units, chunks of a token budget, checks of an answer, its alignment, and bodies of notes.

A document is cut into units by the shapes of its lines: each line becomes one letter
that stands for what the line looks like, and units are the matches of one pattern over
those letters. Chunks follow from running sums of the units' tokens: where a chunk ends
is a search in the sums, not a walk over the units.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import text as X

# Token budgets, and the patterns of lines, sentences and tokens.
LEAST, TARGET, MOST, MOST_ANSWER = 10_000, 16_000, 20_000, 24_576
HEADING = re.compile(r"[ \t]{0,3}(#{1,6})[ \t]+")
FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
ITEM = re.compile(r"[ \t]*(?:[-+*]|\d+[.)])[ \t]+")
QUOTE = re.compile(r"[ \t]*>[ \t]?")
SEPARATOR = re.compile(r"[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+[ \t]*$")
SENTENCE = re.compile(r"(?<=[.!?。！？])(?:[ \t]+|(?=\n))")
TOKEN = re.compile(r"[㐀-鿿豈-﫿]|[A-Za-z0-9_]+|[^\s]")
# End of fixed values.

#: Letters of the texts that a task gives back at a time.
LETTERS = 4_000_000

BLANK, BACKTICKS, TILDES, TABLE, LIST, QUOTED, INDENTED, ROW, TITLE = (1 << k for k in range(9))


def _shape(line: str, after: str) -> str:
    """One letter for what a line looks like; ``after`` is the next line."""
    fence = FENCE.match(line)
    bits = BLANK * (not line.strip()) | INDENTED * line[0].isspace() | ROW * ("|" in line)
    bits |= LIST * bool(ITEM.match(line)) | QUOTED * bool(QUOTE.match(line)) | TITLE * bool(HEADING.match(line))
    bits |= TABLE * ("|" in line and bool(SEPARATOR.match(after)))
    if fence:
        bits |= BACKTICKS if fence[1][0] == "`" else TILDES
    return chr(0x100 + bits)


def _any(some: int = 0, none: int = 0) -> str:
    """A class of the letters with one of the bits ``some`` (if given) and without ``none``."""
    return "[" + "".join(chr(0x100 + b) for b in range(512) if (not some or b & some) and not b & none) + "]"


FENCED = BACKTICKS | TILDES
UNIT = re.compile(
    "|".join([
        *(f"{_any(f)}{_any(none=f)}*{_any(f)}?" for f in (BACKTICKS, TILDES)),
        f"{_any(TABLE, FENCED)}{_any()}{_any(ROW, BLANK)}*",
        f"{_any(LIST | QUOTED, FENCED | TABLE)}{_any(LIST | QUOTED | INDENTED, BLANK)}*",
        f"{_any(none=BLANK)}{_any(none=BLANK | FENCED | TABLE | LIST | TITLE)}*",
    ])
)


def token_cost(token: str) -> int:
    return -(-len(token) // 3) if token[0].isascii() and (token[0].isalnum() or token[0] == "_") else 1


def provider_tokens(text: str) -> int:
    return sum(map(token_cost, TOKEN.findall(text)))


def _reach(text: str, start: int, end: int, budget: int) -> int:
    """How far from ``start`` the budget of tokens goes; one letter at least."""
    for m in TOKEN.finditer(text, start, end):
        cost = token_cost(m[0])
        if cost > budget:  # as many letters of a word as the rest pays for
            return max(start + 1, m.start() + 3 * budget if len(m[0]) > 1 else m.start())
        budget -= cost
    return end


def source_units(text: str, most: int = MOST, most_chars: int | None = None) -> list[tuple]:
    """(unit, start, end, first line, last line, tokens, level, title) of each unit, by offsets into the text.

    A fence, table, list, quote or heading is one unit whatever its size. Other units
    over the budget are cut at their last sentence end that fits, or else hard.
    """
    lines = text.splitlines(keepends=True)
    at = [0, *accumulate(map(len, lines))]
    shapes = "".join(map(_shape, lines, [*lines[1:], ""]))
    out: list[tuple] = []
    for m in UNIT.finditer(shapes):
        start, end, first = at[m.start()], at[m.end()], lines[m.start()]
        number = len(out) + 1
        heading = HEADING.match(first)
        title = re.sub(r"[ \t]+#+[ \t]*$", "", first[heading.end() :]).strip() if heading else ""
        head = (len(heading[1]), title) if title else (None, None)
        size = provider_tokens(text[start:end])
        atomic = ord(m[0][0]) - 0x100 & (FENCED | TABLE | LIST | QUOTED | TITLE)
        if atomic or size <= most and (most_chars is None or end - start <= most_chars):
            out.append((f"unit-{number}", start, end, m.start() + 1, m.end(), size, *head))
            continue
        piece = 1
        while start < end:
            stop = _reach(text, start, end if most_chars is None else min(end, start + most_chars), most)
            if stop < end:
                base = at[m.start()]
                ends = [base + s.end() for s in SENTENCE.finditer(text[base:stop], start - base)]
                stop = max(start + 1, max(ends, default=stop))
            where = [bisect_right(at, x) for x in (start, max(start, stop - 1))]
            out.append((f"unit-{number}-{piece}", start, stop, *where, provider_tokens(text[start:stop]), *head))
            start, piece, head = stop, piece + 1, (None, None)
    return out


def chunk_ends(tokens: list[int], chars: list[int], least: int = LEAST, target: int = TARGET, most: int = MOST, most_chars: int | None = None, most_units: int | None = None) -> list[int]:
    """The end of each chunk as a number of units.

    There are about as many chunks as the total holds targets. A chunk ends where, at
    once, it has ``least`` tokens, the next unit would exceed an even share of what is
    left, and what follows fits into the chunks left; or earlier, where a limit is
    reached. All of these are places in running sums.
    """
    t, c = [0, *accumulate(tokens)], [0, *accumulate(chars)]
    n, total = len(tokens), t[-1]
    fewest = max(1, -(-total // most), -(-c[-1] // most_chars) if most_chars else 0, -(-n // most_units) if most_units else 0)
    left = min(max((total + target // 2) // target, 1, fewest), max(fewest, total // least))
    out, at = [], 0
    while at < n:
        hard = bisect_right(t, t[at] + most) - 1
        if most_chars:
            hard = min(hard, bisect_right(c, c[at] + most_chars) - 1)
        if most_units:
            hard = min(hard, at + most_units)
        share = -(-(total - t[at]) // left)
        even = max(bisect_left(t, t[at] + least), bisect_right(t, t[at] + share) - 1, bisect_left(t, total - (left - 1) * most))
        at = min(n, max(at + 1, min(hard, even)))
        out.append(at)
        left = max(1, left - 1)
    return out


UNITS = "array<struct<unit:string,start:int,end:int,first_line:int,last_line:int,tokens:int,level:int,title:string>>"
HEADS = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())]))
CHUNK = T.ArrayType(T.StructType([*[T.StructField(n, T.IntegerType()) for n in ("first", "last", "start", "end", "tokens")], T.StructField("heading_context", HEADS)]))


def provider_units(docs: DataFrame, key: str, text: str, most: int = MOST, most_chars: int | None = None) -> DataFrame:
    """key, place (from 1) and the fields of ``source_units``: one row per unit. Null and blank texts have none."""

    @F.pandas_udf(UNITS)
    def units(texts: pd.Series) -> pd.Series:
        names = ["unit", "start", "end", "first_line", "last_line", "tokens", "level", "title"]
        return texts.map(lambda x: [dict(zip(names, u)) for u in source_units(x or "", most, most_chars)])

    return docs.select(key, F.posexplode(units(text)).alias("place", "u")).select(key, (F.col("place") + 1).alias("place"), "u.*")


def provider_chunks(docs: DataFrame, key: str, text: str, least: int = LEAST, target: int = TARGET, most: int = MOST, most_chars: int | None = None, most_units: int | None = None) -> DataFrame:
    """key, chunk, first and last unit, tokens, heading_context, text: whole documents as chunks for a model.

    A chunk's text is cut out of the document by offsets, from its first unit to its
    last. ``heading_context`` holds the headings that are open where the chunk begins.
    """
    if not 1 <= least <= target <= most <= MOST:
        raise ValueError("least, target and most must be in order, and most within the fixed limit")

    @F.pandas_udf(CHUNK)
    def plan(texts: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[dict]:
            units = source_units(x or "", most, most_chars)
            ends = chunk_ends([u[5] for u in units], [u[2] - u[1] for u in units], least, target, most, most_chars, most_units)
            opened = list(accumulate(units, lambda heads, u: [*heads[: u[6] - 1], {"level": u[6], "text": u[7]}] if u[6] else heads, initial=[]))
            return [
                {"first": a + 1, "last": b, "start": units[a][1], "end": units[b - 1][2], "tokens": sum(u[5] for u in units[a:b]), "heading_context": opened[a]}
                for a, b in zip([0, *ends], ends)
            ]

        return texts.map(one)

    rows = docs.select(key, text, F.posexplode(plan(text)).alias("at", "c"))
    body = F.substring(F.col(text), F.col("c.start") + 1, F.col("c.end") - F.col("c.start"))
    return rows.select(key, (F.col("at") + 1).alias("chunk"), F.col("c.first").alias("first_unit"), F.col("c.last").alias("last_unit"), F.col("c.tokens").alias("tokens"), F.col("c.heading_context").alias("heading_context"), body.alias("text"))


SPACE = r"[\s\x1c-\x1f\x85  　 ]"


#: The characters of SPACE.
SPACES = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def _over(text: Column, most: int) -> Column:
    """Whether the tokens of a text are more than ``most``; a token is one to three signs, so most texts need no count."""
    signs = F.length(reduce(lambda t, c: F.replace(t, F.lit(c)), "\t\n\x0b\f\r ", text))
    return F.when(F.length(text) <= most, F.lit(False)).when(signs > 3 * most, F.lit(True)).otherwise(X.provider_token_estimate(text) > most)


def answer_state(answer: Column, units: Column) -> Column:
    """What a model's answer for a chunk is worth: ok, empty, or the first rule that it breaks.

    ``units`` are the texts of the chunk's units; at least one must come back, white space aside.
    """
    let = lambda x, f: F.get(F.transform(F.array(x), f), 0)  # evaluates x once
    flat = lambda c: F.regexp_replace(c, rf"(?U){SPACE}+", " ")

    def state(answer: Column, text: Column) -> Column:
        kept = let(flat(text), lambda body: F.exists(units, lambda u: (_stripped(u) != "") & F.contains(body, flat(_stripped(u)))))
        shape = F.schema_of_variant(F.try_parse_json(text))
        return (
            F.when(answer.isNull(), "not-text")
            .when(text == "", "empty")
            .when(_over(text, MOST_ANSWER), "too-long")
            .when(F.coalesce(shape.rlike("^(?:OBJECT|ARRAY)"), F.lit(False)), "json")
            .when(text.rlike(r"(?i)<!--\s*source[- ]unit\b"), "source-markers")
            .when(F.coalesce(F.size(units), F.lit(0)) == 0, "no-source")
            .when(~kept, "not-preserved")
            .otherwise("ok")
        )

    return let(answer, lambda a: let(_stripped(a), lambda text: state(a, text)))


def aligned_blocks(blocks: list[str], answer: str) -> list[tuple[str, bool]]:
    """(text, noise) for each block: found ones in order, repeated ones that are missing as noise, others kept as they are."""
    often = {b for b, n in Counter(b.strip() for b in blocks).items() if b and n > 1}
    cursor, out = 0, []
    for block in blocks:
        found = answer.find(block, cursor)
        noise = found < 0 and block.strip() in often
        cursor = found + len(block) if found >= 0 else cursor
        out.append(("" if noise else block, noise))
    return out


def align_answers(blocks: DataFrame, answers: DataFrame, key: str, order: str = "reading_order") -> DataFrame:
    """key, order, aligned, noise: blocks of each graph matched, in order, with the Markdown a model made of them.

    Each block is looked for behind the one found before. A missing text that the graph
    repeats is pagination noise and comes back empty; a missing text that stands once was
    reworded and is kept for audit. Blocks of kind ``noise`` take no part. An empty
    answer is an error; a graph without an answer gives no rows.
    """

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("aligned", T.StringType()), T.StructField("noise", T.BooleanType())])))
    def align(texts: pd.Series, answer: pd.Series) -> pd.Series:
        return pd.Series([[{"aligned": a, "noise": n} for a, n in aligned_blocks([x or "" for x in t], b)] for t, b in zip(texts, answer)])

    body = _stripped(F.coalesce(F.col("answer"), F.lit("")))
    said = answers.select(key, F.when(body != "", body).otherwise(F.raise_error(F.lit("the answer is empty"))).alias("answer"))
    rows = blocks.where("kind <> 'noise'") if "kind" in blocks.columns else blocks
    per = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))).alias("b")).join(said, key)
    out = per.select(key, F.explode(F.arrays_zip(F.col("b.o").alias("o"), align(F.col("b.t"), "answer").alias("x"))).alias("r"))
    return out.select(key, F.col("r.o").alias(order), F.col("r.x.aligned").alias("aligned"), F.col("r.x.noise").alias("noise"))


def body_parts(markdown: str, weights: list[int]) -> list[str]:
    """The text cut into a part for each weight, at the blank line nearest to where the weight would cut."""
    if len(weights) <= 1:
        return [markdown.strip()]
    total = max(sum(weights), 1)
    blank = [m.start() + 2 for m in re.finditer(r"\n\s*\n", markdown)]
    cuts = [0]
    for weight in weights[:-1]:
        target = cuts[-1] + round(len(markdown) * weight / total)
        k = bisect_right(blank, cuts[-1])
        near = bisect_left(blank, target, lo=k)
        choices = blank[max(k, near - 1) : near + 1]  # the last before the target and the first from it on
        cuts.append(min(choices, key=lambda b: abs(b - target), default=target))
    return [markdown[a:b].strip() for a, b in zip(cuts, [*cuts[1:], len(markdown)])]


def note_bodies(answers: DataFrame, key: str, markdown: str = "markdown", weights: str = "weights") -> DataFrame:
    """key, note (from 1), body: one Markdown text dealt to notes by the sizes of their sources. Texts are cut one by one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, note, body, letters = [], [], [], 0
            for row in range(batch.num_rows):
                parts = body_parts(batch.column(1)[row].as_py() or "", [*map(int, batch.column(2)[row].as_py())])
                at += [row] * len(parts)
                note += range(1, len(parts) + 1)
                body += parts
                letters += sum(map(len, parts))
                if letters >= LETTERS:
                    yield dealt(batch, at, note, body)
                    at, note, body, letters = [], [], [], 0
            yield dealt(batch, at, note, body)

    def dealt(batch: pa.RecordBatch, at: list[int], note: list[int], body: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(note, pa.int32()), pa.array(body, pa.string())], names=[key, "note", "body"])

    kinds = T.StructType([answers.schema[key], T.StructField("note", T.IntegerType()), T.StructField("body", T.StringType())])
    return answers.select(key, markdown, weights).mapInArrow(cut, kinds)
