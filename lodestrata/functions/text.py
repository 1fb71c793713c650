"""Scalar text functions as Column expressions, so that they stay in generated code."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character ranges, markers and word lists that results depend on.
CJK = r"㐀-鿿豈-﫿"
LATIN_TERM = r"[A-Za-z0-9]+(?:[_'-][A-Za-z0-9]+)*"
INTENT_MARKERS = {
    "completeness": ["全部", "所有", "整章", "整册", "完整", "清单", "列出", "every "],
    "deep-creation": ["深度创作", "创作", "写文章", "撰写", "draft", "write an"],
    "knowledge-organization": ["知识整理", "整理", "总结", "归纳", "知识点", "默写", "复习"],
}
TOPIC_MARKERS = ["重点", "核心", "要点", "关键", "概念与方法", "概念和方法", "知识框架", "知识点", "主题概览", "key concepts", "core concepts", "key decisions and risks", "key decisions", "key points", "overview"]
QUESTION_MARKERS = ["什么", "怎么", "如何", "为何", "为什么", "?", "？"]
KIND_MARKERS = {
    "grammar": ["grammar", "语法"],
    "vocabulary": ["vocabulary", "words and expressions", "词汇", "单词表"],
    "phrase": ["phrases", "phrase", "短语"],
    "sentence-pattern": ["sentence patterns", "sentence pattern", "句型", "句式"],
    "exercise": ["exercises", "exercise", "练习", "习题"],
}
DOMAIN_KEYWORDS = {
    "mathematics": ["algebra", "equation", "geometry", "calculus", "math", "数学", "代数"],
    "language": ["english", "vocabulary", "grammar", "language", "英语", "词汇", "语法"],
    "science": ["physics", "chemistry", "biology", "science", "物理", "化学", "生物"],
    "history": ["history", "historical", "历史"],
    "technology": ["programming", "software", "code", "技术", "编程"],
}
GENERIC_CONCEPTS = ["and", "check", "concept", "description", "dialogue", "exercise", "exercises", "focus", "form", "forms", "guide", "lesson", "note", "notes", "of", "order", "practice", "practices", "review", "verb"]
ABSOLUTE_PATH = (
    r"(?i)file://[^\s\"'`]+|\\\\\?\\(?:[a-z]:\\|unc\\)|\\\\[^\\/\s\"'`]+[\\/][^\\/\s\"'`]+|(?<![a-z0-9_])[a-z]:[\\/]"
    r"|(?<![a-z0-9_\\])\\(?![\\?])[^\\/\s\"'`]+(?:[\\/][^\\/\s\"'`]+)*|(?<![a-z0-9_:/])/[^\s/\"'`]+(?:/[^\s/\"'`]+)*"
)
# End of fixed values.

IMAGE = r"!\[\[[^\]]+\]\]|!\[[^\]]*\]\([^)]+\)"


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)


def any_marker(text: Column, markers: list[str]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def cjk_runs(text: Column, least: int = 2) -> Column:
    return all_matches(text, f"[{CJK}]{{{least},}}")


def cjk_vocabulary(values: Column) -> Column:
    """Distinct CJK runs of two letters or more in an array of texts, the longest first, then by code point."""
    runs = F.array_distinct(F.flatten(F.transform(values, lambda v: cjk_runs(v))))
    return F.transform(F.array_sort(F.transform(runs, lambda r: F.struct((-F.length(r)).alias("n"), r.alias("r")))), lambda s: s["r"])


def cjk_tokens(text: Column, vocabulary: Column) -> Column:
    """Longest vocabulary words, and overlapping bigrams where none fits.

    A fold over the places of each run: the state holds where the next token starts.
    """

    def run_tokens(run: Column) -> Column:
        def step(acc: Column, at: Column) -> Column:
            fits = F.filter(vocabulary, lambda v: (F.length(v) >= 2) & (F.substring(run, at, F.length(v)) == v))
            word = F.get(fits, 0)
            bigram = F.when(at < F.length(run), F.substring(run, at, F.lit(2)))
            token = F.coalesce(word, bigram)
            return F.when(at < acc["next"], acc).otherwise(
                F.struct((at + F.coalesce(F.length(word), F.lit(1))).alias("next"), F.when(token.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(token))).alias("out"))
            )

        start = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.length(run)), start, step, lambda a: a["out"])

    return F.flatten(F.transform(cjk_runs(text, 1), run_tokens))


def english_text(text: Column) -> Column:
    return F.regexp_replace(text, f"[{CJK}]+", " ")


def english_terms(text: Column) -> Column:
    """Distinct Latin terms in lower case, in order of first use."""
    return F.array_distinct(F.transform(all_matches(text, LATIN_TERM), F.lower))


def query_terms(text: Column) -> Column:
    """Distinct Latin runs and single CJK letters, in order of first use."""
    return F.array_distinct(F.transform(all_matches(text, r"[A-Za-z0-9]+|[一-鿿]"), F.lower))


def query_intent(text: Column) -> Column:
    low = F.lower(text)
    question = any_marker(low, QUESTION_MARKERS) | low.rlike(r"\b(?:what|how|why|where|when|which)\b")
    return (
        F.when(any_marker(low, INTENT_MARKERS["completeness"]) | low.rlike(r"\ball\b"), "completeness")
        .when(any_marker(low, INTENT_MARKERS["deep-creation"]), "deep-creation")
        .when(any_marker(low, INTENT_MARKERS["knowledge-organization"]) | (any_marker(low, TOPIC_MARKERS) & ~question), "knowledge-organization")
        .otherwise("source-lookup")
    )


def knowledge_kind(headings: Column) -> Column:
    """The first kind whose marker stands in the joined heading path."""
    text, out = F.lower(F.array_join(headings, " / ")), None
    for kind, markers in KIND_MARKERS.items():
        out = F.when(any_marker(text, markers), kind) if out is None else out.when(any_marker(text, markers), kind)
    return out.otherwise("other")


def domain_of(text: Column) -> Column:
    """Struct of domain, confidence and whether a person must check it."""
    low, name = F.lower(text), None
    for domain, words in DOMAIN_KEYWORDS.items():
        name = F.when(any_marker(low, words), domain) if name is None else name.when(any_marker(low, words), domain)
    name = F.coalesce(name, F.lit("unclassified"))
    sure = F.when(name == "unclassified", 0.4).otherwise(0.9)
    return F.struct(name.alias("domain"), sure.alias("confidence"), (sure < 0.75).alias("needs_review"))


def normal_heading(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def block_hash(text: Column) -> Column:
    """sha256 of the text with one kind of line end and no white space around it."""
    lines = F.regexp_replace(text, "\r\n?", "\n")
    return F.sha2(F.regexp_replace(lines, r"(?U)^\s+|\s+$", ""), 256)


def strip_images(text: Column) -> Column:
    return F.regexp_replace(text, IMAGE, "")


def embedding_input(prefix: Column, retrieval: Column, text: Column) -> Column:
    """What a block's vector is made of; null if nothing but images is left."""
    clean = lambda c: F.trim(strip_images(F.coalesce(c, F.lit(""))))
    body = F.when(clean(retrieval) != "", clean(retrieval)).otherwise(clean(text))
    return F.when(body != "", F.concat_ws("\n\n", F.when(clean(prefix) != "", clean(prefix)), body))


def cache_key(profile: Column, value: Column) -> Column:
    return F.sha2(F.concat(profile.cast("binary"), F.lit(b"\x00"), value.cast("binary")), 256)


def token_estimate(text: Column) -> Column:
    """CJK runs count a token per letter, words one per four letters, other signs one each.

    A word's tokens are its stretches of up to four letters, so texts without CJK letters
    are one count of matches.
    """
    tokens = all_matches(text, rf"[{CJK}぀-ヿ가-힯]+|[A-Za-z0-9_]+|[^\s]")
    cost = lambda t: F.when(t.rlike(r"[㐀-힯]"), F.length(t)).when(t.rlike(r"^[\p{L}\p{N}_]+$"), F.ceil(F.length(t) / 4)).otherwise(1).cast("int")
    plain = F.regexp_count(text, F.lit(r"[A-Za-z0-9_]{1,4}|[^\s]"))
    return F.when(text.rlike(f"[{CJK}぀-ヿ가-힯]"), F.aggregate(tokens, F.lit(0), lambda a, t: a + cost(t))).otherwise(plain)


def provider_token_estimate(text: Column) -> Column:
    """Words count one per three letters, all other signs, CJK letters among them, one each."""
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9_]{1,3}|[^\s]"))


def context_prefix(headings: Column) -> Column:
    return F.when(F.size(headings) > 0, F.concat(F.lit("["), F.array_join(headings, " · "), F.lit("]"))).otherwise("")


def excerpt(text: Column, most: int) -> Column:
    return F.rtrim(F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most))


def search_excerpt(text: Column, needle: Column, before: int = 90, after: int = 160) -> Column:
    """The stretch around the first match, or the start where nothing matches."""
    at = F.position(F.lower(needle), F.lower(text))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at == 0, F.substring(text, 1, before + after)).otherwise(F.substring(text, start, at - start + after))


def evidence_location(headings: Column, location: Column) -> Column:
    """Struct of the heading and the page that a location names; the document's first heading stands in for a missing one."""
    named = F.trim(F.regexp_extract(location, r"(?i)heading:\s*([^;]+)", 1))
    page = F.regexp_extract(location, r"(?i)page:\s*(\d+)", 1).try_cast("int")
    return F.struct(F.coalesce(F.nullif(named, F.lit("")), F.get(headings, 0)).alias("heading"), F.when(page > 0, page).alias("page"))


def top_source_link(text: Column, source_path: Column) -> Column:
    """Whether a link to the source stands in the first two lines that are neither blank nor headings."""
    body = F.split(F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---\r?\n", ""), r"\r\n|[\n\r]")
    told = F.slice(F.filter(F.transform(body, lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^\s{0,3}#{1,6}\s+")), 1, 2)
    return F.coalesce(F.exists(told, lambda x: F.array_contains(wiki_links(x), source_path)), F.lit(False))


def wiki_links(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)"), 1), lambda x: F.trim(x)), lambda x: x != ""))


def frontmatter(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n", 1)


def tags(text: Column) -> Column:
    """Tags of the front matter: an inline list, or lines of a block list; a malformed inline list gives none."""
    head = frontmatter(text)
    inline = F.trim(F.regexp_extract(head, r"(?m)^tags:[ \t]*(\S.*)$", 1))
    bare = lambda t: F.regexp_replace(F.regexp_replace(F.trim(t), "^\"|\"$", ""), "^'|'$", "")
    listed = F.transform(F.split(F.regexp_extract(inline, r"^\[(.*)\]$", 1), ","), bare)
    block = F.regexp_extract(F.concat(head, F.lit("\n")), r"(?m)^tags:[ \t]*\r?\n((?:  .*\r?\n|\r?\n)*)", 1)
    lines = F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^  - (.*)$"), 1), lambda t: F.regexp_replace(F.trim(t), '^"|"$', ""))
    found = F.when(inline.rlike(r"^\[.*\]$"), listed).when(inline != "", F.array().cast("array<string>")).otherwise(lines)
    return F.array_distinct(F.filter(found, lambda t: t != ""))


def heading_locations(text: Column) -> Column:
    """line:n of each heading line; fences make no difference here."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda line, k: F.struct((k + 1).alias("n"), line.alias("line")))
    return F.transform(F.filter(lines, lambda s: s["line"].rlike(r"^\s{0,3}#{1,6}\s+")), lambda s: F.concat(F.lit("line:"), s["n"].cast("string")))


def stem(word: Column) -> Column:
    return F.when((F.length(word) > 3) & word.endswith("ies"), F.concat(F.substring(word, F.lit(1), F.length(word) - 3), F.lit("y"))).when((F.length(word) > 3) & word.endswith("s"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def concept_terms(heading: Column) -> Column:
    """Stemmed Latin words and CJK runs of a heading without generic words, sorted."""
    words = F.transform(all_matches(F.lower(heading), "[a-z0-9]+"), stem)
    found = F.array_union(words, all_matches(heading, r"[一-鿿]{2,}"))
    return F.coalesce(F.array_sort(F.array_except(found, F.array(*map(F.lit, GENERIC_CONCEPTS)))), F.array().cast("array<string>"))


def safe_name(text: Column, fallback: Column | None = None, suffix: Column | None = None) -> Column:
    """A file name of plain signs in lower case; ``fallback`` for one that has none, and ``suffix`` at its end, once."""
    name = F.lower(F.regexp_replace(F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._㐀-鿿-]+", "-"), r"^[.-]+|[.-]+$", ""))
    if fallback is not None:
        name = F.coalesce(F.nullif(name, F.lit("")), fallback)
    if suffix is not None:
        name = F.when((suffix != "") & ~name.endswith(F.lower(suffix)), F.concat(name, F.lower(suffix))).otherwise(name)
    return name


def note_stem(title: Column) -> Column:
    """A title as a file name: signs that file systems refuse become hyphens, white space one space; never empty."""
    plain = F.regexp_replace(F.regexp_replace(title, r'[<>:"/\\|?*\x00-\x1f]', "-"), r"\s+", " ")
    return F.coalesce(F.nullif(F.regexp_replace(plain, r"^[ .]+|[ .]+$", ""), F.lit("")), F.lit("内容"))


def unique_names(titles, key: str, order: str, title: str, taken: Column | None = None):
    """(key, order, name): a name for each title, in order; a name that is taken, case aside, gets the next free number.

    A fold over one document's titles: a number may be taken by a title that holds it. Names
    that are equal but for case and numbers at their end are folded by themselves, as they
    stream by; only the next number of each is remembered.
    """
    numbers, last = re.compile(r"(?: \([0-9]+\))+\Z"), re.compile(r"(.*) \(([1-9][0-9]*)\)", re.S)

    @F.arrow_udf(T.StringType())
    def bare(stems: pa.Array) -> pa.Array:
        return pa.array([numbers.sub("", s.casefold()) for s in stems.to_pylist()], pa.string())

    def number(batches):
        at, after = None, {}  # the next number of each name that is taken
        for batch in batches:
            of, _, base, stems, used = batch.columns
            names = []
            for group, stem, gone in zip(zip(of.to_pylist(), base.to_pylist()), stems.to_pylist(), used.to_pylist()):
                if group != at:
                    at, after = group, {u.casefold(): 2 for u in gone or []}
                name = stem.casefold()
                m = last.fullmatch(name)
                if name not in after and not (m and 2 <= int(m[2]) < after.get(m[1], 0)):
                    after[name] = 2
                    names.append(stem)
                    continue
                n = after.get(name, 2)
                while f"{name} ({n})" in after:
                    n += 1
                after[name] = n + 1
                names.append(f"{stem} ({n})")
            yield pa.RecordBatch.from_arrays([of, batch.column(1), pa.array(names, pa.string())], names=[key, order, "name"])

    used = taken if taken is not None else F.array().cast("array<string>")
    rows = titles.select(F.col(key), F.col(order), note_stem(F.col(title)).alias("__stem"), used.alias("__used"))
    rows = rows.select(F.col(key), F.col(order), bare("__stem").alias("__base"), "__stem", "__used")
    kinds = T.StructType([titles.schema[key], titles.schema[order], T.StructField("name", T.StringType())])
    return rows.repartition(key, "__base").sortWithinPartitions(key, "__base", order, "__stem").mapInArrow(number, kinds)


def column_letters(index: Column) -> Column:
    """0 is A, 25 is Z, 26 is AA; up to three letters."""
    letter = lambda n: F.char(n + 65)
    return (
        F.when(index < 26, letter(index))
        .when(index < 702, F.concat(letter(F.floor(index / 26) - 1), letter(index % 26)))
        .otherwise(F.concat(letter(F.floor((index - 702) / 676)), letter(F.floor((index - 702) / 26) % 26), letter((index - 702) % 26)))
    )


def join_wrapped(lines: Column) -> Column:
    """Joins wrapped lines: a hyphen at the line end goes, and no space comes between CJK letters."""

    def step(acc: Column, line: Column) -> Column:
        a, b = F.rtrim(acc), F.ltrim(line)
        return (
            F.when(a == "", b)
            .when(a.rlike(r"[A-Za-z]-$") & b.rlike("^[a-z]"), F.concat(F.regexp_replace(a, "-$", ""), b))
            .when(a.rlike(f"[{CJK}]$") & b.rlike(f"^[{CJK}]"), F.concat(a, b))
            .otherwise(F.concat_ws(" ", a, b))
        )

    return F.aggregate(lines, F.lit(""), step)


def compare_key(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def supports(answer: Column, evidence: Column) -> Column:
    """Whether an answer stands in the evidence, white space and case aside."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    return F.contains(bare(evidence), bare(answer))


def conversation_queries(turns, key: str, current: Column | None = None, most: int = 3, size: int = 160):
    """(key, query): a conversation's latest questions in order, each cut to ``size``.

    A ``current`` message is one of them, the last; one that names a heading by itself
    (a number with dots, or a unit) stands alone, as what was asked before would mislead.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(F.desc("turn"))
    keep = most - (current is not None)
    last = turns.where("role = 'user'").withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("turn", excerpt(F.col("text"), size).alias("t")))), lambda s: s["t"])
    out = last.groupBy(key).agg(F.array_join(parts, " ").alias("query"))
    if current is None:
        return out
    explicit = current.rlike(r"\d+(?:\.\d+)+|(?i)\b(?:unit|lesson|chapter)\s*\d+|第.{1,4}(?:单元|[课章节])")
    return out.withColumn("query", F.when(explicit, excerpt(current, size)).otherwise(F.concat_ws(" ", "query", excerpt(current, size))))


def string_list(json: Column) -> Column:
    """A JSON list of texts; anything else counts as no list."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def float32_vector(packed: Column, dimension: Column) -> Column:
    """Little-endian 32-bit floats; null for a wrong length or numbers that are not finite."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(T.ArrayType(T.FloatType()))
    def unpack(raw, size):
        import numpy as np
        import pandas as pd

        out = [np.frombuffer(b, "<f4") if b is not None and n is not None and len(b) == 4 * n else None for b, n in zip(raw, size)]
        return pd.Series([v if v is not None and np.isfinite(v).all() else None for v in out], dtype=object)

    return unpack(packed, dimension)
