"""What paths and headings tell of a text: structure, unit numbers, aliases, and prefixes to search headings by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import all_matches, normal_heading

# Words for parts of a book, and Chinese numerals.
UNIT = r"(?i)(?:unit|lesson|chapter|module|part)\s*(\d{1,3})|第\s*([0-9一二三四五六七八九十百]{1,4})\s*(?:单元|[课章节讲])"
NUMERALS = dict(zip("一二三四五六七八九", range(1, 10)))
PARTS = {"unit": ["unit", "单元"], "lesson": ["lesson", "课"], "chapter": ["chapter", "章"], "section": ["section", "节"]}
# End of fixed values.


def chinese_number(text: Column) -> Column:
    """1 to 99 written in Chinese numerals, or null."""
    digits = F.create_map(*[F.lit(x) for kv in NUMERALS.items() for x in kv])
    tens, ones = F.regexp_extract(text, "^([一二三四五六七八九]?)十", 1), F.regexp_extract(text, "十([一二三四五六七八九]?)$", 1)
    whole = F.coalesce(F.try_element_at(digits, tens), F.lit(1)) * 10 + F.coalesce(F.try_element_at(digits, ones), F.lit(0))
    return F.when(text.rlike("^[一二三四五六七八九]?十[一二三四五六七八九]?$"), whole).when(text.rlike("^[一二三四五六七八九]$"), F.try_element_at(digits, text))


def unit_number(text: Column) -> Column:
    """The number of the unit, lesson or chapter that a text names first, in either script; null without one."""
    plain, written = F.regexp_extract(text, UNIT, 1), F.regexp_extract(text, UNIT, 2)
    return F.coalesce(plain.try_cast("int"), written.try_cast("int"), chinese_number(written))


def structure_aliases(text: Column) -> Column:
    """The ways to write the part of a book that a text names: \"unit 3\" and \"第3单元\"."""
    n, low = unit_number(text).cast("string"), F.lower(text)
    found = [F.when(low.rlike("|".join(words)), F.array(F.concat(F.lit(f"{kind} "), n), F.concat(F.lit("第"), n, F.lit(words[1])))) for kind, words in PARTS.items()]
    none = F.array().cast("array<string>")
    return F.when(n.isNull(), none).otherwise(F.coalesce(*found, none))


def heading_prefixes(query: Column) -> Column:
    """Normalised prefixes by which headings are looked up: the aliases, the numbers with dots, and the query itself if short."""
    numbers = all_matches(query, r"\d+(?:\.\d+)+")
    short = F.when(F.length(query) <= 24, F.array(query)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.transform(F.concat(structure_aliases(query), numbers, short), normal_heading)), lambda p: p != "")


def path_metadata(path: Column) -> Column:
    """Struct of folder, name, unit and depth that a relative path states."""
    name = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    folders = F.filter(F.split(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "/"), lambda p: p != "")
    return F.struct(F.coalesce(F.get(folders, 0), F.lit("")).alias("subject"), name.alias("name"), F.coalesce(unit_number(name), unit_number(path)).alias("unit"), F.size(folders).alias("depth"))


def normal_metadata(value: Column) -> Column:
    """A label in one form: trimmed, lower case, one kind of space and of brackets; null for blank."""
    text = F.lower(F.trim(F.regexp_replace(F.translate(value, "（）【】：　", "()[]: "), r"\s+", " ")))
    return F.when(text != "", text)


def resolve_heading_scope(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, document_id, heading, blocks, status: the headings that a query names, by their longest normalised prefix.

    Each heading is joined to the prefixes on its first letters, so no pair of all queries
    and headings is formed. A query with one heading is ``resolved``, with several
    ``ambiguous``, with none ``missing``.
    """
    asked = queries.select("query_id", F.explode(heading_prefixes(F.col("query"))).alias("prefix")).withColumn("first", F.substring("prefix", 1, 2))
    heads = blocks.select("document_id", F.element_at("heading_path", -1).alias("heading")).where("heading IS NOT NULL").groupBy("document_id", "heading").agg(F.count("*").alias("blocks"))
    heads = heads.withColumn("key", normal_heading(F.col("heading"))).withColumn("first", F.substring("key", 1, 2))
    hits = asked.join(heads, "first").where(F.col("key").startswith(F.col("prefix"))).withColumn("score", F.length("prefix"))
    best = hits.groupBy("query_id").agg(F.max("score").alias("score"))
    top = hits.join(best, ["query_id", "score"]).select("query_id", "document_id", "heading", "blocks").distinct()
    n = top.groupBy("query_id").agg(F.count("*").alias("n"))
    out = queries.select("query_id").distinct().join(n, "query_id", "left").join(top, "query_id", "left")
    return out.withColumn("status", F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "resolved").otherwise("ambiguous")).drop("n")


def provenance(text: Column) -> Column:
    """Struct of source path, source hash and kind that a derived note's front matter states; nulls where it states none."""
    from lodestrata.functions.text import frontmatter

    head = frontmatter(text)
    field = lambda n: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{n}:[ \t]*(.*)$", 1), "^[\"']|[\"']$", "")), F.lit(""))
    return F.struct(field("source_path").alias("source_path"), field("source_sha256").alias("source_sha256"), field("document_kind").alias("document_kind"))


def check_sources(notes: DataFrame, files: DataFrame) -> DataFrame:
    """Derived notes with the state of the source they name: missing, changed or verified; notes that name none are native."""
    p = provenance(F.col("text"))
    rows = notes.select("relative_path", p["source_path"].alias("source_path"), p["source_sha256"].alias("stated"))
    now = files.select(F.lower("relative_path").alias("key"), F.col("content_sha256").alias("now"))
    out = rows.withColumn("key", F.lower("source_path")).join(now, "key", "left")
    state = F.when(F.col("source_path").isNull(), "native").when(F.col("now").isNull(), "source-missing").when(F.col("now").eqNullSafe(F.col("stated")), "verified").otherwise("source-changed")
    return out.select("relative_path", "source_path", state.alias("state"))


# Subjects, grades and kinds of material that paths and headings name.
SUBJECTS = ["道德与法治", "语文", "数学", "英语", "物理", "化学", "生物", "历史", "地理"]
GRADE = r"([789七八九])年级([上下])册"
SCOPE_UNIT = r"第\s*([一二三四五六七八九十]+|[0-9]+)\s*单元|(?i:\bunit\s*([0-9]+)\b)"
MATERIALS = {"personal-note": ["个人整理", "个人笔记", "笔记"], "exercise": ["练习题", "练习", "习题"], "workbook": ["教辅", "练习册"], "textbook": ["教材", "课本"]}
# End of fixed values.


def scope_unit(written: Column) -> Column:
    """A unit's number in digits or Chinese numerals; -1 where it is not from 1 to 99."""
    digit = F.create_map(*[F.lit(x) for kv in NUMERALS.items() for x in kv])
    tens, ones = F.substring_index(written, "十", 1), F.regexp_extract(written, "^[^十]*十(.*)$", 1)
    composed = F.when(tens == "", 1).otherwise(F.coalesce(F.try_element_at(digit, tens), F.lit(1))) * 10 + F.coalesce(F.try_element_at(digit, ones), F.lit(0))
    n = F.when(written.rlike("^[0-9]+$"), F.coalesce(written.try_cast("int"), F.lit(-1))).when(F.contains(written, F.lit("十")), composed).otherwise(F.coalesce(F.try_element_at(digit, written), F.lit(-1)))
    return F.when(n.between(1, 99), n).otherwise(-1)


def scope_metadata(path: Column, headings: Column) -> Column:
    """Struct of subject, grade_volume, unit_no, material_type, scope_status and reason, from a relative path's folders and the headings.

    Everything that the labels name counts. Two values of one field close the scope:
    nothing is kept, and the reason names the first such field. A scope is ``resolved``
    with subject, grade and unit, else ``recoverable``; without any label it is
    ``unknown``. A path that is not relative and in one form, a blank heading, and a
    unit that is not from 1 to 99 are ``refused``, with the reason.
    """
    parts = F.split(path, "/")
    labels = F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), headings)
    every = lambda pattern, group: F.flatten(F.transform(labels, lambda x: F.regexp_extract_all(x, F.lit(pattern), group)))
    named = lambda words: F.exists(labels, lambda x: x.rlike("|".join(words)))
    some = lambda pairs: F.array_compact(F.array(*[F.when(named(words), F.lit(label)) for label, words in pairs]))
    fields = {
        "subject": some([(s, [s]) for s in SUBJECTS]),
        "grade_volume": F.array_distinct(F.zip_with(F.transform(every(GRADE, 1), lambda g: F.translate(g, "789", "七八九")), every(GRADE, 2), lambda g, t: F.concat(g, F.lit("年级"), t, F.lit("册")))),
        "unit_no": F.array_distinct(F.transform(F.zip_with(every(SCOPE_UNIT, 1), every(SCOPE_UNIT, 2), lambda a, b: F.when(b != "", b).otherwise(a)), scope_unit)),
        "material_type": some(list(MATERIALS.items())),
    }
    one = {n: F.when(F.size(v) == 1, F.get(v, 0)) for n, v in fields.items()}
    odd_path = path.isNull() | (path == "") | F.contains(path, F.lit("\\")) | F.exists(parts, lambda p: p.isin("", ".", ".."))
    refused = F.when(odd_path, "path-not-normalised").when(headings.isNull() | F.exists(headings, lambda h: h.isNull() | (F.trim(h) == "")), "blank-heading").when(F.array_contains(fields["unit_no"], -1), "unit-out-of-range")
    conflict = F.coalesce(*[F.when(F.size(v) > 1, F.lit("conflicting-" + n.replace("_", "-"))) for n, v in fields.items()])
    stop = F.coalesce(refused, conflict)
    whole = one["subject"].isNotNull() & one["grade_volume"].isNotNull() & one["unit_no"].isNotNull()
    any_ = whole | F.coalesce(*[one[n].cast("string") for n in one]).isNotNull()
    status = F.when(refused.isNotNull(), "refused").when(conflict.isNotNull(), "recoverable").when(whole, "resolved").when(any_ | (F.size(labels) > 0), "recoverable").otherwise("unknown")
    reason = F.coalesce(stop, F.when(whole, "explicit-scope").when(any_, "incomplete-scope").otherwise("scope-not-explicit"))
    return F.struct(*[F.when(stop.isNull(), v).alias(n) for n, v in one.items()], status.alias("scope_status"), reason.alias("reason"))


def rule_metadata(blocks: DataFrame, path: str = "relative_path") -> DataFrame:
    """document_id, sequence and the metadata that rules give a block: accepted at 0.95 where the scope is resolved, else to be checked."""
    rows = blocks.select("document_id", "sequence", scope_metadata(F.col(path), F.col("heading_path")).alias("m"))
    good = F.col("m.scope_status") == "resolved"
    return rows.select("document_id", "sequence", "m.subject", "m.grade_volume", "m.unit_no", "m.material_type", F.lit("rule").alias("meta_origin"), F.when(good, 0.95).alias("meta_confidence"), F.when(good, "accepted").otherwise("required-check").alias("meta_status"))
