"""Units of a document grouped into notes: a split from the top, a recombination from below, and edits of the result.

Units are rows (key, ordinal, kind, text). Sections and sub-sections are running counts
of the headings at which a cut is safe; only the recombination, where each note's size
decides where the next begins, is a fold, over the sizes of a document's fragments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Characters of a note, kinds that are never cut, how questions and answers begin.
LEAST, MOST = 4_000, 8_000
WHOLE = ["list-item", "table-row", "table-cell", "question-answer"]
QUESTION = r"(?i)^(?:q(?:uestion)?[.:]|[0-9]+[.)])\s*"
ANSWER = r"(?i)^(?:a(?:nswer)?[.:])\s*"
# End of fixed values.


def safe_before(key: str) -> Column:
    """Whether a note may begin at a row: not inside lists, tables or Q/A units, nor between a question and its answer."""
    w = W.partitionBy(key).orderBy("ordinal")
    kind, text = F.lag("kind").over(w), F.lag("text").over(w)
    asks = text.rlike(QUESTION) | F.rtrim(text).endswith("?")
    return kind.isNotNull() & ~kind.isin(WHOLE) & ~F.col("kind").isin(WHOLE) & ~(asks & F.col("text").rlike(ANSWER))


def _combined(sizes: Column) -> Column:
    """The number of the note for each fragment: notes close between LEAST and MOST characters."""
    start = F.struct(F.lit(1).alias("note"), F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, n: Column) -> Column:
        new = (a["held"] >= LEAST) & (a["held"] + n > MOST)
        note = a["note"] + new.cast("int")
        return F.struct(note.alias("note"), (F.when(new, F.lit(0)).otherwise(a["held"]) + n).alias("held"), F.concat(a["out"], F.array(note)).alias("out"))

    # a last note that stays too small joins the one before it
    return F.aggregate(sizes, start, step, lambda a: F.transform(a["out"], lambda x: F.when((a["held"] < LEAST) & (a["note"] > 1) & (x == a["note"]), x - 1).otherwise(x)))


def default_notes(units: DataFrame, key: str) -> DataFrame:
    """The units with ``note``, from 1 in order.

    A document of up to 8,000 characters is one note. A larger one is cut at its headings
    of the first two levels, sections over the size at their lower headings too, and the
    fragments are put together again, in order, to between 4,000 and 8,000 characters. A
    note over 8,000 holds a fragment that has no safe cut, or one after a note too small
    to close.
    """
    w = W.partitionBy(key).orderBy("ordinal")
    rows = units.withColumn("size", F.length(F.coalesce("text", F.lit("")))).withColumn("safe", safe_before(key))
    main = F.col("safe") & F.col("kind").isin("heading", "heading-1", "heading-2")
    rows = rows.withColumn("section", F.sum(main.cast("int")).over(w)).withColumn("total", F.sum("size").over(W.partitionBy(key)))
    rows = rows.withColumn("in_section", F.sum("size").over(W.partitionBy(key, "section")))
    lower = F.col("safe") & F.col("kind").startswith("heading-") & ~F.col("kind").isin("heading-1", "heading-2")
    first = F.lag("section").over(w) != F.col("section")
    cut = (F.col("total") > MOST) & (F.coalesce(first, F.lit(False)) | (lower & (F.col("in_section") > MOST)))
    rows = rows.withColumn("fragment", F.sum(cut.cast("int")).over(w))
    sizes = rows.groupBy(key, "fragment").agg(F.sum("size").alias("size"))
    per = sizes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("fragment", "size"))).alias("f"))
    notes = per.select(key, F.explode(F.arrays_zip(F.col("f.fragment").alias("fragment"), _combined(F.col("f.size")).alias("note"))).alias("x")).select(key, "x.*")
    return rows.join(notes, [key, "fragment"]).select(*units.columns, "note")


def note_sizes(notes: DataFrame, key: str) -> DataFrame:
    return notes.groupBy(key, "note").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count("*").alias("units"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters"))


def merge_notes(notes: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """(units with their new note, and ``refused``): the note ``before`` of each edit and its successor become one.

    At most one edit per key. An edit that names no two adjacent notes is refused: the
    key's rows stay as they are and ``refused`` says why; it is null elsewhere.
    """
    last = notes.groupBy(key).agg(F.max("note").alias("last"))
    rows = notes.join(last.join(edits.select(key, "before"), key, "left"), key)
    good = F.col("before").isNotNull() & (F.col("before") >= 1) & (F.col("before") < F.col("last"))
    return _edited(rows, notes.columns, good, F.when(F.col("note") > F.col("before"), F.col("note") - 1).otherwise(F.col("note")), F.when(F.col("before").isNotNull() & ~good, "no-adjacent-note"))


def split_notes(notes: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """(units with their new note, and ``refused``): the note ``sequence`` of each edit ends at unit ``after``.

    Refused where the unit is not inside the note, is its last, or no cut is safe behind it.
    """
    spans = notes.withColumn("safe", safe_before(key)).groupBy(key, F.col("note").alias("sequence")).agg(F.sort_array(F.collect_list(F.struct("ordinal", "safe"))).alias("u"))
    known = edits.select(key, "sequence", "after").join(spans, [key, "sequence"], "left")
    at = F.array_position(F.col("u.ordinal"), F.col("after"))  # 0 or null where the unit is elsewhere
    why = F.when(F.col("u").isNull(), "no-such-note").when((F.coalesce(at, F.lit(0)) == 0) | (at == F.size("u")), "no-boundary-there").when(~F.get("u", at.cast("int"))["safe"], "unsafe-boundary")
    rows = notes.join(known.select(key, "sequence", "after", why.alias("why")), key, "left")
    good = F.col("sequence").isNotNull() & F.col("why").isNull()
    later = (F.col("note") > F.col("sequence")) | ((F.col("note") == F.col("sequence")) & (F.col("ordinal") > F.col("after")))
    return _edited(rows, notes.columns, good, F.col("note") + later.cast("int"), F.col("why"))


def _edited(rows: DataFrame, columns: list[str], good: Column, note: Column, refused: Column) -> DataFrame:
    return rows.select(*[c for c in columns if c != "note"], F.when(good, note).otherwise(F.col("note")).alias("note"), refused.alias("refused"))


def safe_splits(notes: DataFrame, key: str) -> DataFrame:
    """key, note, after: the units behind which a note may be split."""
    w = W.partitionBy(key, "note").orderBy("ordinal")
    rows = notes.withColumn("safe", safe_before(key))
    return rows.withColumn("next_safe", F.lead("safe").over(w)).where("next_safe").select(key, "note", F.col("ordinal").alias("after"))
