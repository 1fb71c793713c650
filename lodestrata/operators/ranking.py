"""Lexical, vector and heading retrieval, fusion, reranking and evidence packing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions import text as X

K1, B = 1.2, 0.75
#: Weights of the indexed columns: a heading counts ten times (fixed values).
FIELD_WEIGHTS = {"en": 1.0, "cjk": 1.0, "heading": 10.0, "tag": 1.0}
RRF_K = 60
CHANNELS = ["lexical", "semantic", "heading"]


# Suffixes of the published stripper's steps 2 to 4 and what takes their place.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
# End of fixed values.

VOWEL = "(?:[aeiou]|(?<=[^aeiou])y)"
#: At least one and at least two vowel-consonant sequences before a suffix.
SOME = f"^(?:.*{VOWEL}[^aeiou]).*?"
MANY = f"^(?:.*{VOWEL}[^aeiou].*{VOWEL}[^aeiou]).*?"
SHORT = "[^aeiou][aeiouy][^aeiouwxy]"


def _ends(word: Column, rules: dict[str, str], must: str | None) -> Column:
    """The longest suffix of the rules that a word ends in gives way, if what stands before it is as it must be."""
    out = F.when(F.lit(False), word)
    for suffix in sorted(rules, key=len, reverse=True):
        new = F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(rules[suffix]))
        out = out.when(word.endswith(suffix), new if must is None else F.when(word.rlike(f"{must}{suffix}$"), new).otherwise(word))
    return out.otherwise(word)


def porter_stem(word: Column) -> Column:
    """Porter's published suffix stripper as nested expressions; words of one or two letters stay."""
    let = lambda x, f: F.get(F.transform(F.array(x), f), 0)  # evaluates x once

    def inflection(a: Column) -> Column:
        def mend(cut: Column) -> Column:
            return (
                F.when(cut.rlike("(?:at|bl|iz)$"), F.concat(cut, F.lit("e")))
                .when(cut.rlike(r"([^aeioulsz])\1$"), F.substring(cut, F.lit(1), F.length(cut) - 1))
                .when(cut.rlike("^[^aeiou]+[aeiouy][^aeiouwxy]$"), F.concat(cut, F.lit("e")))
                .otherwise(cut)
            )

        mended = let(F.regexp_replace(a, r"(?:ed|ing)$", ""), mend)
        return F.when(a.endswith("eed"), _ends(a, {"eed": "ee"}, SOME)).when(a.rlike("[aeiouy].*(?:ed|ing)$"), mended).otherwise(a)

    def fourth(w: Column) -> Column:
        out = F.when(F.lit(False), w)
        for suffix in sorted(STEP4, key=len, reverse=True):
            fits = w.rlike(f"{MANY}{suffix}$") & (w.rlike("[st]ion$") if suffix == "ion" else F.lit(True))
            out = out.when(w.endswith(suffix), F.when(fits, F.substring(w, F.lit(1), F.length(w) - len(suffix))).otherwise(w))
        return out.otherwise(w)

    def fifth(w: Column) -> Column:
        cut = F.substring(w, F.lit(1), F.length(w) - 1)
        goes = w.rlike(f"{MANY}e$") | (w.rlike(f"{SOME}e$") & ~cut.rlike(f"{SHORT}$"))
        return F.when(w.endswith("e"), F.when(goes, cut).otherwise(w)).when(w.rlike(f"{MANY}l$") & w.endswith("ll"), cut).otherwise(w)

    def stem(w: Column) -> Column:
        a = _ends(w, {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}, None)
        c = let(let(a, inflection), lambda b: F.when(b.rlike("[aeiouy].*y$"), F.regexp_replace(b, "y$", "i")).otherwise(b))
        rest = let(let(let(let(c, lambda x: _ends(x, STEP2, SOME)), lambda x: _ends(x, STEP3, SOME)), fourth), fifth)
        return F.when(F.length(w) > 2, rest).otherwise(w)

    return let(F.lower(word), stem)


def folded(term: Column) -> Column:
    """A Latin term without accents: the letters that Unicode composes of a base letter and a mark."""
    return F.translate(term, ACCENTED, PLAIN)


def _accents() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by Unicode's own decompositions."""
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def postings(blocks: DataFrame, keys: list[str], fields: dict[str, Column]) -> DataFrame:
    """(keys, field, term, tf) from an array of terms per field; terms are counted where they are made."""
    def tag(name: str, terms: Column) -> Column:
        return F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.struct(F.lit(name).alias("field"), t.alias("term")))

    tagged = [tag(name, terms) for name, terms in fields.items()]
    each = blocks.select(*keys, F.explode(F.concat(*tagged)).alias("t"))  # one pass over the texts for all fields
    return each.groupBy(*keys, "t.field", "t.term").agg(F.count("*").alias("tf"))


def index_fields(english: str = "retrieval_text", heading: str = "heading_path", tag: str = "tags") -> dict[str, Column]:
    """Plain terms of the four indexed columns. The CJK vocabulary of a block is that of its own headings and tags."""
    words = lambda c: X.all_matches(F.lower(X.english_text(c)), r"[\p{L}\p{N}]+")
    own = X.cjk_vocabulary(F.concat(F.col(heading), F.col(tag)))
    head, marks = F.array_join(F.col(heading), " / "), F.array_join(F.col(tag), " ")
    return {
        "en": words(F.col(english)),
        "cjk": X.cjk_tokens(F.col(english), own),
        "heading": F.concat(words(head), X.cjk_tokens(head, own)),
        "tag": F.concat(words(marks), X.cjk_tokens(marks, own)),
    }


def stemmed(posts: DataFrame) -> DataFrame:
    """Postings by stem. Each distinct term is stemmed once, not each of its uses."""
    stems = posts.select("term").distinct().withColumn("stem", porter_stem(folded(F.col("term"))))
    keys = [c for c in posts.columns if c not in ("term", "tf")]
    return posts.join(stems, "term").groupBy(*keys, F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def _counted(batch: pa.RecordBatch, keys: list[str], fields: list[str]) -> pa.RecordBatch:
    """A row per distinct term of a batch of blocks, in the order of terms: where it stands and how often."""
    lists = [batch.column(f) for f in fields]
    terms = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    row = np.concatenate([pc.list_parent_indices(x).to_numpy(zero_copy_only=False) for x in lists])
    field = np.repeat(np.arange(len(fields)), [len(x.flatten()) for x in lists])
    by_name = pc.sort_indices(terms.dictionary).to_numpy()
    place = np.empty(len(by_name), np.int64)
    place[by_name] = np.arange(len(by_name))
    width = batch.num_rows * len(fields)
    uses, tf = np.unique(place[terms.indices.to_numpy()] * width + row * len(fields) + field, return_counts=True)
    first = np.searchsorted(uses, np.arange(len(by_name) + 1) * width)
    row, field = uses % width // len(fields), uses % len(fields)
    columns = [*(batch.column(k).take(pa.array(row)) for k in keys), pa.array(fields).take(pa.array(field)), pa.array(tf)]
    at = pa.StructArray.from_arrays(columns, [*keys, "field", "tf"])
    return pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(by_name)), pa.ListArray.from_arrays(pa.array(first, pa.int32()), at)], ["term", "at"])


def stemmed_postings(rows: DataFrame, keys: list[str], fields: list[str], most: int = 2_000_000) -> DataFrame:
    """(keys, field, term, tf) by stem, from columns of terms that are written already.

    Nothing is shuffled for the counts: of some blocks with about ``most`` uses of terms
    in all, each distinct term is counted and stemmed once. A block whose terms
    share a stem has a row for each of them until the rows meet in ranges of the stem.
    """
    terms = [F.coalesce(F.filter(f, lambda t: t.isNotNull()), F.array().cast("array<string>")).alias(f) for f in fields]
    rows = rows.select(*keys, *terms)
    inner = ", ".join(f"`{k}`: {rows.schema[k].dataType.simpleString()}" for k in keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                held.append(batch.slice(start, 1000))
                n += sum(len(held[-1].column(f).flatten()) for f in fields)
                if n >= most:
                    yield _counted(pa.concat_batches(held), keys, fields)
                    held, n = [], 0
        if held:
            yield _counted(pa.concat_batches(held), keys, fields)

    counted = rows.mapInArrow(count, f"term string, at array<struct<{inner}, field: string, tf: bigint>>")
    # stems stand below the explosion, so that they are not made for each use of a term
    posts = counted.withColumn("term", porter_stem(folded(F.col("term")))).select("term", F.explode("at").alias("p")).select(*[f"p.{k}" for k in keys], "p.field", "term", "p.tf")
    return _merged(posts, keys)


def _merged(posts: DataFrame, keys: list[str]) -> DataFrame:
    """Equal postings become one, in ranges of the term and sorted by it. The ranges are found in rows that are written first."""
    from lodestrata.operators.lineage import written

    same = W.partitionBy("term", *keys, "field")
    ranged = written(posts).repartitionByRange("term")
    one = ranged.withColumn("n", F.row_number().over(same.orderBy("tf"))).withColumn("tf", F.sum("tf").over(same)).where("n = 1")
    return one.select(*keys, "field", "term", "tf")


def weighted_length(fields: dict[str, Column], weights: dict[str, float] = FIELD_WEIGHTS) -> Column:
    """A block's length: its terms of each field, weighed; no term has to be counted for it."""
    return reduce(lambda a, f: a + F.coalesce(F.size(fields[f]), F.lit(0)) * F.lit(weights[f]), fields, F.lit(0.0))


def bm25(posts: DataFrame, lengths: DataFrame, query: DataFrame, keys: list[str], weights: dict[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """(query_id, keys, score) for query rows (query_id, term, field).

    Statistics come from all indexed blocks. A block's weighted term frequency is
    saturated against its weighted length. Query terms of one query are few, so they
    are joined to the postings, and no other postings are touched.
    """
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    # the number of blocks and their mean length: one row, joined by a constant
    stats = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("avg_length")).withColumn("one", F.lit(1))
    hit = posts.join(query, ["term", "field"])
    per = hit.groupBy("query_id", "term", *keys).agg(F.sum(F.col("tf") * w[F.col("field")]).alias("wtf"))
    df = per.groupBy("query_id", "term").agg(F.count("*").alias("df"))  # blocks that hold the term in an asked field
    rows = per.join(df, ["query_id", "term"]).join(lengths, keys).withColumn("one", F.lit(1)).join(F.broadcast(stats), "one")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("wtf") * (K1 + 1) / (F.col("wtf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    return rows.groupBy("query_id", *keys).agg(F.round(F.sum(idf * gain), 6).alias("score"))


def top_k(scores: DataFrame, k: int, order: list[str], per: list[str] = ["query_id"]) -> DataFrame:  # noqa: B006
    """The best k rows per query: score, then the tie columns. Adds rank from 1."""
    w = W.partitionBy(*per).orderBy(F.desc("score"), *order)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def l2_normal(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def broken_vectors(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """Vectors with no direction or with numbers that are not finite: a load must refuse, not drop them."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(column, lambda x: x != 0)
    return vectors.where(bad | F.col(column).isNull())


def sound_vector(column: Column, key: Column) -> Column:
    """The vector, or an error that names its key if it has no direction or holds numbers that are not finite."""
    bad = column.isNull() | F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(column, lambda x: x != 0)
    return F.when(bad, F.raise_error(F.concat(F.lit("broken vector: "), key.cast("string")))).otherwise(column)


def nearest(vectors: DataFrame, query: list[float], k: int, order: list[str], column: str = "vector") -> DataFrame:
    """Exact cosine neighbours of one query vector; the query is a constant of the plan, so no join is needed.

    A broken vector is an error that names its row, never a row that ranks or is left out.
    """
    q = l2_normal(F.array(*[F.lit(float(x)) for x in query]))
    v = sound_vector(F.col(column), F.concat_ws("/", *[F.col(c).cast("string") for c in order]))
    return vectors.withColumn("score", F.round(dot(l2_normal(v), q), 6)).orderBy(F.desc("score"), *order).limit(k)


def heading_matches(blocks: DataFrame, prefixes: list[str], k: int, order: list[str] = ["relative_path", "sequence"]) -> DataFrame:  # noqa: B006
    """Blocks by the longest query prefix that one of their headings starts with."""
    heads = F.transform("heading_path", X.normal_heading)
    want = F.array_distinct(F.transform(F.array(*map(F.lit, prefixes)), X.normal_heading))
    fits = F.filter(want, lambda p: (p != "") & F.exists(heads, lambda h: h.startswith(p)))
    scored = blocks.withColumn("score", F.array_max(F.transform(fits, F.length)).cast("double"))
    return scored.where("score > 0").orderBy(F.desc("score"), *order).limit(k)


def fuse(channels: DataFrame, limit: int, keys: list[str], order: list[str], k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of rows (query_id, channel, rank, keys).

    Ranks are places in the channel's list; a block that a channel lists twice counts
    at its first place, later places stay taken. Channels add up in a fixed order.
    """
    first = channels.groupBy("query_id", *keys).pivot("channel", CHANNELS).agg(F.min("rank"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    score = reduce(lambda a, c: a + part(c), CHANNELS, F.lit(0.0))
    out = first.withColumn("score", F.round(score, 9)).withColumn("channels", F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), c) for c in CHANNELS])))
    return top_k(out.drop(*CHANNELS), limit, order)


def rerank(candidates: DataFrame, scores: DataFrame, keep: int = 4) -> DataFrame:
    """Candidates in the reranker's order if its answer is whole and sound, else in fused order, with a status.

    An answer is sound if it scores exactly the candidates of the query, once each, with
    numbers from 0 to 1.
    """
    sent = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list("candidate_id")).alias("sent"))
    back = scores.groupBy("query_id").agg(F.sort_array(F.collect_list("candidate_id")).alias("back"), F.bool_and(F.col("relevance").isNotNull() & ~F.isnan("relevance") & F.col("relevance").between(0, 1)).alias("sane"))
    state = sent.join(back, "query_id", "left").select("query_id", F.when(F.col("back").isNull(), "unavailable").when((F.col("sent") != F.col("back")) | ~F.col("sane"), "invalid").otherwise("applied").alias("status"))
    one = scores.groupBy("query_id", "candidate_id").agg(F.max("relevance").alias("relevance"))
    rows = candidates.join(state, "query_id").join(one, ["query_id", "candidate_id"], "left").withColumn("relevance", F.when(F.col("status") == "applied", F.col("relevance")))
    w = W.partitionBy("query_id").orderBy(F.desc_nulls_last("relevance"), "fused_rank", "candidate_id")
    return rows.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= keep)


def rerank_candidates(ranked: DataFrame, most: int = 20) -> DataFrame:
    """The candidates to send: not blocked, no absolute path in text, headings, kind or tags; numbered, with their fused rank."""
    from lodestrata.functions.paths import holds_absolute_path

    lists = [c for c in ("heading_path", "allowed_tags") if c in ranked.columns]
    leaks = holds_absolute_path(F.coalesce("text", F.lit("")))
    for c in lists:
        leaks = leaks | F.coalesce(F.exists(c, lambda x: F.coalesce(holds_absolute_path(x), F.lit(False))), F.lit(False))
    sound = ranked.where(~leaks)
    if "outbound_allowed" in ranked.columns:
        sound = sound.where("outbound_allowed")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    sent = sound.withColumn("__n", place).where(F.col("__n") <= most)
    return sent.withColumn("fused_rank", F.col("rank")).withColumn("candidate_id", F.format_string("candidate%02d", "__n")).drop("__n")


def expand(hits: DataFrame, blocks: DataFrame, most: int = 8) -> DataFrame:
    """Per query the hits first, then the blocks around each hit that are not yet chosen, a little below its score.

    Without a ``query_id`` all hits are one query's.
    """
    if "query_id" not in hits.columns:
        hits = hits.withColumn("query_id", F.lit(0))
    step = F.explode(F.array(F.lit(0), F.lit(-1), F.lit(1)))
    around = hits.select("query_id", "document_id", "rank", "score", "sequence", step.alias("step")).withColumn("sequence", F.col("sequence") + F.col("step"))
    own = F.col("step") == 0
    asked = around.select("query_id", "document_id", "sequence", F.when(own, 0).otherwise(1).alias("tier"), "rank", F.when(own, 0).otherwise(((F.col("step") + 1) / 2).cast("int")).alias("offset"), F.when(own, F.col("score")).otherwise(F.greatest(F.col("score") - 1e-6, F.lit(0.0))).alias("score"))
    best = asked.groupBy("query_id", "document_id", "sequence").agg(F.min(F.struct("tier", "rank", "offset", "score")).alias("m")).join(blocks, ["document_id", "sequence"])
    w = W.partitionBy("query_id").orderBy("m.tier", "m.rank", "m.offset", "document_id")  # three rows per hit
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("query_id", "place", "document_id", "sequence", "m.tier", "m.rank", "m.offset", "m.score", *[c for c in blocks.columns if c not in ("document_id", "sequence")])


def pack(ranked: DataFrame, most: int = 8, per_block: int = 800, in_all: int = 4000, per: list[str] = ["query_id"]) -> DataFrame:  # noqa: B006
    """Excerpts in rank order until the character budget is used up.

    A fold over each query's ranked rows (as many as the ranking kept): an excerpt is
    what fits of a block's first ``per_block`` characters; blank ones are skipped.
    """
    rows = F.sort_array(F.collect_list(F.struct("place", "document_id", "sequence", "text", "score")))

    def step(acc: Column, r: Column) -> Column:
        room = F.least(F.lit(per_block), F.lit(in_all) - acc["used"])
        cut = F.rtrim(F.substring(F.trim(F.regexp_replace(r["text"], r"\s+", " ")), F.lit(1), room))
        item = F.struct(r["document_id"].alias("document_id"), r["sequence"].alias("sequence"), cut.alias("excerpt"), F.round(r["score"], 6).alias("score"))
        take = (room > 0) & (F.length(cut) > 0) & (F.size(acc["out"]) < most)
        return F.when(take, F.struct((acc["used"] + F.length(cut)).alias("used"), F.concat(acc["out"], F.array(item)).alias("out"))).otherwise(acc)

    kind = ranked.schema["document_id"].dataType.simpleString(), ranked.schema["sequence"].dataType.simpleString()
    start = F.struct(F.lit(0).alias("used"), F.array().cast(f"array<struct<document_id:{kind[0]},sequence:{kind[1]},excerpt:string,score:double>>").alias("out"))
    packed = ranked.groupBy(*per).agg(F.aggregate(rows, start, step, lambda a: a["out"]).alias("evidence"))
    return packed.select(*per, F.posexplode("evidence").alias("place", "e")).select(*per, (F.col("place") + 1).alias("place"), "e.*")


def overlap_score(rows: DataFrame, query: str) -> DataFrame:
    """The retired scorer, kept for comparisons: weighted shares of query terms by field."""
    q = X.query_terms(F.lit(query))
    share = lambda t: F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1))
    words = X.query_terms(F.col("text"))
    jaccard = F.size(F.array_intersect(q, words)) / F.greatest(F.size(F.array_union(q, words)), F.lit(1))
    of = lambda c: share(X.query_terms(F.array_join(F.col(c), " ")))
    score = 4 * share(words) + 2 * jaccard + 2 * of("heading_path") + share(X.query_terms(F.col("relative_path"))) + 1.5 * of("tags") + of("links")
    return rows.withColumn("score", F.round(score, 6))


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of an ordered listing, with the numbers of rows and pages (one page at least)."""
    total = rows.agg(F.count("*").alias("total_rows")).withColumn("pages", F.greatest(F.ceil(F.col("total_rows") / size), F.lit(1))).withColumn("one", F.lit(1))
    shown = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return shown.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").drop("one")


def version_candidates(new: DataFrame, known: DataFrame) -> DataFrame:
    """For each new source the earliest known one of the same label and another content.

    Of a label's contents, the one that is known first and the next one are enough: a new
    source takes the next only where the first is its own content.
    """
    each = known.groupBy(F.lower("label").alias("key"), F.col("content_sha256").alias("other")).agg(F.min(F.struct("created_at", "source_id")).alias("s")).where("other IS NOT NULL")
    first = each.groupBy("key").agg(F.min(F.struct("s", "other")).alias("a"))
    after = each.join(first, "key").where("other <> a.other").groupBy("key").agg(F.min("s").alias("b"))
    two = first.join(after, "key", "left").select("key", F.col("a.s").alias("a"), F.col("a.other").alias("other"), "b")
    fits = F.when(F.col("content_sha256") == F.col("other"), F.col("b")).when(F.col("content_sha256").isNotNull(), F.col("a"))
    best = new.withColumn("key", F.lower("label")).join(two, "key").groupBy("source_id").agg(F.min(fits).alias("s"))
    return new.join(best.select("source_id", F.col("s.source_id").alias("version_of")), "source_id", "left")
