"""Reconciling, versioning, auditing and purging the index, and embedding its blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import text as X
from lodestrata.operators.filters import eligible


def reconcile(files: DataFrame, documents: DataFrame, policy_revision: int) -> DataFrame:
    """One row per path with what to do: index, update, missing or unchanged.

    A file is read again only if its time, its size or the policy revision changed. A
    new path is suspected to be a renamed one if something is missing and its content
    is not among what is missing.
    """
    cur = documents.where("is_current").select("relative_path", F.col("observed_mtime_ns").alias("m0"), F.col("observed_size").alias("s0"), F.col("policy_revision").alias("p0"), F.col("content_sha256").alias("h0"))
    both = files.join(cur, "relative_path", "full_outer")
    action = F.when(F.col("mtime_ns").isNull(), "missing").when(F.col("h0").isNull(), "index").when((F.col("mtime_ns") != F.col("m0")) | (F.col("size") != F.col("s0")) | ~F.col("p0").eqNullSafe(F.lit(policy_revision)), "update").otherwise("unchanged")
    rows = both.withColumn("action", action)
    gone = rows.where("action = 'missing'").select(F.col("h0").alias("content_sha256"), F.lit(True).alias("known")).distinct()
    any_gone = gone.agg((F.count("*") > 0).alias("any_gone")).withColumn("one", F.lit(1))
    out = rows.join(gone, "content_sha256", "left").withColumn("one", F.lit(1)).join(F.broadcast(any_gone), "one")
    return out.select("relative_path", "content_sha256", "action", ((F.col("action") == "index") & F.col("any_gone") & F.col("known").isNull()).alias("pending_association"))


def upsert_versions(documents: DataFrame, incoming: DataFrame, reason: str = "content-changed") -> DataFrame:
    """Type-2 history: a changed document's old row is kept as not current, and the new row is added.

    ``incoming`` has the columns of ``documents``; rows whose content is that of the
    current row change nothing.
    """
    now = documents.where("is_current").select("vault_id", "relative_path", F.col("content_sha256").alias("h0"))
    fresh = incoming.join(now, ["vault_id", "relative_path"], "left").where(F.col("h0").isNull() | (F.col("h0") != F.col("content_sha256"))).select(*documents.columns)
    touched = fresh.select("vault_id", "relative_path", F.lit(True).alias("touched")).distinct()
    old = documents.join(touched, ["vault_id", "relative_path"], "left").withColumn("outdated", F.col("is_current") & F.col("touched").isNotNull())
    old = old.withColumn("stale_reason", F.when(F.col("outdated"), reason).otherwise(F.col("stale_reason"))).withColumn("is_current", F.col("is_current") & ~F.col("outdated"))
    return old.select(*documents.columns).unionByName(fresh)


def merge(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert by key: a change's values win where they are not null."""
    rest = [c for c in table.columns if c not in keys]
    t, c = table.select(*keys, *[F.col(x).alias(f"old_{x}") for x in rest]), changes.select(*keys, *rest)
    return t.join(c, keys, "full_outer").select(*keys, *[F.coalesce(x, f"old_{x}").alias(x) for x in rest])


def invalidate(documents: DataFrame, vectors: DataFrame, path: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """The documents with one path marked stale, and the vectors without that path's."""
    hit = (F.col("relative_path") == path) & F.col("is_current")
    gone = documents.where(hit).select("document_id")
    marked = documents.withColumn("stale_reason", F.when(hit, reason).otherwise(F.col("stale_reason")))
    return marked, vectors.join(gone, "document_id", "left_anti")


def purge(documents: DataFrame, blocks: DataFrame, vectors: DataFrame, cache: DataFrame, paths: DataFrame) -> dict[str, DataFrame]:
    """Removes paths with all their history; cache rows go once no vector refers to them."""
    docs = documents.join(paths.select("relative_path").distinct(), "relative_path", "left_anti")
    keep = docs.select("document_id")
    v = vectors.join(keep, "document_id", "left_semi")
    return {"documents": docs, "blocks": blocks.join(keep, "document_id", "left_semi"), "vectors": v, "cache": cache.join(v.select("input_sha256").distinct(), "input_sha256", "left_semi")}


def resolve_association(documents: DataFrame, path: str, deleted: bool) -> DataFrame:
    """A waiting association ends: the old document is gone, or it counts again."""
    hit = (F.col("relative_path") == path) & F.col("pending_association")
    out = documents.withColumn("stale_reason", F.when(hit & F.lit(deleted), "confirmed-deleted").otherwise(F.col("stale_reason")))
    return out.withColumn("pending_association", F.col("pending_association") & ~hit)


def audit_blocks(blocks: DataFrame) -> DataFrame:
    """(document_id, sequence, code) of each fault; later checks wait for the earlier ones."""
    h = X.block_hash(F.col("text"))
    sound = (F.trim("text") != "") & (F.col("sequence") >= 1) & F.col("location").isNotNull()
    rich = F.col("heading_path").isNotNull() & F.coalesce(F.col("confidence").between(0, 1), F.lit(True)) & (F.col("token_estimate") >= 0)
    body = F.when(F.coalesce("retrieval_text", F.lit("")) != "", F.col("retrieval_text")).otherwise(F.col("text"))
    missing = F.col("block_content_sha256") == ""
    codes = (
        F.when(~sound, F.array(F.lit("legacy-block-invalid")))
        .when(~missing & (F.col("block_content_sha256") != h), F.array(F.lit("block-content-sha256-mismatch")))
        .otherwise(F.array_compact(F.array(
            F.when(missing, "block-content-sha256-missing"),
            F.when(~rich, "rich-block-invalid"),
            F.when(rich & (body != F.col("text")), "text-mismatch"),
        )))
    )
    return blocks.select("document_id", "sequence", F.explode(codes).alias("code"))


def require_sound(blocks: DataFrame) -> DataFrame:
    """The blocks, or an error when any of them has a fault: readers must not see half an index."""
    bad = audit_blocks(blocks).select("document_id", "sequence").distinct().withColumn("bad", F.lit(True))
    out = blocks.join(bad, ["document_id", "sequence"], "left")
    check = F.when(F.col("bad"), F.raise_error(F.lit("the index has inconsistent blocks"))).otherwise(F.lit(True))
    return out.where(check.cast("boolean")).drop("bad")


def backfill(blocks: DataFrame, structure: DataFrame) -> DataFrame:
    """Fills in missing hashes, and graph columns of blocks that have none yet."""
    out = blocks.join(structure.select("document_id", "sequence", F.col("graph_block_id").alias("g1"), F.col("reading_order").alias("o1")), ["document_id", "sequence"], "left")
    plain = F.col("graph_block_id").isNull() & F.col("reading_order").isNull()
    filled = {
        "block_content_sha256": F.when(F.col("block_content_sha256") == "", X.block_hash(F.col("text"))).otherwise(F.col("block_content_sha256")),
        "reading_order": F.when(plain, F.col("o1")).otherwise(F.col("reading_order")),
        "graph_block_id": F.when(plain, F.col("g1")).otherwise(F.col("graph_block_id")),
    }
    return out.withColumns(filled).select(*blocks.columns)  # all from the old values


def resolve_sources(new: DataFrame, known: DataFrame) -> DataFrame:
    """New files as duplicates of a known content, or as new with a suggestion of which version they follow."""
    from lodestrata.operators.ranking import version_candidates

    dup = known.groupBy("content_sha256").agg(F.min_by("source_id", "created_at").alias("same_as"))
    out = new.join(dup, "content_sha256", "left")
    with_version = version_candidates(out, known)
    return with_version.withColumn("identity_status", F.when(F.col("same_as").isNotNull(), "duplicate").otherwise("new")).withColumn("version_of", F.when(F.col("same_as").isNull(), F.col("version_of")))


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rows whose key is not there; repeated inserts change nothing."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def revise(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Appends a decided revision after the latest one of each item."""
    from lodestrata.operators.joins import latest

    last = latest(suggestions, ["item_id"], "revision")
    new = last.drop("decision").join(decisions.select("item_id", "decision"), "item_id").withColumn("revision", F.col("revision") + 1)
    return suggestions.unionByName(new.select(*suggestions.columns))


def snapshot_digest(rows: DataFrame, key: str, value: str, per: str) -> DataFrame:
    """One digest per snapshot of all its parts in key order."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
    return rows.groupBy(per).agg(F.sha2(F.to_json(parts), 256).alias("digest"))


def refresh_snapshots(snapshots: DataFrame, frozen: DataFrame, current: DataFrame) -> DataFrame:
    """Snapshots whose frozen contents differ from the current ones, or whose policy moved on, become invalid."""
    now = current.select("document_id", F.col("content_sha256").alias("now"), F.col("policy_revision").alias("policy_now"))
    drift = frozen.join(now, "document_id", "left").groupBy("snapshot_id").agg(F.bool_or(~F.col("content_sha256").eqNullSafe(F.col("now"))).alias("moved"), F.max("policy_now").alias("policy_now"))
    out = snapshots.join(drift, "snapshot_id", "left")
    reason = F.when(F.col("moved"), "content-changed").when(F.col("policy_now") != F.col("policy_revision"), "policy-changed")
    live = F.col("status").isin("prepared", "preparing", "completed")
    return out.withColumn("invalid_reason", F.when(live, reason)).withColumn("status", F.when(live & reason.isNotNull(), "invalidated").otherwise(F.col("status"))).drop("moved", "policy_now")


#: Vaults of one root that a cell of the pairs holds on either side.
CELL = 4_096
#: Outer vaults that neighbouring rows go through for one inner vault after another. Parquet packs numbers by 8 and, between its
#: marks, by 504; a divisor of both kinds repeats byte by byte in a file, and so takes next to no room.
RUN = 168
#: About so many pairs leave a cell at once.
PAIRS = 1 << 16


def overlapping_roots(vaults: DataFrame) -> DataFrame:
    """Pairs of vaults with equal or nested roots; each root is joined to its ancestors.

    Vaults of one root are all pairs, so the result grows with their square. A root's
    pairs are dealt to tasks in cells of about ``CELL`` vaults by ``CELL``, and leave them
    in batches: no pair is shuffled or held, but for outer vaults with several roots. Rows come
    in an order that takes little room where they are written.
    """
    parts = F.split("root", "/")
    rows = vaults.select("vault_id", F.lower("root_path").alias("root")).where("vault_id IS NOT NULL AND root IS NOT NULL").distinct()
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    inner = rows.select(F.col("vault_id").alias("inner_id"), F.explode(above).alias("root")).distinct()
    outer = rows.join(rows.groupBy("vault_id").agg(F.count("*").alias("roots")), "vault_id").withColumnRenamed("vault_id", "outer_id")
    # an outer vault with one root meets an inner one once
    return _in_cells(inner, outer.where("roots = 1")).unionByName(_in_cells(inner, outer.where("roots > 1")).distinct())


def _in_cells(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """outer_id, inner_id of each two different vaults that meet at a root."""
    cells = lambda df, name: df.groupBy("root").agg(F.ceil(F.count("*") / CELL).alias(name))
    size = cells(inner, "across").join(cells(outer, "down"), "root")
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    listed = lambda c: F.sort_array(F.collect_list(c)).alias(f"{c}s")
    a = inner.join(size, "root").groupBy("root", "down", deal("inner_id", "across").alias("x")).agg(listed("inner_id")).select("root", "x", each("down").alias("y"), "inner_ids")
    b = outer.join(size, "root").groupBy("root", "across", deal("outer_id", "down").alias("y")).agg(listed("outer_id")).select("root", each("across").alias("x"), "y", "outer_ids")
    # few bytes make many pairs, so the number of tasks is given
    n, key = max(200, int(inner.sparkSession.conf.get("spark.sql.shuffle.partitions"))), ["root", "x", "y"]
    both = a.repartition(n, *key).join(b.repartition(n, *key), key).select("outer_ids", "inner_ids")
    kinds = [T.StructField("outer_id", outer.schema["outer_id"].dataType), T.StructField("inner_id", inner.schema["inner_id"].dataType)]
    return both.mapInArrow(_pairs, T.StructType(kinds))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each two different ids of the two lists of a row: ``RUN`` of the first list for one of the second after another."""
    count = lambda n: np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)  # noqa: E731  from 0 for each of n
    for batch in batches:
        (o, outers), (i, inners) = ((c.offsets.to_numpy().astype(np.int64), c.values) for c in batch.columns)
        # tiles of a run of outer ids by so many inner ones
        high = PAIRS // RUN
        down, across = -(np.diff(o) // -RUN), -(np.diff(i) // -high)
        cell, nth = np.repeat(np.arange(len(down)), down * across), count(down * across)
        left, top = o[cell] + nth // across[cell] * RUN, i[cell] + nth % across[cell] * high
        wide, rows = np.minimum(RUN, o[cell + 1] - left), np.minimum(high, i[cell + 1] - top)
        batch_of = (wide * rows).cumsum() // PAIRS
        for part in np.split(np.arange(len(cell)), np.flatnonzero(np.diff(batch_of)) + 1):
            k = rows[part]
            run = np.repeat(wide[part], k)
            x = outers.take(pa.array(np.repeat(np.repeat(left[part], k), run) + count(run)))
            y = inners.take(pa.array(np.repeat(np.repeat(top[part], k) + count(k), run)))
            out, keep = pa.RecordBatch.from_arrays([x, y], names=["outer_id", "inner_id"]), pc.not_equal(x, y)
            yield out if pc.all(keep).as_py() else out.filter(keep)


def cite(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """One citation per evidence that supports an answer paragraph, with the hashes to check it by later."""
    rows = answers.join(evidence, "message_id")
    return rows.where(X.supports(F.col("paragraph"), F.col("excerpt"))).select("message_id", "paragraph_no", "document_id", "sequence", "block_content_sha256", "content_sha256", F.lit("verified").alias("status"))


def reverify(citations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Citations that may be checked again get the state of their block now; others stay as they are."""
    now = blocks.select("document_id", "sequence", F.col("block_content_sha256").alias("now"))
    out = citations.join(now, ["document_id", "sequence"], "left")
    fresh = F.when(F.col("now").isNull(), "unsupported").when(F.col("now") == F.col("block_content_sha256"), "verified").otherwise("stale")
    again = F.col("status").isin("pending-verification", "stale", "unsupported")
    return out.withColumn("status", F.when(again, fresh).otherwise(F.col("status"))).drop("now")


def embed(documents: DataFrame, blocks: DataFrame, cache: DataFrame, profile: str, embedder: Callable[[list[str]], list[list[float]]], batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """(cache, vectors): texts that the cache lacks are embedded once each, in batches, and bound to their blocks.

    Inputs are grouped by hash first, so equal texts cost one call.
    """
    from lodestrata.operators.ranking import l2_normal

    rows = blocks.join(documents.where(eligible()).select("document_id"), "document_id").withColumn("input", X.embedding_input(F.col("contextual_prefix"), F.col("retrieval_text"), F.col("text"))).where("input IS NOT NULL")
    rows = rows.withColumn("input_sha256", X.cache_key(F.lit(profile), F.col("input")))
    known = cache.where(F.col("profile_fp") == profile)
    missing = rows.select("input_sha256", "input").dropDuplicates(["input_sha256"]).join(known.select("input_sha256"), "input_sha256", "left_anti")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"input_sha256": part["input_sha256"], "vector": embedder(part["input"].tolist())})

    new = missing.mapInPandas(call, "input_sha256 string, vector array<float>").withColumn("profile_fp", F.lit(profile)).withColumn("dimension", F.size("vector"))
    full = known.select("input_sha256", "vector", "profile_fp", "dimension").unionByName(new)
    bound = rows.join(full, "input_sha256").select("document_id", "sequence", "profile_fp", "block_content_sha256", "input_sha256", "dimension", l2_normal(F.col("vector")).alias("vector"))
    return full, bound


def bind_vectors(kept: DataFrame, new: DataFrame, documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """The vectors of blocks after ``new`` ones are bound, each with what became of it: kept, bound or the same again.

    kept, new: document_id, sequence, profile_fp, dimension, block_content_sha256,
    input_sha256, vector. A new vector must be for a block of a current document whose
    content and embedding input still have the hashes that the vector was made from, and
    of its profile's one dimension; it is stored at length one, in single precision. Binding what is bound
    already changes nothing. Another vector for a bound block, a block that is gone or
    has changed, and two new vectors for one block are errors.
    """
    from lodestrata.operators.ranking import l2_normal

    key = ["document_id", "sequence", "profile_fp"]
    value = X.embedding_input(F.col("contextual_prefix"), F.col("retrieval_text"), F.col("text"))
    live = blocks.join(documents.where(eligible()).select("document_id"), "document_id", "left_semi")
    live = live.select("document_id", "sequence", F.col("block_content_sha256").alias("now_content"), value.alias("now_input"))
    old = kept.select(*key, F.col("input_sha256").alias("old_input"), F.col("vector").alias("old_vector"), F.col("dimension").alias("old_dimension"))
    sizes = kept.select("profile_fp", "dimension").unionByName(new.select("profile_fp", "dimension")).groupBy("profile_fp").agg(F.count_distinct("dimension").alias("sizes"))
    rows = new.withColumn("vector", l2_normal(F.col("vector")).cast("array<float>")).join(live, ["document_id", "sequence"], "left").join(old, key, "left").join(sizes, "profile_fp")
    again = (F.col("old_input") == F.col("input_sha256")) & (F.col("old_vector") == F.col("vector"))
    bad = (
        F.when(F.count("*").over(W.partitionBy(*key)) > 1, F.raise_error(F.lit("two new vectors for one block")))
        .when((F.col("sizes") > 1) | (F.size("vector") != F.col("dimension")), F.raise_error(F.lit("vectors of a profile need one dimension")))
        .when(F.col("now_content").isNull(), F.raise_error(F.lit("a vector's block is not current")))
        .when((F.col("now_content") != F.col("block_content_sha256")) | ~F.col("input_sha256").eqNullSafe(X.cache_key(F.col("profile_fp"), F.col("now_input"))), F.raise_error(F.lit("a vector's block has changed")))
        .when(F.col("old_input").isNotNull() & ~again, F.raise_error(F.lit("a block has another vector already")))
    )
    state = F.coalesce(bad.cast("string"), F.when(F.coalesce(again, F.lit(False)), "same").otherwise("bound"))
    columns = [*key, "dimension", "block_content_sha256", "input_sha256", "vector"]
    bound = rows.select(*columns, state.alias("state"))
    return kept.withColumn("vector", F.col("vector").cast("array<float>")).join(new.select(*key), key, "left_anti").select(*columns, F.lit("kept").alias("state")).unionByName(bound)
