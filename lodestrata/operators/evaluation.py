"""Recall, precision, reciprocal rank and gates over golden queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.operators.ranking import fuse


def covered(actual: Column, expected: Column) -> Column:
    """Share of the expected that is there; with nothing expected, 1 only if nothing is there."""
    return F.when(F.size(expected) == 0, (F.size(actual) == 0).cast("double")).otherwise(F.size(F.array_intersect(actual, expected)) / F.size(F.array_distinct(expected)))


def precise(actual: Column, expected: Column) -> Column:
    return F.when(F.size(actual) == 0, (F.size(expected) == 0).cast("double")).otherwise(F.size(F.array_intersect(actual, expected)) / F.size(F.array_distinct(actual)))


def cluster_pairs(clusters: Column) -> Column:
    """Unordered pairs inside each cluster, as texts; clusters are given by hand and small."""
    pair = lambda c: F.flatten(F.transform(c, lambda a: F.transform(F.filter(c, lambda b: a < b), lambda b: F.concat_ws(" ", a, b))))
    return F.array_distinct(F.flatten(F.transform(clusters, pair)))


def query_metrics(queries: DataFrame, predictions: DataFrame) -> DataFrame:
    """Five scores per query: all 0 for a wrong status, all 1 or 0 where nothing may be answered."""
    p = queries.join(predictions, "query_id")
    empty = (F.size("retrieved_block_ids") == 0) & (F.size("scoped_block_ids") == 0) & (F.size("duplicate_clusters") == 0)
    found, want = cluster_pairs(F.col("duplicate_clusters")), cluster_pairs(F.col("expected_clusters"))
    scores = {
        "recall": covered(F.col("retrieved_block_ids"), F.col("expected_block_ids")),
        "precision": precise(F.col("retrieved_block_ids"), F.col("expected_block_ids")),
        "scope_coverage": covered(F.col("scoped_block_ids"), F.col("scope_block_ids")),
        "duplicate_precision": precise(found, want),
        "duplicate_recall": covered(found, want),
    }
    final = lambda s: F.when(F.col("scope_status") != F.col("expected_status"), 0.0).when(F.col("expected_status") == "recoverable", empty.cast("double")).otherwise(s)
    return p.select("query_id", *[final(s).alias(n) for n, s in scores.items()])


def recall_at(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Recall, precision and reciprocal rank at k of ranked rows (query_id, item_id, rank)."""
    top = results.where(F.col("rank") <= k)
    hits = top.join(relevant, ["query_id", "item_id"]).groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"))
    base = relevant.groupBy("query_id").agg(F.count("*").alias("relevant")).join(top.groupBy("query_id").agg(F.count("*").alias("shown")), "query_id", "left").join(hits, "query_id", "left").na.fill(0, ["shown", "hits"])
    return base.select("query_id", (F.col("hits") / F.col("relevant")).alias("recall"), F.when(F.col("shown") > 0, F.col("hits") / F.col("shown")).otherwise(0.0).alias("precision"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def calibrate_fusion(channels: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (20, 60, 100), at: int = 8) -> DataFrame:
    """Mean recall of the fusion for several constants."""
    out = None
    for k in ks:
        fused = fuse(channels, at, ["item_id"], ["item_id"], k)
        one = recall_at(fused, relevant, at).agg(F.avg("recall").alias("recall")).withColumn("rrf_k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Mean differences of two metric tables, and whether neither fell."""
    j = old.select("query_id", F.col("recall").alias("r0"), F.col("precision").alias("p0")).join(new.select("query_id", F.col("recall").alias("r1"), F.col("precision").alias("p1")), "query_id")
    return j.agg(F.avg(F.col("r1") - F.col("r0")).alias("recall_delta"), F.avg(F.col("p1") - F.col("p0")).alias("precision_delta")).withColumn("passes", (F.col("recall_delta") >= 0) & (F.col("precision_delta") >= 0))


def rerank_report(before: DataFrame, after: DataFrame, latencies: DataFrame, gates: dict[str, float]) -> DataFrame:
    """One row: mean gains of a rerank over the fused order, its latency, and which gates it passes.

    before, after: query_id, recall, precision, reciprocal_rank; latencies: latency_ms.
    gates: least gains by metric, and the most 95th percentile of latency in ms. A report
    never enables the rerank: what a provider takes and costs is not measured here.
    """
    from lodestrata.operators.aggregates import percentile_nearest

    metrics = ["recall", "precision", "reciprocal_rank"]
    both = before.select("query_id", *[F.col(m).alias(f"{m}_0") for m in metrics]).join(after, "query_id")
    gain = both.agg(F.count("*").alias("queries"), *[F.avg(F.col(m) - F.col(f"{m}_0")).alias(f"{m}_gain") for m in metrics])
    quantile = lambda p, name: percentile_nearest(latencies, "latency_ms", p).select(F.col("latency_ms").alias(name), F.lit(1).alias("one"))
    quality = F.lit(True)
    for m in metrics:
        quality = quality & (F.col(f"{m}_gain") >= gates[m])
    out = gain.withColumn("one", F.lit(1)).join(quantile(0.5, "p50_ms"), "one", "left").join(quantile(0.95, "p95_ms"), "one", "left").drop("one")  # one row each
    return out.withColumn("quality_passes", quality).withColumn("latency_passes", F.col("p95_ms") <= gates["p95_ms"]).withColumn("enabled", F.lit(False))


def live_rerank(candidates: DataFrame, scores: DataFrame, requests: int = 2) -> DataFrame:
    """query_id, candidate_id, rank: a provider's scores as an order, ties by the fused rank and then the id.

    candidates: query_id, candidate_id, fused_rank; scores: query_id, candidate_id,
    relevance, as a provider gave them. At most ``requests`` queries may have been sent;
    every candidate must have one score, and no other may: else an error.
    """
    if candidates.select("query_id").distinct().limit(requests + 1).count() > requests:
        raise ValueError("too many live requests")
    both = candidates.join(scores, ["query_id", "candidate_id"], "full")
    bad = (
        F.when(F.col("fused_rank").isNull(), F.raise_error(F.lit("a score of no candidate")))
        .when(F.col("relevance").isNull() | F.isnan("relevance"), F.raise_error(F.lit("every candidate must be scored")))
        .when(F.count("*").over(W.partitionBy("query_id", "candidate_id")) > 1, F.raise_error(F.lit("a candidate is scored twice")))
    )
    order = W.partitionBy("query_id").orderBy(F.desc("relevance"), "fused_rank", "candidate_id")
    rows = both.withColumn("relevance", F.coalesce(bad.cast("double"), F.col("relevance").cast("double")))
    return rows.select("query_id", "candidate_id", F.row_number().over(order).alias("rank"))


def golden_problems(queries: DataFrame) -> DataFrame:
    """One row per broken rule of a golden set: its size, repeated ids, missing kinds of query."""
    q = queries.agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("ids"), F.count_if(F.col("expected_status") == "recoverable").alias("recoverable"), F.count_if(F.size("expected_clusters") > 0).alias("duplicates"))
    rules = F.array_compact(F.array(F.when(~F.col("n").between(20, 30), "query-count"), F.when(F.col("ids") != F.col("n"), "repeated-id"), F.when(F.col("recoverable") == 0, "no-recoverable"), F.when(F.col("duplicates") == 0, "no-duplicate")))
    return q.select(F.explode(rules).alias("problem"))


# The fields of a golden fixture and of its parts, and what they may hold.
FIXTURE = ["schemaVersion", "fixtureId", "provenance", "scopes", "blocks", "duplicateClusters", "queries"]
SCOPE = ["scopeId", "label"]
BLOCK = ["blockId", "scopeId", "documentAlias", "materialType", "title", "text"]
CLUSTER = ["clusterId", "blockIds"]
QUERY = ["queryId", "intent", "queryText", "expectedStatus", "scopeId", "expectedBlockIds", "scopeBlockIds", "expectedDuplicateClusterIds"]
INTENTS = ["source-lookup", "completeness", "knowledge-organization"]
# End of fixed values.


def golden_faults(fixtures: DataFrame, json: str = "json") -> DataFrame:
    """fixture, item, fault: what is wrong with golden fixtures (fixture, json), each given by hand as one JSON text.

    Every object must have its fields and no other, ids are unique and not blank, and
    what refers to something must find it: blocks their scope, clusters two blocks of one
    scope that no other cluster has, resolved queries their scope's blocks, all of them,
    with the expected ones and their clusters among them; recoverable queries name
    nothing. A set has 20 to 30 queries of all intents, with one recoverable and one with
    duplicates at least. A text that is no JSON object has that one fault.
    """
    raw = F.from_json(json, "schemaVersion int, fixtureId string, provenance string, scopes array<string>, blocks array<string>, duplicateClusters array<string>, queries array<string>")
    read = lambda c, names, lists=(): F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(F.array_sort(F.json_object_keys(x)).alias("keys"), F.from_json(x, ", ".join(f"{n} {'array<string>' if n in lists else 'string'}" for n in names)).alias("v")))
    lists = ["blockIds", "expectedBlockIds", "scopeBlockIds", "expectedDuplicateClusterIds"]
    rows = fixtures.select("fixture", F.col(json).alias("json"), raw.alias("f"), F.json_object_keys(json).alias("keys"))
    rows = rows.select("fixture", "f", "keys", read(F.col("f.scopes"), SCOPE).alias("s"), read(F.col("f.blocks"), BLOCK).alias("b"), read(F.col("f.duplicateClusters"), CLUSTER, lists).alias("c"), read(F.col("f.queries"), QUERY, lists).alias("q"))
    of = lambda c, f: F.transform(c, lambda x: x["v"][f])
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    twice = lambda ids, x: F.size(F.filter(ids, lambda y: y == x)) > 1
    listed = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    lacks = lambda part, whole: F.size(F.array_except(listed(part), listed(whole))) > 0
    fault = lambda when, name: F.when(F.coalesce(when, F.lit(False)), name)
    scopes, blocks, clusters, queries = of("s", "scopeId"), of("b", "blockId"), of("c", "clusterId"), of("q", "queryId")
    scope_of = lambda ids: F.array_distinct(F.transform(F.filter("b", lambda b: F.array_contains(listed(ids), b["v"]["blockId"])), lambda b: b["v"]["scopeId"]))
    within = lambda scope: F.transform(F.filter("b", lambda b: b["v"]["scopeId"] == scope), lambda b: b["v"]["blockId"])
    strange = lambda x, names: x["keys"] != F.array(*map(F.lit, sorted(names)))

    def items(column: str, id_field: str, ids, checks) -> Column:
        one = lambda x: F.transform(F.array_compact(F.array(*checks(x, ids))), lambda f: F.struct(F.coalesce(x["v"][id_field], F.lit("")).alias("item"), f.alias("fault")))
        return F.flatten(F.transform(column, one))

    def scope_checks(x, ids):
        return [fault(strange(x, SCOPE), "scope-fields"), fault(blank(x["v"]["scopeId"]) | blank(x["v"]["label"]), "scope-blank"), fault(twice(ids, x["v"]["scopeId"]), "scope-repeated")]

    def block_checks(x, ids):
        v = x["v"]
        return [fault(strange(x, BLOCK), "block-fields"), fault(blank(v["blockId"]) | blank(v["title"]) | blank(v["text"]), "block-blank"), fault(twice(ids, v["blockId"]), "block-repeated"), fault(~F.array_contains(scopes, F.coalesce(v["scopeId"], F.lit(""))), "block-scope-unknown")]

    def cluster_checks(x, ids):
        own = listed(x["v"]["blockIds"])
        shared = F.exists("c", lambda y: (y["v"]["clusterId"] != x["v"]["clusterId"]) & F.arrays_overlap(listed(y["v"]["blockIds"]), own))
        return [fault(strange(x, CLUSTER), "cluster-fields"), fault(twice(ids, x["v"]["clusterId"]), "cluster-repeated"), fault(F.size(own) < 2, "cluster-too-small"), fault(F.size(F.array_distinct(own)) != F.size(own), "cluster-block-repeated"), fault(lacks(own, blocks), "cluster-block-unknown"), fault(shared, "cluster-block-shared"), fault(F.size(scope_of(own)) > 1, "cluster-over-scopes")]

    def query_checks(x, ids):
        v = x["v"]
        want, scoped, dup = listed(v["expectedBlockIds"]), listed(v["scopeBlockIds"]), listed(v["expectedDuplicateClusterIds"])
        resolved, recoverable = v["expectedStatus"] == "resolved", v["expectedStatus"] == "recoverable"
        inside = F.flatten(F.transform(F.filter("c", lambda c: F.array_contains(dup, c["v"]["clusterId"])), lambda c: listed(c["v"]["blockIds"])))
        return [
            fault(strange(x, QUERY), "query-fields"),
            fault(blank(v["queryId"]), "query-blank"),
            fault(twice(ids, v["queryId"]), "query-repeated"),
            fault(~F.coalesce(v["intent"], F.lit("")).isin(INTENTS), "query-intent"),
            fault(blank(v["queryText"]) | (F.length(v["queryText"]) > 240) | v["queryText"].rlike(r"[\r\n]"), "query-text"),
            fault(~F.coalesce(resolved | recoverable, F.lit(False)), "query-status"),
            fault(lacks(F.array_union(want, scoped), blocks), "query-block-unknown"),
            fault(lacks(dup, clusters), "query-cluster-unknown"),
            fault(recoverable & (v["scopeId"].isNotNull() | (F.size(F.concat(want, scoped, dup)) > 0)), "recoverable-names-evidence"),
            fault(resolved & ~F.array_contains(scopes, F.coalesce(v["scopeId"], F.lit(""))), "query-scope-unknown"),
            fault(resolved & ((F.size(want) == 0) | (F.size(scoped) == 0)), "query-without-evidence"),
            fault(resolved & (lacks(scoped, within(v["scopeId"])) | lacks(within(v["scopeId"]), scoped)), "query-scope-not-whole"),
            fault(resolved & lacks(want, within(v["scopeId"])), "query-outside-scope"),
            fault(resolved & lacks(inside, want), "query-cluster-outside"),
        ]

    n = F.size("q")
    whole = [
        fault(F.array_sort("keys") != F.array(*map(F.lit, sorted(FIXTURE))), "fixture-fields"),
        fault(~F.col("f.schemaVersion").eqNullSafe(1), "schema-version"),
        fault(~F.col("f.provenance").eqNullSafe("synthetic-deidentified"), "provenance"),
        fault(F.size("s") == 0, "no-scope"),
        fault(F.size("b") == 0, "no-block"),
        fault(~n.between(20, 30), "query-count"),
        fault(lacks(F.array(*map(F.lit, INTENTS)), of("q", "intent")), "intent-missing"),
        fault(~F.exists("q", lambda x: x["v"]["expectedStatus"].eqNullSafe("recoverable")), "no-recoverable"),
        fault(~F.exists("q", lambda x: F.size(listed(x["v"]["expectedDuplicateClusterIds"])) > 0), "no-duplicate"),
    ]
    top = F.transform(F.array_compact(F.array(*whole)), lambda f: F.struct(F.lit("").alias("item"), f.alias("fault")))
    every = F.concat(top, items("s", "scopeId", scopes, scope_checks), items("b", "blockId", blocks, block_checks), items("c", "clusterId", clusters, cluster_checks), items("q", "queryId", queries, query_checks))
    found = F.when(F.col("keys").isNull(), F.array(F.struct(F.lit("").alias("item"), F.lit("not-json").alias("fault")))).otherwise(every)
    return rows.select("fixture", F.explode(found).alias("x")).select("fixture", "x.*")
