"""A query per operator of the index: its tables are views of the whole test tables, and SQL states the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import metadata as M
from lodestrata.functions import paths as P
from lodestrata.functions import text as X
from lodestrata.operators import aggregates as A
from lodestrata.operators import enumeration as N
from lodestrata.operators import evaluation as V
from lodestrata.operators import filters as L
from lodestrata.operators import joins as J
from lodestrata.operators import layout as Y
from lodestrata.operators import lifecycle as C
from lodestrata.operators import projection as O
from lodestrata.operators import queue as Q
from lodestrata.operators import ranking as R
from lodestrata.plans.catalog import query, table
from lodestrata.streaming import events as E

#: The documents as an index table: flags come from their own columns.
IDX = """idx AS (SELECT doc_id AS document_id, lang AS vault_id, source || '/' || lang || '/' || doc_id || '.md' AS relative_path, sha256(text) AS content_sha256, n_chars >= 300 AS is_current, lang <> 'fr' AS verifiable,
  CASE WHEN contains(text, 'icense') THEN 'content-changed' END AS stale_reason, source = 'src9' AS pending_association, CASE WHEN lang = 'en' THEN 'native' ELSE 'derived' END AS document_kind,
  CASE WHEN n_chars > 500 THEN 's' || doc_id END AS source_id, sha256(text) AS source_sha256, 'Files/' || source || '/' || doc_id || '.pdf' AS source_path, n_chars FROM documents)"""
#: Turns of conversations as blocks of the documents of the same number.
BLK = "blk AS (SELECT conv_id AS document_id, turn AS sequence, text, role AS kind, sha256(text) AS block_content_sha256 FROM conversations)"
OK = "is_current AND verifiable AND stale_reason IS NULL AND NOT pending_association"


def documents(spark, d):
    cols = {
        "document_id": "doc_id", "vault_id": "lang", "relative_path": "source || '/' || lang || '/' || doc_id || '.md'", "content_sha256": "sha2(text, 256)", "is_current": "n_chars >= 300", "verifiable": "lang <> 'fr'",
        "stale_reason": "CASE WHEN contains(text, 'icense') THEN 'content-changed' END", "pending_association": "source = 'src9'", "document_kind": "CASE WHEN lang = 'en' THEN 'native' ELSE 'derived' END",
        "source_id": "CASE WHEN n_chars > 500 THEN 's' || doc_id END", "source_sha256": "sha2(text, 256)", "source_path": "'Files/' || source || '/' || doc_id || '.pdf'", "n_chars": "n_chars",
    }
    return table(spark, d, "documents").selectExpr(*[f"{v} AS {k}" for k, v in cols.items()])


def blocks(spark, d):
    return table(spark, d, "conversations").selectExpr("conv_id AS document_id", "turn AS sequence", "text", "role AS kind", "sha2(text, 256) AS block_content_sha256")


@query(f"WITH {IDX} SELECT document_id, relative_path FROM idx WHERE {OK}")
def eligible_documents(spark, d):
    return documents(spark, d).where(L.eligible()).select("document_id", "relative_path")


@query(f"WITH {IDX} SELECT document_id FROM idx WHERE document_kind = 'native' OR (verifiable AND source_id IS NOT NULL AND source_sha256 IS NOT NULL AND source_path IS NOT NULL)")
def snapshot_documents(spark, d):
    return documents(spark, d).where(L.snapshot_eligible()).select("document_id")


@query(f"WITH {IDX} SELECT document_id FROM idx WHERE {OK} AND document_id IN (SELECT conv_id FROM conversations)")
def embeddable_documents(spark, d):
    own = blocks(spark, d).groupBy("document_id").agg(F.collect_set("sequence").alias("blocks"))
    return documents(spark, d).join(own, "document_id").where(L.embedding_eligible()).select("document_id")


@query(f"WITH {IDX} SELECT document_id FROM idx WHERE relative_path IN (SELECT relative_path FROM idx JOIN labels ON doc_id = document_id WHERE quality = 1)")
def allowed_documents(spark, d):
    docs = documents(spark, d)
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("document_id"))
    return L.allowed(docs, docs.join(good, "document_id")).select("document_id")


@query(f"WITH {IDX}, {BLK} SELECT document_id, sequence, block_content_sha256 FROM blk JOIN idx USING (document_id) WHERE {OK} AND kind = 'user' AND sequence = 2")
def exact_unit_blocks(spark, d):
    b = blocks(spark, d)
    meta = b.select("document_id", "sequence", F.col("kind").alias("subject"), F.lit("g").alias("grade_volume"), F.col("sequence").cast("int").alias("unit_no"), F.lit("accepted").alias("meta_status"))
    return L.exact_blocks(meta, documents(spark, d), b, "user", "g", 2).select("document_id", "sequence", "block_content_sha256")


@query(f"WITH {IDX} SELECT document_id FROM idx WHERE starts_with(lower(relative_path), 'src1/') OR starts_with(lower(source_path), 'src1/')")
def embedding_scope_documents(spark, d):
    return L.embedding_scope(documents(spark, d), "SRC1").select("document_id")


@query(f"WITH {BLK} SELECT document_id, sequence FROM blk WHERE kind = 'user'")
def blocks_under_heading(spark, d):
    rows = blocks(spark, d).withColumn("heading_path", F.array("kind", F.lit("more")))
    return L.under_heading(rows, [" User: "]).select("document_id", "sequence")


@query("SELECT page_id, CASE regexp_extract(url, '[?].*$') WHEN '' THEN 'markdown' ELSE 'pdf' END AS kind, CASE regexp_extract(url, '[?].*$') WHEN '' THEN 'markdown' ELSE 'pdf' END AS preview FROM pages")
def file_kinds(spark, d):
    path = F.concat(F.lit("a.b/"), F.col("page_id").cast("string"), F.when(F.contains("url", F.lit("?")), ".PDF").otherwise(".md"))
    return table(spark, d, "pages").select("page_id", P.source_kind(path).alias("kind"), P.preview_kind(path).alias("preview"))


@query(f"WITH {IDX}, {BLK} SELECT document_id, sequence, relative_path, text FROM blk JOIN idx USING (document_id)")
def blocks_with_metadata(spark, d):
    b = blocks(spark, d)
    meta = b.select("document_id", "sequence")
    return J.with_blocks(meta, documents(spark, d), b).select("document_id", "sequence", "relative_path", "text")


@query(f"WITH {IDX}, {BLK} SELECT document_id, sequence, relative_path, label FROM (SELECT vec_id AS document_id, label::BIGINT AS sequence, label, len(embedding) AS n FROM embeddings) v JOIN idx USING (document_id) JOIN blk USING (document_id, sequence) WHERE n = 64")
def vectors_with_blocks(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), F.col("label").cast("long").alias("sequence"), "label", F.lit("p").alias("profile_fp"), F.size("embedding").alias("dimension"))
    return J.vectors_of(v, documents(spark, d), blocks(spark, d), "p", 64).select("document_id", "sequence", "relative_path", "label")


@query("SELECT source AS vault_id, lang AS graph_id, revision, d.doc_id AS block_id, p.n AS blocks FROM documents d JOIN (SELECT source, lang, max(n_chars) AS revision, count(*) AS n FROM documents GROUP BY 1, 2) p USING (source, lang) WHERE d.n_chars = p.revision")
def projection_with_blocks(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("vault_id"), F.col("lang").alias("graph_id"), F.col("n_chars").alias("revision"), F.col("doc_id").alias("block_id"))
    return J.projection_blocks(docs.groupBy("vault_id", "graph_id").agg(F.max("revision").alias("revision"), F.count("*").alias("blocks")), docs)


@query("""
WITH p AS (SELECT 'nation:' || s_nationkey AS key, count(*) AS found, min(s_name) AS one FROM supplier GROUP BY 1)
SELECT c_custkey, CASE WHEN found = 1 THEN one END AS matched_block, CASE WHEN found IS NULL THEN 'graph-block-missing' WHEN found > 1 THEN 'graph-block-ambiguous' END AS issue
FROM customer LEFT JOIN p ON key = 'nation:' || c_nationkey
""")
def blocks_by_place(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string"), F.lit("#chunk:1")).alias("location"))
    proj = table(spark, d, "supplier").select(F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("location"), F.col("s_name").alias("graph_block_id"))
    return J.blocks_by_location(rows, proj).select("c_custkey", "matched_block", "issue")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_documents(spark, d):
    return J.without(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), ["doc_id"])


@query("""
SELECT DISTINCT o_custkey AS task_id, o_orderpriority AS unit_id FROM orders p WHERE o_orderstatus = 'P'
  AND NOT EXISTS (SELECT 1 FROM orders t WHERE t.o_orderstatus IN ('O', 'F') AND t.o_custkey = p.o_custkey AND t.o_orderpriority = p.o_orderpriority)
""")
def unfinished_units(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "prepared").when(F.col("o_orderstatus") == "O", "committed").otherwise("failed")
    journal = table(spark, d, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderpriority").alias("unit_id"), F.lit("x").alias("digest"), status.alias("status"))
    return J.unfinished(journal).select("task_id", "unit_id").distinct()


ITEMS = """items AS (SELECT o_orderkey AS item_id, o_custkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'supported' WHEN 'O' THEN 'skipped' ELSE 'failed' END AS category,
  CASE WHEN o_totalprice > 250000 THEN 'new' ELSE 'duplicate' END AS identity_status, CASE WHEN o_totalprice > 400000 THEN o_orderkey END AS version_candidate_source_id,
  CASE WHEN o_orderstatus = 'F' THEN 'parsed' ELSE 'parse-failed' END AS parse_status, (o_totalprice > 300000)::INT AS parse_issue_count, CASE WHEN o_orderpriority = '5-LOW' THEN 'rejected' ELSE 'accepted' END AS conversion_status FROM orders)"""
OCR = "ocr AS (SELECT l_orderkey AS item_id, (l_quantity > 25)::INT AS issue_count, CASE l_returnflag WHEN 'R' THEN 'excluded' WHEN 'A' THEN 'kept' END AS decision, CASE l_linestatus WHEN 'F' THEN 'completed' ELSE 'failed' END AS status FROM lineitem)"


@query(f"""
WITH {ITEMS}, {OCR}, scans AS (SELECT task_id, count(*) FILTER (issue_count > 0 AND decision IS NULL) AS checks, count(*) FILTER (status = 'completed') AS done, count(*) FILTER (status = 'failed') AS lost, count(*) FILTER (decision = 'excluded') AS gaps FROM ocr JOIN items USING (item_id) GROUP BY 1)
SELECT task_id, count(*) AS discovered, count(*) FILTER (category = 'supported') AS supported, count(*) FILTER (category = 'skipped') AS skipped, 0::BIGINT AS unsupported, count(*) FILTER (category = 'failed') AS failed,
  count(*) FILTER (identity_status = 'new') AS new_count, count(*) FILTER (identity_status = 'duplicate') AS duplicate_count, count(version_candidate_source_id) AS possible_version_count, 0::BIGINT AS identity_failed_count,
  count(*) FILTER (parse_status = 'parsed') AS parsed_count, count(*) FILTER (parse_status = 'parse-failed') AS parse_failed_count, coalesce(max(done), 0) AS ocr_completed_count, coalesce(max(lost), 0) AS ocr_failed_count, coalesce(max(gaps), 0) AS confirmed_gap_count,
  count(*) FILTER (category = 'supported') AS derived_note_count, count(*) FILTER (identity_status = 'new' AND parse_issue_count = 0) AS classification_checks,
  count(*) FILTER (parse_issue_count > 0) + count(*) FILTER (conversion_status = 'rejected') + coalesce(max(checks), 0) AS required_check_count
FROM items LEFT JOIN scans USING (task_id) GROUP BY task_id
""")
def task_counters(spark, d):
    when = lambda c, v, other=None: f"CASE WHEN {c} THEN {v} ELSE {other or 'NULL'} END"
    items = table(spark, d, "orders").selectExpr(
        "o_orderkey AS item_id", "o_custkey AS task_id", "CASE o_orderstatus WHEN 'F' THEN 'supported' WHEN 'O' THEN 'skipped' ELSE 'failed' END AS category", when("o_totalprice > 250000", "'new'", "'duplicate'") + " AS identity_status",
        when("o_totalprice > 400000", "o_orderkey") + " AS version_candidate_source_id", when("o_orderstatus = 'F'", "'parsed'", "'parse-failed'") + " AS parse_status", "int(o_totalprice > 300000) AS parse_issue_count", when("o_orderpriority = '5-LOW'", "'rejected'", "'accepted'") + " AS conversion_status",
    )
    ocr = table(spark, d, "lineitem").selectExpr("l_orderkey AS item_id", "int(l_quantity > 25) AS issue_count", "CASE l_returnflag WHEN 'R' THEN 'excluded' WHEN 'A' THEN 'kept' END AS decision", "CASE l_linestatus WHEN 'F' THEN 'completed' ELSE 'failed' END AS status")
    notes = items.where("category = 'supported'").select("task_id", "item_id", F.lit(None).cast("string").alias("invalidated_at"))
    suggestions = items.where("identity_status = 'new'").selectExpr("task_id", "item_id", "1 AS revision", when("parse_issue_count = 0", "0.5D", "0.9D") + " AS confidence", "CAST(NULL AS STRING) AS decision", "CAST(NULL AS STRING) AS invalidated_at")
    return A.task_counters(items, ocr, notes, suggestions)


@query(f"""
WITH {IDX}, a AS (SELECT vault_id, count(*) FILTER (is_current AND NOT pending_association) AS current, count(*) FILTER (is_current AND stale_reason IS NOT NULL) AS stale, count(*) FILTER (is_current AND pending_association) AS pending FROM idx GROUP BY 1),
j AS (SELECT CASE event_type WHEN 'click' THEN 'en' WHEN 'view' THEN 'de' ELSE 'none' END AS vault_id, count(*) FILTER (value > 20) AS failed FROM events WHERE event_type <> 'view' OR value <= 20 GROUP BY 1),
h AS (SELECT vault_id, coalesce(current, 0) AS current, coalesce(stale, 0) AS stale, coalesce(failed, 0) AS failed, coalesce(pending, 0) AS pending FROM a FULL JOIN j USING (vault_id))
SELECT *, CASE WHEN failed > 0 THEN 'failed' WHEN stale > 0 OR pending > 0 THEN 'stale' WHEN current > 0 THEN 'healthy' ELSE 'not-initialized' END AS status FROM h
""")
def index_health(spark, d):
    jobs = table(spark, d, "events").where("event_type <> 'view' OR value <= 20").selectExpr("CASE event_type WHEN 'click' THEN 'en' WHEN 'view' THEN 'de' ELSE 'none' END AS vault_id", "CASE WHEN value > 25 THEN 'failed' WHEN value > 20 THEN 'running' ELSE 'complete' END AS status")
    return A.index_health(documents(spark, d), jobs)


@query(f"""
WITH {IDX}, r AS (
  SELECT vault_id, 'stale' AS kind, relative_path AS path, stale_reason AS detail, n_chars::DOUBLE AS at_ FROM idx WHERE is_current AND stale_reason IS NOT NULL
  UNION ALL SELECT vault_id, 'pending', relative_path, NULL, n_chars FROM idx WHERE is_current AND pending_association
  UNION ALL SELECT event_type, 'failed', event_id || '.md', CASE WHEN value > 25 THEN 'failed' ELSE 'running' END, value FROM events WHERE value > 20
)
SELECT vault_id, kind, path, detail, place FROM (SELECT *, row_number() OVER (PARTITION BY vault_id, kind ORDER BY at_ DESC, path)::INTEGER AS place FROM r) WHERE place <= 10
""")
def health_samples(spark, d):
    docs = documents(spark, d).withColumn("indexed_at", F.col("n_chars").cast("double"))
    jobs = table(spark, d, "events").selectExpr("event_type AS vault_id", "event_id || '.md' AS relative_path", "CASE WHEN value > 25 THEN 'failed' WHEN value > 20 THEN 'running' ELSE 'complete' END AS status", "value AS updated_at")
    return A.health_samples(docs, jobs)


@query(f"""
WITH {IDX}, {BLK}, k AS (SELECT blk.*, vault_id FROM blk JOIN idx USING (document_id) WHERE {OK}), t AS (SELECT vault_id, count(*) AS eligible_blocks FROM k GROUP BY 1),
c AS (SELECT vault_id, max(n) AS n FROM (SELECT vault_id, kind, count(*) AS n FROM k GROUP BY 1, 2) GROUP BY 1)
SELECT vault_id, eligible_blocks, coalesce(n, 0) AS covered_blocks, CASE WHEN coalesce(n, 0) = 0 THEN 'unavailable' WHEN n < eligible_blocks THEN 'partial' ELSE 'available' END AS status FROM t LEFT JOIN c USING (vault_id)
""")
def semantic_coverage(spark, d):
    b = blocks(spark, d)
    return A.semantic_coverage(documents(spark, d), b, b.select("document_id", "sequence", "block_content_sha256", F.col("kind").alias("profile_fp")))


@query(f"""
WITH {IDX} SELECT CASE WHEN document_kind = 'derived' THEN 'source:' || source_id ELSE 'content:' || content_sha256 END AS "group", min(document_id) AS first, count(*) AS n FROM idx GROUP BY 1
""")
def evidence_by_origin(spark, d):
    return A.evidence_groups(documents(spark, d).withColumn("ordinal", F.col("document_id"))).select("group", "first", "n")


@query("SELECT lang AS profile_fp, count(DISTINCT source) AS dimensions FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def mixed_dimensions(spark, d):
    return A.one_dimension(table(spark, d, "documents").select(F.col("lang").alias("profile_fp"), F.col("source").alias("dimension")))


@query("""
SELECT min(l_orderkey) AS target_id, l_partkey AS page_num, string_agg(l_shipmode_, ' ' ORDER BY l_linenumber, l_shipmode_) AS text, round(avg(l_discount), 9) AS confidence, min(l_quantity) AS x1, max(l_quantity + l_tax) AS x2
FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem) GROUP BY l_partkey
""")
def recognised_lines(spark, d):
    words = table(spark, d, "lineitem").selectExpr("l_partkey AS target_id", "l_partkey AS page_num", "1 AS block_num", "1 AS par_num", "1 AS line_num", "l_linenumber AS word_num", "l_returnflag || l_linestatus AS text", "l_quantity AS left", "l_quantity AS top", "l_tax AS width", "l_tax AS height", "l_discount AS conf", "5 AS level", "l_orderkey")
    first = words.groupBy("page_num").agg(F.min("l_orderkey").alias("first"))
    return A.ocr_lines(words).join(first, "page_num").select(F.col("first").alias("target_id"), "page_num", "text", F.round("confidence", 9).alias("confidence"), "x1", "x2")


@query(f"""
WITH {IDX}, f AS (SELECT relative_path, CASE WHEN n_chars > 1000 THEN content_sha256 ELSE 'new' || document_id END AS content_sha256, n_chars > 2000 AS later FROM idx WHERE vault_id <> 'de'),
c AS (SELECT relative_path, content_sha256 AS h0 FROM idx WHERE is_current AND vault_id <> 'es'),
r AS (SELECT relative_path, f.content_sha256, CASE WHEN later IS NULL THEN 'missing' WHEN h0 IS NULL THEN 'index' WHEN later THEN 'update' ELSE 'unchanged' END AS action, h0 FROM f FULL JOIN c USING (relative_path)),
g AS (SELECT DISTINCT h0 FROM r WHERE action = 'missing')
SELECT relative_path, content_sha256, action, action = 'index' AND (SELECT count(*) FROM g) > 0 AND content_sha256 NOT IN (SELECT h0 FROM g) AS pending_association FROM r
""")
def reconciled_files(spark, d):
    docs = documents(spark, d)
    files = docs.where("vault_id <> 'de'").selectExpr("relative_path", "CASE WHEN n_chars > 1000 THEN content_sha256 ELSE 'new' || document_id END AS content_sha256", "CASE WHEN n_chars > 2000 THEN 2 ELSE 1 END AS mtime_ns", "n_chars AS size")
    known = docs.where("vault_id <> 'es'").selectExpr("relative_path", "content_sha256", "is_current", "1 AS observed_mtime_ns", "n_chars AS observed_size", "7 AS policy_revision")
    return C.reconcile(files, known, 7)


@query(f"""
WITH {IDX}, n AS (SELECT relative_path, vault_id FROM idx WHERE is_current AND n_chars > 1000)
SELECT document_id, is_current AND n_chars <= 1000 AS is_current, CASE WHEN is_current AND n_chars > 1000 THEN 'content-changed' ELSE stale_reason END AS stale_reason FROM idx
UNION ALL SELECT document_id, is_current, stale_reason FROM idx WHERE n_chars > 1000
""")
def document_versions(spark, d):
    docs = documents(spark, d)
    new = docs.where("n_chars > 1000").withColumn("content_sha256", F.lit("other"))
    return C.upsert_versions(docs, new).select("document_id", "is_current", "stale_reason")


@query(f"WITH {IDX}, {BLK} SELECT document_id, sequence FROM blk WHERE document_id IN (SELECT document_id FROM idx WHERE vault_id <> 'de')")
def purged_blocks(spark, d):
    docs, b = documents(spark, d), blocks(spark, d)
    v = b.select("document_id", "sequence", F.col("block_content_sha256").alias("input_sha256"))
    return C.purge(docs, b, v, v.select("input_sha256").distinct(), docs.where("vault_id = 'de'"))["blocks"].select("document_id", "sequence")


@query(f"WITH {IDX}, {BLK} SELECT DISTINCT block_content_sha256 AS input_sha256 FROM blk WHERE document_id IN (SELECT document_id FROM idx WHERE vault_id <> 'de')")
def purged_cache(spark, d):
    docs, b = documents(spark, d), blocks(spark, d)
    v = b.select("document_id", "sequence", F.col("block_content_sha256").alias("input_sha256"))
    return C.purge(docs, b, v, v.select("input_sha256").distinct(), docs.where("vault_id = 'de'"))["cache"]


@query(f"WITH {IDX} SELECT document_id, stale_reason, pending_association FROM idx WHERE relative_path <> 'src9/en/9.md' UNION ALL SELECT document_id, CASE WHEN pending_association THEN 'confirmed-deleted' ELSE stale_reason END, FALSE FROM idx WHERE relative_path = 'src9/en/9.md'")
def resolved_association(spark, d):
    return C.resolve_association(documents(spark, d), "src9/en/9.md", True).select("document_id", "stale_reason", "pending_association")


@query(f"WITH {BLK} SELECT document_id, sequence, CASE WHEN sequence < 1 THEN 'legacy-block-invalid' WHEN kind = 'user' THEN 'block-content-sha256-mismatch' ELSE 'block-content-sha256-missing' END AS code FROM blk")
def audited_blocks(spark, d):
    b = blocks(spark, d).withColumns({"location": F.lit("l"), "heading_path": F.array("kind"), "confidence": F.lit(0.5), "token_estimate": F.lit(1), "retrieval_text": F.lit(""), "block_content_sha256": F.when(F.col("kind") == "user", "bad").otherwise("")})
    return C.audit_blocks(b)


@query(f"WITH {BLK} SELECT document_id, sequence, CASE WHEN kind = 'user' THEN 'own' ELSE 'g' || sequence END AS graph_block_id, CASE WHEN kind = 'user' THEN -1 ELSE document_id END AS reading_order FROM blk")
def backfilled_blocks(spark, d):
    b = blocks(spark, d).selectExpr("document_id", "sequence", "text", "block_content_sha256", "CASE WHEN kind = 'user' THEN 'own' END AS graph_block_id", "CASE WHEN kind = 'user' THEN -1L END AS reading_order")
    s = b.selectExpr("document_id", "sequence", "'g' || sequence AS graph_block_id", "document_id AS reading_order")
    return C.backfill(b, s).select("document_id", "sequence", "graph_block_id", "reading_order")


@query("""
WITH k AS (SELECT s_suppkey AS source_id, s_nationkey, 'h' || s_suppkey AS h FROM supplier), n AS (SELECT c_custkey AS source_id, c_nationkey, CASE WHEN c_custkey IN (SELECT s_suppkey FROM supplier) THEN 'h' || c_custkey ELSE 'x' END AS h FROM customer)
SELECT n.source_id, CASE WHEN k.source_id IS NULL THEN 'new' ELSE 'duplicate' END AS identity_status, CASE WHEN k.source_id IS NULL THEN (SELECT min(v.source_id) FROM k v WHERE v.s_nationkey = n.c_nationkey) END::VARCHAR AS version_of
FROM n LEFT JOIN k ON n.h = k.h
""")
def resolved_sources(spark, d):
    known = table(spark, d, "supplier").selectExpr("s_suppkey AS source_id", "'h' || s_suppkey AS content_sha256", "'N' || s_nationkey AS label", "1 AS created_at")
    new = table(spark, d, "customer").join(known.select(F.col("source_id").alias("c_custkey"), F.lit(True).alias("same")), "c_custkey", "left")
    new = new.selectExpr("c_custkey AS source_id", "CASE WHEN same THEN 'h' || c_custkey ELSE 'x' END AS content_sha256", "'n' || c_nationkey AS label")
    return C.resolve_sources(new, known).select("source_id", "identity_status", F.col("version_of").cast("string").alias("version_of"))


@query("SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT DISTINCT o_custkey, 'added' FROM orders WHERE o_custkey NOT IN (SELECT n_nationkey FROM nation)")
def inserted_once(spark, d):
    base = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    return C.insert_missing(base, table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.lit("added").alias("name")), ["key"])


@query("""
SELECT l_orderkey AS item_id, l_linenumber::BIGINT AS revision, NULL AS decision FROM lineitem UNION ALL
SELECT l_orderkey, max(l_linenumber)::BIGINT + 1, 'accepted' FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1
""")
def revised_suggestions(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").cast("long").alias("revision"), F.lit(None).cast("string").alias("decision"))
    return C.revise(s, table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("item_id"), F.lit("accepted").alias("decision")))


@query("""
WITH f AS (SELECT source AS snapshot_id, bool_or(lang = 'fr') AS moved FROM documents GROUP BY 1)
SELECT snapshot_id, CASE WHEN moved THEN 'content-changed' END AS invalid_reason, CASE WHEN moved THEN 'invalidated' ELSE 'prepared' END AS status FROM f
""")
def refreshed_snapshots(spark, d):
    docs = table(spark, d, "documents")
    frozen = docs.selectExpr("source AS snapshot_id", "doc_id AS document_id", "'x' AS content_sha256")
    now = docs.selectExpr("doc_id AS document_id", "CASE WHEN lang = 'fr' THEN 'y' ELSE 'x' END AS content_sha256", "1 AS policy_revision")
    return C.refresh_snapshots(docs.selectExpr("source AS snapshot_id", "'prepared' AS status", "1 AS policy_revision").distinct(), frozen, now).select("snapshot_id", "invalid_reason", "status")


@query("""
WITH v AS (SELECT p_partkey AS vault_id, '/r/' || replace(lower(p_name), ' ', '/') AS root FROM part)
SELECT DISTINCT o.vault_id AS outer_id, i.vault_id AS inner_id FROM v o JOIN v i ON i.vault_id <> o.vault_id AND (i.root = o.root OR starts_with(i.root, o.root || '/'))
""")
def nested_roots(spark, d):
    return C.overlapping_roots(table(spark, d, "part").selectExpr("p_partkey AS vault_id", "'/r/' || replace(p_name, ' ', '/') AS root_path"))


@query("""
SELECT a.conv_id AS message_id, a.turn AS paragraph_no, e.turn AS sequence FROM conversations a JOIN conversations e USING (conv_id)
WHERE contains(lower(regexp_replace(e.text, '\\s+', '', 'g')), lower(regexp_replace(string_split(a.text, '. ')[1], '\\s+', '', 'g')))
""")
def cited_evidence(spark, d):
    turns = table(spark, d, "conversations")
    answers = turns.selectExpr("conv_id AS message_id", "turn AS paragraph_no", "split(text, '[.] ')[0] AS paragraph")
    evidence = turns.selectExpr("conv_id AS message_id", "conv_id AS document_id", "turn AS sequence", "text AS excerpt", "'b' AS block_content_sha256", "'c' AS content_sha256")
    return C.cite(answers, evidence).select("message_id", "paragraph_no", "sequence")


@query(f"WITH {IDX}, {BLK} SELECT document_id, sequence, CASE WHEN kind = 'system' THEN 'verified' WHEN kind = 'user' THEN 'stale' ELSE 'unsupported' END AS status FROM blk")
def reverified_citations(spark, d):
    b = blocks(spark, d)
    cites = b.selectExpr("document_id", "sequence", "CASE WHEN kind = 'system' THEN block_content_sha256 ELSE 'old' END AS block_content_sha256", "'stale' AS status")
    return C.reverify(cites, b.where("kind <> 'assistant'")).select("document_id", "sequence", "status")


JOBS = "jobs AS (SELECT event_id AS job_id, user_id AS vault_id, event_type AS reason, 'k' || (event_type = 'view') AS paths_key, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' WHEN 'view' THEN 'completed' ELSE 'pending' END AS status, ts AS created_at FROM events)"


#: The same jobs dealt to many small vaults, so that some have no running and some no waiting job.
DEALT = "dealt AS (SELECT * REPLACE (job_id % (SELECT count(*) // 4 FROM events) AS vault_id) FROM jobs)"


def dealt(spark, d):
    return jobs(spark, d).withColumn("vault_id", F.col("job_id") % (table(spark, d, "events").count() // 4))


def jobs(spark, d):
    return table(spark, d, "events").selectExpr("event_id AS job_id", "user_id AS vault_id", "event_type AS reason", "'k' || (event_type = 'view') AS paths_key", "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' WHEN 'view' THEN 'completed' ELSE 'pending' END AS status", "ts AS created_at")


@query(f"WITH {JOBS}, {DEALT} SELECT vault_id, min_by(job_id, (created_at, job_id)) AS job_id FROM dealt WHERE status = 'pending' AND vault_id NOT IN (SELECT vault_id FROM dealt WHERE status = 'running') GROUP BY 1")
def next_jobs(spark, d):
    return Q.next_jobs(dealt(spark, d)).select("vault_id", "job_id")


@query(f"WITH {JOBS} SELECT vault_id, paths_key, job_id, reason FROM jobs QUALIFY row_number() OVER (PARTITION BY vault_id, paths_key ORDER BY created_at DESC, job_id DESC) = 1 AND status = 'failed'")
def failed_retries(spark, d):
    return Q.newest_failed(jobs(spark, d)).select("vault_id", "paths_key", "job_id", "reason")


@query("SELECT user_id AS vault_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS place FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 12")
def recent_activity(spark, d):
    return Q.recent_activity(table(spark, d, "events").select(F.col("user_id").alias("vault_id"), "event_id", F.col("ts").alias("created_at"))).select("vault_id", "event_id", "place")


@query(f"WITH {JOBS} SELECT job_id, row_number() OVER (PARTITION BY vault_id ORDER BY created_at, job_id)::INTEGER AS place FROM jobs WHERE status = 'pending'")
def queue_places(spark, d):
    return Q.in_turn(jobs(spark, d)).select("job_id", "place")


@query(f"WITH {JOBS}, {DEALT} SELECT DISTINCT r.vault_id, r.reason FROM dealt r WHERE r.status = 'failed' AND NOT EXISTS (SELECT 1 FROM dealt j WHERE j.status IN ('pending', 'running') AND j.vault_id = r.vault_id)")
def queued_once(spark, d):
    rows = dealt(spark, d)
    same = rows.withColumns({"paths_key": F.lit("k"), "reason": F.lit("error")})
    return E.queue_once(same, same.where("status = 'failed'")).select("vault_id", "reason")


@query(f"WITH {JOBS} SELECT job_id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' THEN 'interrupted' END AS error FROM jobs")
def recovered_jobs(spark, d):
    return E.recover(jobs(spark, d).withColumn("error", F.lit(None).cast("string"))).select("job_id", "status", "error")


@query("""
WITH g AS (SELECT o_orderkey AS generation_id, o_custkey AS snapshot_id, CASE o_orderstatus WHEN 'O' THEN 'running' ELSE 'completed' END AS status, o_orderdate AS started_at FROM orders)
SELECT generation_id, CASE WHEN status = 'running' AND EXISTS (SELECT 1 FROM orders c WHERE c.o_custkey = snapshot_id AND c.o_orderstatus = 'F' AND c.o_orderdate >= started_at) THEN 'invalidated' ELSE status END AS status FROM g
""")
def void_generations(spark, d):
    orders = table(spark, d, "orders")
    g = orders.selectExpr("o_orderkey AS generation_id", "o_custkey AS snapshot_id", "CASE o_orderstatus WHEN 'O' THEN 'running' ELSE 'completed' END AS status", "o_orderdate AS started_at")
    return Q.invalidate_generations(g, orders.where("o_orderstatus = 'F'").selectExpr("o_custkey AS snapshot_id", "o_orderdate AS changed_at", "'c' AS reason")).select("generation_id", "status")


RUN = """run AS (SELECT doc_id AS ordinal, source AS plan_id, CASE WHEN lang = 'fr' THEN 'excluded' ELSE 'planned' END AS disposition, sha256(text) AS h, trim(text) = '' AS blank FROM documents),
first AS (SELECT h, min(ordinal) AS first FROM run WHERE disposition = 'planned' GROUP BY 1),
done AS (SELECT ordinal, plan_id, CASE WHEN disposition <> 'planned' THEN disposition WHEN blank THEN 'failed' WHEN ordinal = first THEN 'processed' ELSE 'duplicate' END AS result FROM run LEFT JOIN first USING (h))"""


def covered(spark, d):
    return N.execute_coverage(table(spark, d, "documents").selectExpr("doc_id AS ordinal", "source AS plan_id", "CASE WHEN lang = 'fr' THEN 'excluded' ELSE 'planned' END AS disposition", "sha2(text, 256) AS block_content_sha256", "text AS excerpt"))


@query(f"WITH {RUN} SELECT ordinal, result FROM done")
def coverage_results(spark, d):
    return covered(spark, d).select("ordinal", "result")


@query(f"""
WITH {RUN} SELECT plan_id, count(*) AS items, CASE WHEN bool_or(result = 'failed') THEN 'failed' WHEN bool_or(result = 'uncovered') THEN 'uncovered' WHEN bool_or(result = 'excluded') THEN 'excluded' WHEN count(*) FILTER (result = 'processed') = 0 THEN 'empty' ELSE 'complete' END AS status FROM done GROUP BY 1
""")
def coverage_states(spark, d):
    return N.coverage_status(covered(spark, d))


@query("""
SELECT min(doc_id) AS ordinal, count(*) AS copies, max(n_chars) AS token_estimate, min_by(lang, doc_id) AS knowledge_kind FROM documents WHERE lang <> 'fr' GROUP BY sha256(text)
""")
def atomic_groups(spark, d):
    items = table(spark, d, "documents").selectExpr("doc_id AS ordinal", "CASE WHEN lang = 'fr' THEN 'excluded' ELSE 'planned' END AS disposition", "lang AS knowledge_kind", "sha2(text, 256) AS block_content_sha256", "n_chars AS token_estimate", "source AS heading", "text AS excerpt")
    return N.atomic_items(items).select("ordinal", F.size("source_ordinals").cast("long").alias("copies"), "token_estimate", "knowledge_kind")


@query("""
WITH e AS (SELECT lang AS plan_id, source || '/' || (n_chars > 800) || '/' || doc_id AS relative_path, doc_id FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY relative_path) AS place FROM e)
SELECT plan_id, regexp_extract(relative_path, '^(.*)/[^/]*$', 1) AS section, count(*) AS evidence, count(DISTINCT relative_path) AS sources, min(place)::INTEGER AS first FROM r WHERE place <= 128 GROUP BY 1, 2
""")
def planned_sections(spark, d):
    rows = table(spark, d, "documents").selectExpr("lang AS plan_id", "source || '/' || (n_chars > 800) || '/' || doc_id AS relative_path", "doc_id AS sequence")
    return N.section_plan(rows).select("plan_id", "section", "evidence", "sources", "first")


@query("""
SELECT doc_id, regexp_replace(lower(source || ' - ' || lang), '[^a-z0-9]', '', 'g') AS heading, trim(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 80)) AS excerpt, '[' || source || ' · ' || lang || ']' AS prefix,
  sha256('p' || chr(0) || source) AS cache_key, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS compare_key, CASE WHEN doc_id < 26 THEN chr((65 + doc_id)::INTEGER) END AS letters
FROM (SELECT * FROM documents)
""")
def text_forms(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", X.normal_heading(F.concat_ws(" - ", "source", "lang")).alias("heading"), X.excerpt(F.col("text"), 80).alias("excerpt"), X.context_prefix(F.array("source", "lang")).alias("prefix"), X.cache_key(F.lit("p"), F.col("source")).alias("cache_key"),
        X.compare_key(F.col("text")).alias("compare_key"), F.when(F.col("doc_id") < 26, X.column_letters(F.col("doc_id"))).alias("letters"),
    )


@query("SELECT conv_id, turn, len(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+(?:[_''-][A-Za-z0-9]+)*'), lambda t: lower(t)))) AS latin, len(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+|[一-鿿]'), lambda t: lower(t)))) AS terms FROM conversations")
def term_counts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(X.english_terms(F.col("text"))).cast("long").alias("latin"), F.size(X.query_terms(F.col("text"))).cast("long").alias("terms"))


@query("SELECT doc_id, CASE WHEN regexp_matches(source, '^src1') THEN 4.0::DOUBLE ELSE 3.0::DOUBLE END AS score FROM documents WHERE starts_with(source, 'src') ORDER BY score DESC, source, doc_id LIMIT 40")
def heading_hits(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", F.array("source").alias("heading_path"))
    return R.heading_matches(rows, ["SRC", "src 1", "none"], 40, ["source", "doc_id"]).select("doc_id", "score")


RANKS = "c AS (SELECT lang AS query_id, source AS candidate_id, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source)::INTEGER AS fused_rank FROM documents GROUP BY 1, 2)"


@query(f"""
WITH {RANKS}, s AS (SELECT lang AS query_id, source AS candidate_id, max(n_chars) / 1000000.0::DOUBLE AS relevance FROM documents WHERE lang IN ('en', 'de') OR source <> 'src0' GROUP BY 1, 2),
j AS (SELECT c.*, relevance, count(*) OVER w AS sent, count(relevance) OVER w AS back FROM c LEFT JOIN s USING (query_id, candidate_id) WINDOW w AS (PARTITION BY query_id)),
r AS (SELECT query_id, candidate_id, fused_rank, CASE WHEN back = 0 THEN 'unavailable' WHEN back < sent THEN 'invalid' ELSE 'applied' END AS status, CASE WHEN back = sent THEN relevance END AS relevance FROM j)
SELECT query_id, candidate_id, status, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC NULLS LAST, fused_rank)::INTEGER AS final_rank FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC NULLS LAST, fused_rank) <= 4
""")
def reranked(spark, d):
    from pyspark.sql import Window as W

    docs = table(spark, d, "documents")
    each = docs.groupBy(F.col("lang").alias("query_id"), F.col("source").alias("candidate_id")).agg(F.count("*").alias("n"))
    cand = each.withColumn("fused_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("n"), "candidate_id"))).drop("n")
    scores = docs.where("lang IN ('en', 'de') OR source <> 'src0'").groupBy(F.col("lang").alias("query_id"), F.col("source").alias("candidate_id")).agg((F.max("n_chars") / 1000000.0).alias("relevance"))
    return R.rerank(cand, scores).select("query_id", "candidate_id", "status", "final_rank")


@query(f"""
WITH {BLK}, h AS (SELECT conv_id AS document_id, min(turn) AS sequence FROM conversations WHERE role = 'user' GROUP BY 1),
n AS (SELECT h.document_id AS query_id, b.document_id, b.sequence, CASE b.sequence - h.sequence WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END AS o FROM h JOIN blk b ON b.document_id = h.document_id AND abs(b.sequence - h.sequence) <= 1)
SELECT query_id, document_id, sequence, row_number() OVER (PARTITION BY query_id ORDER BY o)::INTEGER AS place FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY o) <= 2
""")
def expanded_hits(spark, d):
    hits = table(spark, d, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("document_id")).agg(F.min("turn").alias("sequence")).selectExpr("document_id AS query_id", "document_id", "sequence", "1.0D AS score", "1 AS rank")
    return R.expand(hits, blocks(spark, d), 2).select("query_id", "document_id", "sequence", "place")


@query("SELECT round(avg(b.p - a.p), 9) AS recall_delta, avg(b.p - a.p) >= 0 AS passes FROM (SELECT source, avg(n_chars) AS p FROM documents GROUP BY 1) a JOIN (SELECT source, max(n_chars)::DOUBLE AS p FROM documents GROUP BY 1) b USING (source)")
def metric_comparison(spark, d):
    g = table(spark, d, "documents").groupBy(F.col("source").alias("query_id")).agg(F.avg("n_chars").alias("a"), F.max("n_chars").cast("double").alias("b"))
    return V.compare(g.select("query_id", F.col("a").alias("recall"), F.col("a").alias("precision")), g.select("query_id", F.col("b").alias("recall"), F.col("b").alias("precision"))).select(F.round("recall_delta", 9).alias("recall_delta"), "passes")


BOXES = "boxes AS (SELECT l_suppkey AS graph_id, (l_orderkey // 50)::INTEGER AS page, l_orderkey * 10 + l_linenumber AS block_id, CASE WHEN l_returnflag = 'A' THEN 'image' ELSE 'paragraph' END AS kind, l_returnflag || l_linestatus AS text, l_quantity AS y1, l_quantity + l_tax AS y2, l_extendedprice AS x2 FROM lineitem)"


def boxes(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_suppkey AS graph_id", "CAST(l_orderkey DIV 50 AS INT) AS page", "l_orderkey * 10 + l_linenumber AS block_id", "CASE WHEN l_returnflag = 'A' THEN 'image' ELSE 'paragraph' END AS kind", "l_returnflag || l_linestatus AS text", "l_quantity AS y1", "l_quantity + l_tax AS y2", "l_extendedprice AS x2")


@query(f"WITH {BOXES} SELECT graph_id, page, greatest(max(x2), 1.0) AS page_width, greatest(max(y2), 1.0) AS page_height FROM boxes GROUP BY 1, 2")
def page_sizes(spark, d):
    return Y.page_bounds(boxes(spark, d))


@query(f"""
WITH {BOXES}, p AS (SELECT graph_id, page, greatest(max(y2), 1.0) AS h FROM boxes GROUP BY 1, 2),
m AS (SELECT boxes.*, lower(trim(text)) AS key FROM boxes JOIN p USING (graph_id, page) WHERE kind = 'paragraph' AND length(text) <= 100 AND (y2 <= h * 0.1 OR y1 >= h * (1 - 0.1)))
SELECT graph_id, block_id FROM m WHERE (graph_id, key) IN (SELECT (graph_id, key) FROM m GROUP BY graph_id, key HAVING count(DISTINCT page) >= 2)
""")
def page_furniture(spark, d):
    return Y.furniture(boxes(spark, d))


@query("""
SELECT page_id, string_split(regexp_extract(url, '//(.*?)([?#]|$)', 1), '/')[1] AS subject, len(string_split(regexp_extract(url, '//(.*?)([?#]|$)', 1), '/')) - 1 AS depth, regexp_replace(regexp_extract(url, '/([^/?#]*)([?#]|$)', 1), '[.][^.]*$', '') AS name FROM pages WHERE url IS NOT NULL
""")
def path_facts(spark, d):
    path = F.regexp_extract("url", r"//(.*?)([?#]|$)", 1)
    return table(spark, d, "pages").where("url IS NOT NULL").select("page_id", M.path_metadata(path).alias("m")).select("page_id", "m.subject", F.col("m.depth").cast("long").alias("depth"), "m.name")


@query("""
SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'blank' WHEN regexp_matches(trim(text), '^(?:[-*+•]|\\d+[.)])\\s+\\S') THEN 'list' ELSE 'paragraph' END AS kind FROM conversations
""")
def line_kinds(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", O.line_kind(F.col("text")).alias("kind"))


@query("SELECT conv_id AS session_id, title, (SELECT count(DISTINCT conv_id) FROM conversations WHERE role = 'user') AS total_rows FROM (SELECT conv_id, min(text) AS title FROM conversations WHERE role = 'user' GROUP BY 1) ORDER BY conv_id DESC LIMIT 10 OFFSET 10")
def session_listing(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("session_id")).agg(F.min("text").alias("title")).withColumn("updated_at", F.col("session_id"))
    return Q.session_page(rows, 2, 10).select("session_id", "title", "total_rows")
