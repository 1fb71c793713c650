"""Queries of names, links, images and smaller operators, with the SQL that states them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions import images as I
from lodestrata.functions import text as X
from lodestrata.operators import aggregates as A
from lodestrata.operators import evaluation as V
from lodestrata.operators import filters as L
from lodestrata.operators import joins as J
from lodestrata.operators import layout as Y
from lodestrata.operators import lifecycle as C
from lodestrata.operators import projection as O
from lodestrata.operators import queue as Q
from lodestrata.operators import ranking as R
from lodestrata.plans.catalog import query, table
from lodestrata.sources import tables as T
from lodestrata.streaming import events as E

#: A note for each document: its text, two local images, a remote one, and one inside a fence.
NOTE = "text || '\\n![[img/' || doc_id || '.png|shown]]\\n```\\n![[hidden.png]]\\n```\\n![a](../up/' || source || '.jpg \"t\") ![r](http://h/y.png)'"
NOTE_SQL = "text || chr(10) || '![[img/' || doc_id || '.png|shown]]' || chr(10) || '```' || chr(10) || '![[hidden.png]]' || chr(10) || '```' || chr(10) || '![a](../up/' || source || '.jpg \"t\") ![r](http://h/y.png)'"


def notes(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.expr(NOTE).alias("text"), F.expr("lang || '/' || doc_id || '.md'").alias("relative_path"))


@query("""
WITH d AS (SELECT doc_id, source, length(text) AS n, length(doc_id::VARCHAR) AS w FROM documents)
SELECT doc_id, n + 1 AS start, n + 20 + w AS "end", 'img/' || doc_id || '.png' AS source, 'shown' AS alt, 'wikilink' AS syntax FROM d
UNION ALL SELECT doc_id, n + 45 + w, n + 65 + w + length(source), 'up/' || source || '.jpg', 'a', 'markdown' FROM d
""")
def image_references(spark, d):
    found = notes(spark, d).select("doc_id", F.explode(I.image_references("text", "relative_path")["images"]).alias("i")).select("doc_id", "i.*")
    return found.withColumn("start", F.col("start").cast("long")).withColumn("end", F.col("end").cast("long"))


@query(f"""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN {NOTE_SQL} ELSE replace(replace({NOTE_SQL}, 'img/' || doc_id || '.png', 'kept/' || doc_id || '.webp'), '![a](../up/' || source || '.jpg "t")', '![[kept/two.jpg|a]]') END AS text, CASE WHEN doc_id % 4 = 0 THEN 'no target for up/' || source || '.jpg' END AS issue FROM documents
""")
def rewritten_images(spark, d):
    rows = notes(spark, d)
    one = rows.select("doc_id", F.expr("'img/' || doc_id || '.png'").alias("source"), F.expr("'kept/' || doc_id || '.webp'").alias("target"))
    two = rows.where("doc_id % 4 > 0").select("doc_id", F.expr("'up/' || source || '.jpg'").alias("source"), F.lit("kept/two.jpg").alias("target"))
    return I.rewrite_images(rows, one.unionByName(two), "doc_id")


@query("""
WITH t AS (SELECT c_nationkey, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END || '- part' AS stem FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, lower(stem) ORDER BY c_custkey) AS k FROM t)
SELECT c_nationkey, c_custkey, CASE WHEN k = 1 THEN stem ELSE stem || ' (' || k || ')' END AS name FROM n
""")
def note_names(spark, d):
    title = F.expr("CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END || ':  part..'")
    return X.unique_names(table(spark, d, "customer").select("c_nationkey", "c_custkey", title.alias("title")), "c_nationkey", "c_custkey", "title")


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' #' || p_brand), '[^a-z0-9._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g')) || '.pdf' AS name FROM part")
def safe_names(spark, d):
    return table(spark, d, "part").select("p_partkey", X.safe_name(F.expr("p_name || ' #' || p_brand"), F.expr("'item-' || p_partkey"), F.lit(".PDF")).alias("name"))


#: A text with links, headings and a fence for each customer.
LINKED = "CASE WHEN c_custkey % 2 = 0 THEN '# ' || c_name || chr(10) ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN 'a line' || chr(10) ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN 'more' || chr(10) ELSE '' END || 'from [[ ' || c_mktsegment || ' |x]] and [[n' || c_nationkey || '#h]] [[' || c_mktsegment || ']]' || chr(10) || '```' || chr(10) || '## in' || chr(10) || '```'"


@query(f"""
WITH t AS (SELECT c_custkey, c_mktsegment, c_nationkey, {LINKED} AS text FROM customer)
SELECT c_custkey, c_mktsegment || ',n' || c_nationkey AS links, NOT (c_custkey % 3 = 0 AND c_custkey % 5 = 0) AS at_top,
  array_to_string(list_filter(list_transform(generate_series(1, len(string_split(text, chr(10)))), lambda i: CASE WHEN regexp_matches(string_split(text, chr(10))[i], '^\\s{{0,3}}#{{1,6}}\\s') THEN 'line:' || i END), lambda x: x IS NOT NULL), ',') AS headings FROM t
""")
def links_and_headings(spark, d):
    text = F.expr(LINKED.replace("chr(10)", "'\\n'"))
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", text.alias("text"))
    return rows.select("c_custkey", F.array_join(X.wiki_links(F.col("text")), ",").alias("links"), X.top_source_link(F.col("text"), F.col("c_mktsegment")).alias("at_top"), F.array_join(X.heading_locations(F.col("text")), ",").alias("headings"))


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'part ' || l_partkey WHEN 1 THEN 'first' ELSE 'a b' END AS heading, CASE WHEN l_linenumber % 3 = 1 THEN CASE WHEN l_partkey % 4 > 0 THEN l_partkey % 4 END WHEN l_linenumber % 3 = 2 THEN 12 END IS NOT NULL AS has_page FROM lineitem
""")
def evidence_places(spark, d):
    location = F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'heading: part ' || l_partkey || ' ;x' WHEN 1 THEN 'page: ' || (l_partkey % 4) ELSE 'Heading:a b;PAGE:12' END")
    place = X.evidence_location(F.array(F.lit("first")), location)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", place["heading"].alias("heading"), place["page"].isNotNull().alias("has_page"))


@query("""
WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank, CASE WHEN turn % 3 = 0 THEN 'see /srv/x' ELSE 'fine' END AS head FROM conversations),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rank) AS n FROM r WHERE turn % 3 > 0 AND NOT regexp_matches(text, '(^|[^a-zA-Z0-9_:/])/[^\\s/]'))
SELECT conv_id AS query_id, turn, rank::INTEGER AS fused_rank, 'candidate' || lpad(n::VARCHAR, 2, '0') AS candidate_id FROM s WHERE n <= 20
""")
def sent_candidates(spark, d):
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    head = F.when(F.col("turn") % 3 == 0, "see /srv/x").otherwise("fine")
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), "turn", "text", rank.alias("rank"), F.array(head).alias("heading_path"))
    return R.rerank_candidates(rows).select("query_id", "turn", "fused_rank", "candidate_id")


@query("""
SELECT conv_id, turn, role AS block_kind, turn % 2 = 0 AS tagged FROM conversations WHERE turn % 4 > 0 AND NOT regexp_matches(text, '(^|[^a-zA-Z0-9_:/])/[^\\s/]')
""")
def rerank_views(spark, d):
    rows = table(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("candidate_id"), F.array("role").alias("heading_path"), F.col("role").alias("block_kind"), "text", F.expr("CASE WHEN turn % 4 = 0 THEN array('/home/x') WHEN turn % 2 = 0 THEN array('t') ELSE array() END").alias("allowed_tags"), F.lit(1).alias("fused_rank"), F.lit("secret").alias("relative_path"))
    seen = L.rerank_view(rows)
    part = F.split("candidate_id", ":")
    return seen.select(part[0].cast("long").alias("conv_id"), part[1].cast("long").alias("turn"), "block_kind", (F.size("allowed_tags") > 0).alias("tagged"))


@query("""
WITH c AS (SELECT label AS query_id, 'lexical' AS channel, vec_id AS item_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings UNION ALL SELECT label, 'semantic', vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id % 7, vec_id) FROM embeddings),
k AS (SELECT unnest([20, 60, 100]) AS rrf_k),
f AS (SELECT rrf_k, query_id, item_id, round(sum(1.0 / (rrf_k + r)), 9) AS score FROM c, k GROUP BY ALL),
t AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY rrf_k, query_id ORDER BY score DESC, item_id) <= 8),
g AS (SELECT label AS query_id, vec_id AS item_id FROM embeddings WHERE vec_id % 7 = 0),
n AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1),
h AS (SELECT rrf_k, query_id, count(*) AS hits FROM t JOIN g USING (query_id, item_id) GROUP BY ALL)
SELECT k.rrf_k::INTEGER AS rrf_k, round(avg(coalesce(hits, 0) / n::DOUBLE), 9) AS recall FROM n CROSS JOIN k LEFT JOIN h ON h.query_id = n.query_id AND h.rrf_k = k.rrf_k GROUP BY 1
""")
def fusion_calibration(spark, d):
    v = table(spark, d, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("item_id"))
    rank = lambda *o: F.row_number().over(W.partitionBy("query_id").orderBy(*o)).alias("rank")
    channels = v.select("query_id", F.lit("lexical").alias("channel"), "item_id", rank("item_id")).unionByName(v.select("query_id", F.lit("semantic").alias("channel"), "item_id", rank(F.col("item_id") % 7, "item_id")))
    return V.calibrate_fusion(channels, v.where("item_id % 7 = 0")).select("rrf_k", F.round("recall", 9).alias("recall"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 < 70 OR l_linenumber = 3 AS falls_back FROM lineitem")
def recognition_fallbacks(spark, d):
    issues = F.when(F.col("l_linenumber") == 3, F.array(F.lit("other"), F.lit("ocr-garbled-text"))).otherwise(F.array(F.lit("other")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", A.needs_fallback(F.col("l_quantity") * 2, issues).alias("falls_back"))


@query("""
WITH d AS (SELECT doc_id, source || '/x.md' AS path, lang = 'en' AS is_current FROM documents)
SELECT doc_id AS document_id, CASE WHEN path = 'src3/x.md' AND is_current THEN 'moved' END AS stale_reason, NOT (path = 'src3/x.md' AND is_current) AS has_vector FROM d
""")
def invalidated_path(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.expr("source || '/x.md'").alias("relative_path"), (F.col("lang") == "en").alias("is_current"), F.lit(None).cast("string").alias("stale_reason"))
    marked, kept = C.invalidate(docs, docs.select("document_id"), "src3/x.md", "moved")
    return marked.join(kept.withColumn("has_vector", F.lit(True)), "document_id", "left").select("document_id", "stale_reason", F.coalesce("has_vector", F.lit(False)).alias("has_vector"))


@query("""
WITH d AS (SELECT doc_id, lang, source <> 'src4' AS allowed, (SELECT count(*) FROM conversations WHERE conv_id = doc_id) AS n FROM documents WHERE n_chars >= 200)
SELECT lang AS vault_id, count(*) FILTER (allowed) AS files, coalesce(sum(n) FILTER (allowed), 0)::BIGINT AS blocks, count(*) FILTER (NOT allowed) AS blocked_files, sha256('[' || coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (allowed), '') || ']') AS task_id FROM d WHERE n > 0 GROUP BY 1
""")
def embedding_previews(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("vault_id"), (F.col("n_chars") >= 200).alias("is_current"), F.lit(True).alias("verifiable"), F.lit(None).cast("string").alias("stale_reason"), F.lit(False).alias("pending_association"), "source")
    blocks = table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), "turn")
    return A.embedding_preview(docs, blocks, docs.select("document_id", (F.col("source") != "src4").alias("allowed")))


@query("""
SELECT conv_id AS session_id, '{"session_id":' || conv_id || ',"title":"t' || conv_id || '","messages":[' || string_agg('{"turn":' || turn || ',"role":"' || role || '","text":' || to_json(sha256(text)) || '}', ',' ORDER BY turn, role) || ']}' AS json FROM conversations GROUP BY conv_id
""")
def exported_sessions(spark, d):
    said = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.sha2("text", 256).alias("text"))
    sessions = said.select("session_id").distinct().withColumn("title", F.concat(F.lit("t"), F.col("session_id").cast("string")))
    return T.export_sessions(sessions, said)


@query("SELECT doc_id, CASE WHEN strpos(lower(text), 'the') = 0 THEN substr(text, 1, 250) ELSE substr(text, greatest(strpos(lower(text), 'the') - 90, 1), strpos(lower(text), 'the') - greatest(strpos(lower(text), 'the') - 90, 1) + 160) END AS excerpt FROM documents")
def search_excerpts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.search_excerpt(F.col("text"), F.lit("The")).alias("excerpt"))


@query("""
SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+|[^\\s]'), lambda t: CASE WHEN regexp_full_match(t, '[A-Za-z0-9_]+') THEN (length(t) + 3) // 4 ELSE 1 END)), 0)::INTEGER AS tokens FROM documents
""")
def index_token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("""
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN NULL WHEN 1 THEN trim(text) WHEN 2 THEN '[' || role || ']' || chr(10) || chr(10) || trim(text) ELSE 'own' END AS input FROM conversations WHERE trim(text) <> ''
""")
def embedding_inputs(spark, d):
    rows = table(spark, d, "conversations").where("trim(text) <> ''")
    turn = F.col("turn") % 4
    prefix = F.when(turn == 2, F.concat(F.lit("["), "role", F.lit("]")))
    retrieval = F.when(turn == 3, "![[x.png]] own ![a](b.png)").when(turn == 0, " ![[x.png]] ")
    text = F.when(turn == 0, "![only](an/image.png)").otherwise(F.col("text"))
    return rows.select("conv_id", "turn", X.embedding_input(prefix, retrieval, text).alias("input"))


@query("""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source || '|' || lang WHEN 1 THEN source || '|x y' WHEN 2 THEN '' WHEN 3 THEN '' ELSE lang END AS tags FROM documents
""")
def note_tags(spark, d):
    front = "CASE doc_id % 5 WHEN 0 THEN 'tags: [' || source || ', \"' || lang || '\", ' || source || ']' WHEN 1 THEN 'a: b\\ntags:\\n  - ' || source || '\\n  - \"x y\"\\nc: d' WHEN 2 THEN 'tags: [broken' WHEN 3 THEN 'other: [x]' ELSE 'tags: [' || '''' || lang || ''']' END"
    text = F.expr(f"'---\\n' || {front} || '\\n---\\n' || text")
    return table(spark, d, "documents").select("doc_id", F.array_join(X.tags(text), "|").alias("tags"))


@query("""
WITH h AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g') AS heading FROM pages),
w AS (SELECT page_id, list_distinct(list_transform(regexp_extract_all(lower(heading), '[a-z0-9]+'), lambda x: CASE WHEN length(x) > 3 AND ends_with(x, 'ies') THEN substr(x, 1, length(x) - 3) || 'y' WHEN length(x) > 3 AND ends_with(x, 's') THEN substr(x, 1, length(x) - 1) ELSE x END)) AS words FROM h)
SELECT page_id, array_to_string(list_sort(list_filter(words, lambda x: x NOT IN ('and', 'check', 'concept', 'description', 'dialogue', 'exercise', 'exercises', 'focus', 'form', 'forms', 'guide', 'lesson', 'note', 'notes', 'of', 'order', 'practice', 'practices', 'review', 'verb'))), ',') AS terms FROM w
""")
def heading_terms(spark, d):
    heading = F.regexp_replace(F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", "")
    return table(spark, d, "pages").select("page_id", F.array_join(X.concept_terms(heading), ",").alias("terms"))


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'vocabulary' WHEN 2 THEN 'exercise' WHEN 3 THEN 'grammar' WHEN 4 THEN 'phrase' WHEN 5 THEN 'sentence-pattern' ELSE 'other' END AS kind FROM lineitem
""")
def knowledge_kinds(spark, d):
    words = F.array(*map(F.lit, ["Unit 3 VOCABULARY and Phrases", "课后练习", "Grammar exercises", "Useful phrase", "Sentence patterns", "Part " * 3, "other"]))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.knowledge_kind(F.array(F.lit("Book"), F.get(words, (F.col("l_linenumber") - 1).cast("int")))).alias("kind"))


@query("""
SELECT doc_id, list_reduce(list_prepend('', string_split(text, chr(10))), lambda a, x: CASE WHEN rtrim(a) = '' THEN ltrim(x) WHEN regexp_matches(rtrim(a), '[A-Za-z]-$') AND regexp_matches(ltrim(x), '^[a-z]') THEN substr(rtrim(a), 1, length(rtrim(a)) - 1) || ltrim(x) ELSE rtrim(a) || ' ' || ltrim(x) END) AS text FROM documents
""")
def joined_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", X.join_wrapped(F.split("text", "\n")).alias("text"))


@query("""
SELECT page_id, relative_path, total_rows, pages FROM (SELECT page_id, 'Vault/' || url AS relative_path, count(*) OVER () AS total_rows, ceil(count(*) OVER () / 20.0)::BIGINT AS pages FROM pages WHERE contains(lower(url), 'en')) ORDER BY lower(relative_path) DESC, relative_path LIMIT 20 OFFSET 20
""")
def file_listing(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("Vault/"), "url").alias("relative_path"))
    return Q.file_page(rows, 2, 20, text="EN", descending=True)


@query("""
WITH o AS (SELECT l_orderkey, coalesce(list(DISTINCT l_partkey) FILTER (l_linenumber <= 3), []) AS want, coalesce(list(DISTINCT l_partkey) FILTER (l_linenumber >= 2), []) AS got, l_orderkey % 7 = 0 AS wrong, l_orderkey % 5 = 0 AS none FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey AS query_id, CASE WHEN wrong THEN 0.0 WHEN none THEN CASE WHEN len(got) = 0 THEN 1.0 ELSE 0.0 END WHEN len(want) = 0 THEN CASE WHEN len(got) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(got, want)) / len(want)::DOUBLE END::DOUBLE AS recall,
  CASE WHEN wrong THEN 0.0 WHEN none THEN CASE WHEN len(got) = 0 THEN 1.0 ELSE 0.0 END WHEN len(got) = 0 THEN CASE WHEN len(want) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(got, want)) / len(got)::DOUBLE END::DOUBLE AS precision FROM o
""")
def golden_metrics(spark, d):
    parts = lambda c: F.coalesce(F.collect_set(F.when(c, F.col("l_partkey").cast("string"))), F.array().cast("array<string>"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(parts(F.col("l_linenumber") <= 3).alias("want"), parts(F.col("l_linenumber") >= 2).alias("got"))
    status = F.when(F.col("query_id") % 5 == 0, "recoverable").otherwise("resolved")
    none, no_clusters = F.array().cast("array<string>"), F.array().cast("array<array<string>>")
    golden = rows.select("query_id", F.col("want").alias("expected_block_ids"), none.alias("scope_block_ids"), no_clusters.alias("expected_clusters"), status.alias("expected_status"))
    said = rows.select("query_id", F.col("got").alias("retrieved_block_ids"), none.alias("scoped_block_ids"), no_clusters.alias("duplicate_clusters"), F.when(F.col("query_id") % 7 == 0, "other").otherwise(status).alias("scope_status"))
    return V.query_metrics(golden, said).select("query_id", "recall", "precision")


@query("""
WITH b AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'heading' ELSE 'paragraph' END AS kind, role || turn AS text, 1 + turn % 2 AS level FROM conversations),
a AS (SELECT *, max(turn) FILTER (kind = 'heading') OVER w AS h, max(turn) FILTER (kind = 'heading' AND level = 1) OVER w AS top FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT a.conv_id AS graph_id, a.turn AS reading_order, CASE WHEN a.h IS NULL THEN '' WHEN x.level = 1 THEN x.text WHEN a.top IS NULL OR a.top > a.h THEN x.text ELSE y.text || '/' || x.text END AS path
FROM a LEFT JOIN b x ON x.conv_id = a.conv_id AND x.turn = a.h LEFT JOIN b y ON y.conv_id = a.conv_id AND y.turn = a.top
""")
def heading_stacks(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("graph_id"), F.col("turn").alias("reading_order"), F.when(F.col("turn") % 3 == 0, "heading").otherwise("paragraph").alias("kind"), F.concat("role", F.col("turn").cast("string")).alias("text"), (1 + F.col("turn") % 2).cast("int").alias("level"))
    return Y.heading_context(rows).select("graph_id", "reading_order", F.array_join("heading_path", "/").alias("path"))


@query("""
WITH b AS (SELECT doc_id, source || (doc_id % 3) AS text, doc_id % 40 AS page, source FROM documents)
SELECT a.doc_id AS block_id, count(DISTINCT b.page) AS pages FROM b a JOIN b ON a.source = b.source AND a.text = b.text AND a.page <> b.page GROUP BY 1
""")
def same_places(spark, d):
    box = {"x1": 10.0, "y1": 5.0, "x2": 90.0, "y2": 9.0, "page_width": 100.0, "page_height": 200.0}
    rows = table(spark, d, "documents").select(F.col("source").alias("graph_id"), F.col("doc_id").alias("block_id"), (F.col("doc_id") % 40).alias("page"), F.concat("source", (F.col("doc_id") % 3).cast("string")).alias("text"), *[F.lit(v).alias(k) for k, v in box.items()])
    return J.same_position(rows).select("block_id", "pages")


@query("""
WITH t AS (SELECT o_custkey AS k, bool_or(o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' OR o_orderkey % 97 = 0) AS troubled, bool_or(o_orderstatus = 'O') AS runs FROM orders GROUP BY 1)
SELECT c_custkey AS vault_id, CASE WHEN c_nationkey = 3 THEN 'inactive' WHEN c_nationkey % 10 = 4 THEN 'unavailable' WHEN c_custkey % 6 = 0 OR c_custkey % 5 = 0 OR coalesce(troubled, FALSE) THEN 'attention' WHEN coalesce(runs, FALSE) THEN 'running' ELSE 'healthy' END AS state FROM customer LEFT JOIN t ON k = c_custkey
""")
def vault_states(spark, d):
    rows = table(spark, d, "customer").withColumn("vault_id", F.col("c_custkey"))
    vaults = rows.select("vault_id", F.expr("CASE WHEN c_nationkey = 3 THEN 'revoked' ELSE 'active' END").alias("authorization_status"), F.expr("CASE WHEN c_nationkey % 10 = 4 THEN 'missing' ELSE 'available' END").alias("access_status"))
    health = rows.where("c_custkey % 6 > 0").select("vault_id", F.lit(0).alias("failed"), F.expr("CAST(c_custkey % 5 = 0 AS INT)").alias("stale"), F.lit(0).alias("pending"))
    tasks = table(spark, d, "orders").select(F.col("o_custkey").alias("vault_id"), F.expr("CASE WHEN o_orderstatus = 'O' THEN 'running' WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'recoverable' ELSE 'complete' END").alias("lifecycle"), F.expr("CASE WHEN o_orderkey % 97 = 0 THEN 'broken' END").alias("failure_reason"), F.lit(0).alias("failed_count"))
    return A.vault_states(vaults, health, tasks)


@query("""
WITH l AS (SELECT o_custkey AS k, o_orderkey AS n, CASE o_orderkey % 8 WHEN 0 THEN 'Q: ' || o_orderpriority WHEN 1 THEN 'A: is it ' || o_orderstatus || '?' WHEN 2 THEN 'Unit ' || o_orderstatus WHEN 3 THEN '- ' || o_orderpriority WHEN 4 THEN 'answer: ' || o_orderstatus WHEN 5 THEN 'a | ' || o_orderstatus WHEN 6 THEN '' ELSE o_orderpriority || '?' END AS text FROM orders),
r AS (SELECT *, row_number() OVER w AS i, coalesce((starts_with(text, 'Q:') OR ends_with(text, '?')) AND regexp_matches(lead(text) OVER w, '(?i)^(a|answer)[.:]'), FALSE) AS pairs, lead(text) OVER w AS after FROM l WHERE text <> '' WINDOW w AS (PARTITION BY k ORDER BY n)),
s AS (SELECT *, pairs AND (i - coalesce(max(i) FILTER (NOT pairs) OVER (PARTITION BY k ORDER BY n), 0)) % 2 = 1 AS starts FROM r),
e AS (SELECT *, coalesce(lag(starts) OVER (PARTITION BY k ORDER BY n), FALSE) AS eaten FROM s)
SELECT k AS customer, n AS place, CASE WHEN starts THEN 'question-answer' WHEN i = 1 AND (starts_with(text, 'Unit') OR (upper(text) = text AND lower(text) <> text)) THEN 'heading' WHEN starts_with(text, '- ') THEN 'list-item' WHEN contains(text, ' | ') THEN 'table-row' ELSE 'paragraph' END AS kind, CASE WHEN starts THEN text || chr(10) || after ELSE text END AS text FROM e WHERE NOT eaten
""")
def page_units(spark, d):
    text = F.expr("CASE o_orderkey % 8 WHEN 0 THEN 'Q: ' || o_orderpriority WHEN 1 THEN 'A: is it ' || o_orderstatus || '?' WHEN 2 THEN 'Unit ' || o_orderstatus WHEN 3 THEN '- ' || o_orderpriority WHEN 4 THEN 'answer: ' || o_orderstatus WHEN 5 THEN 'a | ' || o_orderstatus WHEN 6 THEN ' ' ELSE o_orderpriority || '?' END")
    lines = table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("place"), text.alias("text"))
    return O.page_units(lines, ["customer"], "place")


@query("""
WITH j AS (SELECT l_orderkey AS task_id, l_partkey % 5 AS unit_id, l_returnflag AS snapshot_digest, CASE WHEN l_linestatus = 'O' THEN 'prepared' WHEN l_linenumber % 2 = 0 THEN 'committed' ELSE 'failed' END AS status, l_linenumber AS created_at FROM lineitem),
o AS (SELECT DISTINCT task_id, unit_id, snapshot_digest FROM j p WHERE status = 'prepared' AND NOT EXISTS (FROM j t WHERE t.task_id = p.task_id AND t.unit_id = p.unit_id AND t.snapshot_digest = p.snapshot_digest AND t.status <> 'prepared'))
SELECT task_id, unit_id, snapshot_digest, status, created_at FROM j UNION ALL SELECT task_id, unit_id, snapshot_digest, 'failed', 99 FROM o
""")
def recovered_journals(spark, d):
    status = F.expr("CASE WHEN l_linestatus = 'O' THEN 'prepared' WHEN l_linenumber % 2 = 0 THEN 'committed' ELSE 'failed' END")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), (F.col("l_partkey") % 5).alias("unit_id"), F.col("l_returnflag").alias("snapshot_digest"), status.alias("status"), F.lit(None).cast("string").alias("reason"), F.col("l_linenumber").cast("int").alias("created_at"))
    return E.recover_journals(rows, F.lit(99)).drop("reason")


@query("""
SELECT o_orderkey AS task_id, CASE WHEN o_orderstatus = 'O' THEN 'recoverable' ELSE 'complete' END AS lifecycle, CASE WHEN o_orderstatus = 'O' THEN 'interrupted' ELSE phase END AS phase,
  CASE WHEN o_orderstatus = 'O' THEN CASE phase WHEN 'parsing' THEN 'restart-parse' WHEN 'ocr' THEN 'restart-ocr' WHEN 'deriving-markdown' THEN 'restart-derivation' WHEN 'committing' THEN 'retry-commit' ELSE 'restart-scan' END END AS recovery_action
FROM (SELECT *, ['scanning', 'parsing', 'ocr', 'deriving-markdown', 'committing'][1 + o_orderkey % 5] AS phase FROM orders)
""")
def recovered_tasks(spark, d):
    phase = F.get(F.array(*map(F.lit, ["scanning", "parsing", "ocr", "deriving-markdown", "committing"])), (F.col("o_orderkey") % 5).cast("int"))
    none = F.lit(None).cast("string")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.expr("CASE WHEN o_orderstatus = 'O' THEN 'running' ELSE 'complete' END").alias("lifecycle"), phase.alias("phase"), none.alias("recovery_action"), none.alias("failure_reason"), F.col("o_orderdate").alias("updated_at"))
    return E.recover_tasks(rows, F.current_date()).drop("failure_reason", "updated_at")
