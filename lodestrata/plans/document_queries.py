"""Queries of the operators on single documents: answers of a model, notes, corrections, scopes, tables, and the log of units."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import metadata as M
from lodestrata.functions import text as X
from lodestrata.functions.provenance import note_provenance
from lodestrata.operators import corrections as C
from lodestrata.operators import enumeration as E
from lodestrata.operators import evaluation as V
from lodestrata.operators import lifecycle as B
from lodestrata.operators import notes as N
from lodestrata.operators import provider as P
from lodestrata.operators import scopes as S
from lodestrata.operators import typed_projection as Y
from lodestrata.operators.lineage import shared_folder
from lodestrata.operators.ranking import l2_normal
from lodestrata.operators.vector_blocks import nearest_in_blocks, vector_blocks
from lodestrata.plans.catalog import dealt, query, table
from lodestrata.sources import table_grid as G
from lodestrata.sources.commits import UnitLog
from lodestrata.sources.pdf import pdf_pages as read_pdf


def lines(spark, d):
    docs = table(spark, d, "documents").where("text <> ''")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text")).withColumn("k", F.col("k") + 1)


#: Lines of documents, from 1.
LINES = "l AS (SELECT doc_id, generate_subscripts(a, 1)::INTEGER AS k, unnest(a) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text <> ''))"


@query()
def provider_chunks(spark, d):
    """Whole documents as chunks for a model."""
    return P.provider_chunks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk", "first_unit", "last_unit", "tokens", F.length("text").alias("characters"), F.sha2("text", 256).alias("text_sha256"))


@query(f"""
WITH RECURSIVE {LINES},
answers AS (SELECT doc_id, regexp_replace(string_agg(text, chr(10) ORDER BY k) FILTER (length(text) % 3 <> 0), '^\\s+|\\s+$', '', 'g') AS answer FROM l GROUP BY doc_id),
a AS (SELECT * FROM answers WHERE answer <> ''),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS copies FROM l),
walk AS (
  SELECT doc_id, 0 AS k, 0::BIGINT AS cursor, '' AS aligned, FALSE AS noise FROM a
  UNION ALL
  SELECT doc_id, k, CASE WHEN pos > 0 THEN cursor + pos - 1 + length(text) ELSE cursor END, CASE WHEN pos = 0 AND copies > 1 AND trim(text) <> '' THEN '' ELSE text END, pos = 0 AND copies > 1 AND trim(text) <> ''
  FROM (SELECT w.doc_id, n.k, w.cursor, n.text, n.copies, strpos(substr(a.answer, w.cursor + 1), n.text) AS pos FROM walk w JOIN n ON n.doc_id = w.doc_id AND n.k = w.k + 1 JOIN a ON a.doc_id = w.doc_id)
)
SELECT doc_id, k, aligned, noise FROM walk WHERE k > 0
""")
def aligned_lines(spark, d):
    rows = lines(spark, d)
    kept = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.length("text") % 3 != 0, F.struct("k", "text")))), lambda s: s["text"]), "\n")
    answers = rows.groupBy("doc_id").agg(kept.alias("answer")).where(F.regexp_replace("answer", r"^\s+|\s+$", "") != "")
    return P.align_answers(rows, answers, "doc_id", "k")


@query("""
WITH r AS (SELECT doc_id, text, CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN chr(10) WHEN 2 THEN '{"text": 1}' WHEN 3 THEN text || ' <!-- Source  UNIT -->' WHEN 4 THEN text || '<!-- source-unit 3 -->' WHEN 5 THEN reverse(text) WHEN 6 THEN replace(text, ' ', chr(10)) ELSE repeat(text || ' ', 40) END AS answer FROM documents),
c AS (SELECT *, regexp_replace(answer, '^\\s+|\\s+$', '', 'g') AS body, regexp_replace(regexp_replace(answer, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS flat, regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS unit,
  list_sum(list_transform(regexp_extract_all(answer, '[㐀-鿿豈-﫿]|[A-Za-z0-9_]+|[^\\s]'), lambda t: CASE WHEN regexp_full_match(t, '[A-Za-z0-9_]+') THEN (length(t) + 2) // 3 ELSE 1 END)) AS tokens FROM r)
SELECT doc_id, CASE WHEN answer IS NULL THEN 'not-text' WHEN body = '' THEN 'empty' WHEN tokens > 24576 THEN 'too-long' WHEN starts_with(body, '{') THEN 'json' WHEN regexp_matches(body, '(?i)<!--\\s*source[- ]unit\\b') THEN 'source-markers' WHEN unit = '' OR NOT contains(flat, unit) THEN 'not-preserved' ELSE 'ok' END AS state FROM c
""")
def answer_states(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 8).alias("m"))
    answer = (
        F.when(F.col("m") == 0, F.lit(None).cast("string")).when(F.col("m") == 1, "\n").when(F.col("m") == 2, '{"text": 1}').when(F.col("m") == 3, F.concat("text", F.lit(" <!-- Source  UNIT -->")))
        .when(F.col("m") == 4, F.concat("text", F.lit("<!-- source-unit 3 -->"))).when(F.col("m") == 5, F.reverse("text")).when(F.col("m") == 6, F.replace("text", F.lit(" "), F.lit("\n"))).otherwise(F.repeat(F.concat("text", F.lit(" ")), 40))
    )
    return docs.select("doc_id", P.answer_state(answer, F.array("text")).alias("state"))


@query("""
WITH m AS (SELECT doc_id, replace(replace(text, chr(10), ' '), '. ', '.' || chr(10) || chr(10)) AS md FROM documents),
b AS (SELECT doc_id, md, length(md) AS n, list_filter(list_transform(generate_series(1, len(string_split(md, chr(10) || chr(10))) - 1), lambda i: list_sum(list_transform(list_slice(string_split(md, chr(10) || chr(10)), 1, i), lambda p: length(p) + 2))), lambda x: x > 0) AS ends FROM m),
c AS (SELECT doc_id, md, n, CASE WHEN len(ends) = 0 THEN round(n / 3.0) ELSE list_reduce(ends, lambda a, x: CASE WHEN abs(x - round(n / 3.0)) < abs(a - round(n / 3.0)) THEN x ELSE a END) END::BIGINT AS cut FROM b)
SELECT doc_id, 1 AS note, regexp_replace(substr(md, 1, cut), '^\\s+|\\s+$', '', 'g') AS body FROM c UNION ALL SELECT doc_id, 2, regexp_replace(substr(md, cut + 1), '^\\s+|\\s+$', '', 'g') FROM c
""")
def note_bodies(spark, d):
    text = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(". "), F.lit(".\n\n"))
    docs = table(spark, d, "documents").select("doc_id", text.alias("markdown"), F.array(F.lit(1), F.lit(2)).alias("weights"))
    return P.note_bodies(docs, "doc_id")


#: What a line is follows from its length, so that documents have headings of several levels.
KIND = "CASE length(text) % 7 WHEN 0 THEN 'heading-1' WHEN 1 THEN 'heading-3' WHEN 2 THEN 'list-item' ELSE 'paragraph' END"


def units(spark, d):
    return lines(spark, d).selectExpr("doc_id", "k AS ordinal", f"{KIND} AS kind", "text")


@query(f"""
WITH RECURSIVE {LINES},
u AS (SELECT doc_id, k, text, {KIND} AS kind, length(text) AS size, sum(length(text)) OVER (PARTITION BY doc_id) AS total FROM l),
s AS (SELECT *, coalesce(lag(kind) OVER w <> 'list-item' AND kind <> 'list-item'
    AND NOT ((regexp_matches(lag(text) OVER w, '(?i)^(?:q(?:uestion)?[.:]|[0-9]+[.)])\\s*') OR ends_with(rtrim(lag(text) OVER w), '?')) AND regexp_matches(text, '(?i)^(?:a(?:nswer)?[.:])\\s*')), FALSE) AS safe
  FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
h AS (SELECT *, sum((safe AND kind = 'heading-1')::INTEGER) OVER (PARTITION BY doc_id ORDER BY k) AS section FROM s),
i AS (SELECT *, sum(size) OVER (PARTITION BY doc_id, section) AS within FROM h),
f AS (SELECT *, sum((total > 8000 AND safe AND (kind = 'heading-1' OR (kind = 'heading-3' AND within > 8000)))::INTEGER) OVER (PARTITION BY doc_id ORDER BY k) AS fragment FROM i),
g AS (SELECT doc_id, fragment, sum(size) AS size FROM f GROUP BY ALL),
walk AS (
  SELECT doc_id, fragment, 1 AS note, size AS held FROM g WHERE fragment = 0
  UNION ALL
  SELECT g.doc_id, g.fragment, CASE WHEN held >= 4000 AND held + g.size > 8000 THEN note + 1 ELSE note END, CASE WHEN held >= 4000 AND held + g.size > 8000 THEN g.size ELSE held + g.size END
  FROM walk JOIN g ON g.doc_id = walk.doc_id AND g.fragment = walk.fragment + 1
),
z AS (SELECT doc_id, arg_max(note, fragment) AS last, arg_max(held, fragment) AS held FROM walk GROUP BY doc_id),
n AS (SELECT w.doc_id, w.fragment, CASE WHEN z.held < 4000 AND z.last > 1 AND w.note = z.last THEN w.note - 1 ELSE w.note END AS note FROM walk w JOIN z USING (doc_id))
SELECT doc_id, note, min(k) AS first, max(k) AS last, count(*) AS units, sum(size)::BIGINT AS characters FROM f JOIN n USING (doc_id, fragment) GROUP BY doc_id, note
""")
def note_groups(spark, d):
    return N.note_sizes(N.default_notes(units(spark, d), "doc_id"), "doc_id")


#: Turns of a conversation, two to a note; each conversation is edited behind its second turn or at its first note.
TURNS = "t AS (SELECT conv_id, turn, role, text, (dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) + 1) // 2 AS note FROM conversations)"


def turns(spark, d):
    place = F.dense_rank().over(W.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.lit("paragraph").alias("kind"), "text", F.floor((place + 1) / 2).cast("int").alias("note"))


@query(f"""
WITH {TURNS}, c AS (SELECT conv_id, max(note) AS notes FROM t GROUP BY 1)
SELECT conv_id, turn AS ordinal, (CASE WHEN conv_id % 3 < notes AND conv_id % 3 > 0 AND note > conv_id % 3 THEN note - 1 ELSE note END)::INTEGER AS note, CASE WHEN NOT (conv_id % 3 < notes AND conv_id % 3 > 0) THEN 'no-adjacent-note' END AS refused FROM t JOIN c USING (conv_id)
""")
def merged_notes(spark, d):
    rows = turns(spark, d)
    edits = rows.select("conv_id").distinct().withColumn("before", (F.col("conv_id") % 3).cast("int"))
    return N.merge_notes(rows, edits, "conv_id").select("conv_id", "ordinal", "note", "refused")


@query(f"""
WITH {TURNS}, s AS (SELECT *, NOT ((regexp_matches(lag(text) OVER w, '(?i)^(?:q(?:uestion)?[.:]|[0-9]+[.)])\\s*') OR ends_with(rtrim(lag(text) OVER w), '?')) AND regexp_matches(text, '(?i)^(?:a(?:nswer)?[.:])\\s*')) AS safe, lead(turn) OVER (PARTITION BY conv_id, note ORDER BY turn) AS after
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT conv_id, min(turn) AS after, conv_id % 4 AS sequence FROM t GROUP BY conv_id),
y AS (SELECT e.*, CASE WHEN NOT EXISTS (FROM t WHERE t.conv_id = e.conv_id AND t.note = e.sequence) THEN 'no-such-note' WHEN e.sequence <> 1 OR s.after IS NULL THEN 'no-boundary-there' WHEN NOT n.safe THEN 'unsafe-boundary' END AS refused
  FROM e LEFT JOIN s ON s.conv_id = e.conv_id AND s.turn = e.after LEFT JOIN s n ON n.conv_id = e.conv_id AND n.turn = s.after)
SELECT conv_id, turn AS ordinal, (note + (refused IS NULL AND turn > y.after)::INTEGER)::INTEGER AS note, refused FROM t JOIN y USING (conv_id)
""")
def split_notes(spark, d):
    rows = turns(spark, d)
    edits = rows.groupBy("conv_id").agg(F.min("ordinal").alias("after")).withColumn("sequence", (F.col("conv_id") % 4).cast("int"))
    return N.split_notes(rows, edits, "conv_id").select("conv_id", "ordinal", "note", "refused")


@query("""
WITH b AS (SELECT 'g' || conv_id AS graph_id, conv_id || ':' || turn AS block_id, turn, role AS kind, text, role = 'user' AND turn % 4 = 1 AS replaced FROM conversations),
p AS (SELECT *, sha256(to_json({'kind': 'paragraph', 'text': 'fixed: ' || text})) AS print FROM b),
g AS (SELECT graph_id, sha256('{"base_graph_id":"' || graph_id || '","graph_revision":3,"replacements":{' || string_agg('"' || block_id || '":"' || print || '"', ',' ORDER BY block_id) || '}}') AS new_id FROM p WHERE replaced GROUP BY graph_id)
SELECT new_id AS graph_id, CASE WHEN replaced THEN sha256('att' || chr(0) || 'review-correction' || chr(0) || block_id || ':3:' || print) ELSE block_id END AS block_id, turn AS reading_order, CASE WHEN replaced THEN 'paragraph' ELSE kind END AS kind, CASE WHEN replaced THEN 'fixed: ' || text ELSE text END AS text, CASE WHEN replaced THEN block_id END AS supersedes_block_id
FROM p JOIN g USING (graph_id)
""")
def corrected_graphs(spark, d):
    turn = table(spark, d, "conversations")
    key = F.concat(F.lit("g"), F.col("conv_id").cast("string"))
    block = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    blocks = turn.select(key.alias("graph_id"), block.alias("block_id"), F.col("turn").alias("reading_order"), F.col("role").alias("kind"), "text")
    new = turn.where("role = 'user' AND turn % 4 = 1").select(key.alias("graph_id"), block.alias("block_id"), F.lit("paragraph").alias("kind"), F.concat(F.lit("fixed: "), "text").alias("text"))
    graphs = blocks.select("graph_id").distinct().select("graph_id", F.lit(2).alias("revision"), F.lit(None).cast("string").alias("base_graph_id"), F.lit("att").alias("attempt_id"))
    return C.corrected_graphs(graphs, blocks, new)[1]


@query("""
SELECT 'o' || o_orderkey AS block_id, 'o' || last_value(o_orderkey) OVER w AS newest, count(*) OVER w - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS steps
FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""")
def newest_blocks(spark, d):
    """Each order of a customer supersedes the one before it."""
    key = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    before = F.lag(key).over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return C.newest_blocks(table(spark, d, "orders").select(key.alias("block_id"), before.alias("supersedes_block_id")))


@query("""
WITH u AS (SELECT conv_id, turn, text, role || turn AS locator, CASE WHEN turn % 5 < 4 THEN turn // 2 END AS page, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal FROM conversations),
c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role || turn ELSE 'new' || turn END AS locator, CASE WHEN turn % 7 < 6 THEN turn // 3 END AS page, 'fixed ' || turn AS text FROM conversations WHERE turn % 3 < 2),
k AS (SELECT u.conv_id, u.ordinal::DOUBLE AS pos, 1 AS own, 0 AS by_page, 0 AS place, coalesce(c.text, u.text) AS text, u.locator, u.page, c.text IS NOT NULL AS corrected FROM u LEFT JOIN c ON c.conv_id = u.conv_id AND c.locator = u.locator),
m AS (SELECT c.*, coalesce((SELECT min(ordinal) FROM u WHERE u.conv_id = c.conv_id AND u.page > c.page), 1e18) AS pos FROM c WHERE NOT EXISTS (FROM u WHERE u.conv_id = c.conv_id AND u.locator = c.locator)),
n AS (SELECT conv_id, pos, 0 AS own, coalesce(page, max(page) OVER (PARTITION BY conv_id, pos ORDER BY turn ROWS UNBOUNDED PRECEDING), -1) AS by_page, turn AS place, text, locator, page, TRUE AS corrected FROM m)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos, own, by_page, place)::INTEGER AS ordinal, text, locator, coalesce(page, -1)::INTEGER AS page, corrected FROM (FROM k UNION ALL BY NAME FROM n)
""")
def corrected_recognition(spark, d):
    turn = table(spark, d, "conversations")
    at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    rows = turn.select("conv_id", at.alias("ordinal"), F.lit("paragraph").alias("kind"), "text", F.concat("role", F.col("turn").cast("string")).alias("locator"), F.expr("CAST(CASE WHEN turn % 5 < 4 THEN turn DIV 2 END AS INT)").alias("page"))
    fixes = turn.where("turn % 3 < 2").select("conv_id", F.col("turn").alias("place"), F.expr("CASE WHEN turn % 3 = 0 THEN role || turn ELSE 'new' || turn END").alias("locator"), F.expr("CAST(CASE WHEN turn % 7 < 6 THEN turn DIV 3 END AS INT)").alias("page"), F.expr("'fixed ' || turn").alias("text"))
    return C.with_recognised_corrections(rows, fixes, "conv_id").drop("kind").na.fill(-1, ["page"])


@query("""
WITH p AS (SELECT DISTINCT r_name, n_name || ' end' AS n_name, (s_suppkey % 12)::VARCHAR AS unit FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
c AS (SELECT c_custkey, n_name || ' end' AS n_name, c_custkey % 5 AS m, (c_custkey % 15)::VARCHAR AS unit FROM customer JOIN nation ON n_nationkey = c_nationkey),
found AS (
  SELECT DISTINCT c_custkey, r_name, p.n_name, NULL AS unit FROM c JOIN p ON p.n_name = c.n_name AND m = 0
  UNION ALL SELECT c_custkey, r_name, p.n_name, p.unit FROM c JOIN p ON p.unit = c.unit AND (m IN (1, 2) AND p.n_name = c.n_name OR m = 1 AND NOT EXISTS (FROM p x WHERE x.n_name = c.n_name))
)
SELECT c_custkey AS query_id, CASE WHEN r_name IS NOT NULL THEN 'resolved' WHEN m = 4 THEN 'open' ELSE 'closed' END AS state, CASE WHEN r_name IS NULL THEN NULL WHEN found.unit IS NULL THEN r_name || '/' || found.n_name ELSE r_name || '/' || found.n_name || '/Unit ' || found.unit END AS path
FROM c LEFT JOIN found USING (c_custkey)
""")
def heading_scopes(spark, d):
    nation, region = table(spark, d, "nation").withColumn("n_name", F.concat("n_name", F.lit(" end"))), table(spark, d, "region")  # no name begins another
    where = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    unit = lambda n: F.concat(F.lit("Unit "), n.cast("string"))
    blocks = table(spark, d, "supplier").join(where, F.col("s_nationkey") == F.col("n_nationkey")).select(F.array("r_name", "n_name", unit(F.col("s_suppkey") % 12)).alias("heading_path"))
    asks = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", (F.col("c_custkey") % 5).alias("m"), unit(F.col("c_custkey") % 15).alias("u"))
    text = (
        F.when(F.col("m") == 0, F.concat(F.lit('list "'), "n_name", F.lit('" materials')))
        .when(F.col("m") == 1, F.concat(F.lit("what is said of "), "n_name", F.lit(" in "), F.lower("u")))
        .when(F.col("m") == 2, F.concat(F.lit("Summarize "), F.lower("n_name"), F.lit(" "), "u", F.lit(" overview")))
        .when(F.col("m") == 3, F.concat(F.lit('list "'), "n_name", F.lit(' xyz" materials')))
        .otherwise("how old is the moon")
    )
    out = S.heading_scopes(blocks, asks.select(F.col("c_custkey").alias("query_id"), text.alias("content")))
    return out.select("query_id", "state", F.array_join("path", "/").alias("path"))


@query("""
WITH b AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN 'heading: ' || role || ' ;1' ELSE 'line:' || turn END AS location, CASE WHEN turn % 4 < 3 THEN role END AS head, turn % 5 = 0 AS changed FROM conversations)
SELECT conv_id AS document_id, turn AS sequence, CASE WHEN head IS NOT NULL AND NOT changed THEN head ELSE trim(regexp_extract(location, '^heading:([^;]*)', 1)) END AS heading, head IS NOT NULL AND NOT changed AS structured
FROM b WHERE conv_id % 3 > 0 AND turn >= 1 AND trim(text) <> '' AND ((head IS NOT NULL AND NOT changed) OR starts_with(location, 'heading:'))
""")
def trusted_headings(spark, d):
    turn = table(spark, d, "conversations")
    hash_ = F.when(F.col("turn") % 5 == 0, F.lit("0" * 64)).otherwise(F.sha2("text", 256))
    blocks = turn.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("sequence"), "text", F.expr("CASE WHEN turn % 3 = 0 THEN 'heading: ' || role || ' ;1' ELSE 'line:' || turn END").alias("location"), F.when(F.col("turn") % 4 < 3, F.array("role")).otherwise(F.array().cast("array<string>")).alias("heading_path"), hash_.alias("block_content_sha256"), F.lit(0.9).alias("confidence"), F.lit(1).alias("token_estimate"), F.lit("").alias("retrieval_text"))
    docs = turn.select(F.col("conv_id").alias("document_id")).distinct().withColumn("is_current", F.col("document_id") % 3 > 0)
    return S.scope_blocks(docs, blocks).select("document_id", "sequence", F.get("heading_path", 0).alias("heading"), "structured")


@query("""
WITH RECURSIVE o AS (SELECT o_custkey AS conv_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, repeat(o_orderpriority || ' ', 1 + o_orderkey % 30) AS text FROM orders),
t AS (SELECT *, length(text) AS n FROM o),
walk AS (
  SELECT conv_id, k, text AS held, 1 AS chunk FROM t WHERE k = 1
  UNION ALL
  SELECT t.conv_id, t.k, CASE WHEN cut THEN t.text ELSE held || chr(10) || chr(10) || t.text END, CASE WHEN cut THEN chunk + 1 ELSE chunk END
  FROM (SELECT w.conv_id, w.k, held, chunk, length(held) + 2 + t.n > 800 OR (length(held) >= 300 AND length(held) + 2 + t.n > 500) AS cut FROM walk w JOIN t ON t.conv_id = w.conv_id AND t.k = w.k + 1) w JOIN t ON t.conv_id = w.conv_id AND t.k = w.k + 1
)
SELECT conv_id AS graph_id, chunk::INTEGER AS sequence, arg_max(held, k) AS text, 'graph:' || conv_id || ':1:b' || min(k) || '#chunk:1' AS location FROM walk GROUP BY conv_id, chunk
""")
def packed_paragraphs(spark, d):
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    text = F.expr("repeat(o_orderpriority || ' ', CAST(1 + o_orderkey % 30 AS INT))")
    atom = F.lit(None).cast(Y.STRUCTURE)
    structure = F.struct(F.lit("atomic").alias("kind"), *[atom[n].alias(n) for n in ("level", "title", "items", "header", "rows")])
    blocks = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("graph_id"), F.lit(1).alias("revision"), place.alias("reading_order"), F.lit("paragraph").alias("kind"), text.alias("text"), F.lit(True).alias("selected"), F.lit(True).alias("retrievable"), F.lit(1.0).alias("confidence"), structure.alias("structure"))
    blocks = blocks.withColumn("block_id", F.concat(F.lit("b"), F.col("reading_order").cast("string")))
    return Y.typed_chunks(blocks).select(F.col("graph_id").cast("long").alias("graph_id"), "sequence", "text", "location")


@query("""
WITH s AS (SELECT s_suppkey, s_name, (1 + s_suppkey % 3)::INTEGER AS down, (1 + s_suppkey % 2)::INTEGER AS wide, floor(s_acctbal)::BIGINT::VARCHAR AS bal FROM supplier)
SELECT s_suppkey, 0 AS row, 0 AS "column", down AS rowspan, 1 AS colspan, 'A & ' || s_name AS text FROM s
UNION ALL SELECT s_suppkey, 0, 1, 1, wide, bal FROM s
UNION ALL SELECT s_suppkey, 1, CASE WHEN down > 1 THEN 1 ELSE 0 END, 1, 1, '<' || bal || '>' FROM s
UNION ALL SELECT s_suppkey, 2, CASE WHEN down > 2 THEN 1 ELSE 0 END, 1, 1, '' FROM s
""")
def html_table_cells(spark, d):
    html = "'<table><tr><th rowspan=' || (1 + s_suppkey % 3) || '>A &amp; ' || s_name || '</th><td colspan=\"' || (1 + s_suppkey % 2) || '\">' || CAST(CAST(FLOOR(s_acctbal) AS BIGINT) AS STRING) || '</td></tr><tr><td>&lt;' || CAST(CAST(FLOOR(s_acctbal) AS BIGINT) AS STRING) || '&gt;</td></tr><tr><td> </td></tr></table>'"
    tables = table(spark, d, "supplier").select("s_suppkey", F.expr(html).alias("html"))
    return G.table_cells(tables, "html", ["s_suppkey"]).drop("is_header")


@query("""
SELECT c_custkey, '| name | segment \\| nation |' || chr(10) || '| --- | --- |' || chr(10) || '| \\*' || c_name || ' | ' || c_mktsegment || '<br>' || c_nationkey || ' |' AS markdown FROM customer
""")
def rendered_tables(spark, d):
    html = "'<tr><th>name</th><th>segment | nation</th></tr><tr><td>*' || c_name || '</td><td>' || c_mktsegment || '<br/>' || c_nationkey || '</td></tr>'"
    return G.render_tables(table(spark, d, "customer").select("c_custkey", F.expr(html).alias("html")), "html", ["c_custkey"])


@query("""
SELECT doc_id, CASE WHEN source = 'src2' THEN NULL WHEN n_chars % 5 = 0 OR lang = 'fr' THEN 'refused' ELSE source || '/' || doc_id END AS source_path, CASE WHEN source = 'src2' OR n_chars % 5 = 0 OR lang = 'fr' THEN -1 ELSE doc_id % 9 + 1 END AS page
FROM documents
""")
def note_sources(spark, d):
    front = "CASE WHEN source = 'src2' THEN '' ELSE '---\\nplatform_provenance:\\n  schema_version: 1\\n  vault_id: ' || source || '\\n  source_id: s\\n  processing_task_id: t\\n  source_sha256: ' || CASE WHEN lang = 'fr' THEN '00' ELSE sha2(text, 256) END || '\\n  source_path: ' || source || '/' || doc_id || '\\n  source_locators:\\n    - page: ' || CASE WHEN n_chars % 5 = 0 THEN '0' ELSE CAST(doc_id % 9 + 1 AS STRING) END || '\\n---\\n' END || text"
    p = table(spark, d, "documents").select("doc_id", note_provenance(F.expr(front)).alias("p"))
    return p.select("doc_id", F.when(F.col("p.issue").isNotNull(), "refused").otherwise(F.col("p.source_path")).alias("source_path"), F.coalesce(F.get_json_object(F.get("p.source_locators", 0), "$.page").cast("long"), F.lit(-1)).alias("page"))


@query("""
SELECT lang AS vault_id, source || '/' || doc_id AS relative_path, CASE WHEN source = 'src1' THEN 'second' ELSE 'first' END AS text, source <> 'src2' AS is_current, CASE WHEN source = 'src2' THEN 'moved' END AS stale_reason,
  1 + (count(*) FILTER (source IN ('src1', 'src2')) OVER (PARTITION BY lang) > 0)::INTEGER AS generation
FROM documents
""")
def committed_units(spark, d):
    """Two units in a log of their own: all documents, then new texts of one source and the end of another's."""
    names = lambda *n: T.StructType([T.StructField(x, T.StringType()) for x in n])
    log = UnitLog(spark, f"{shared_folder(spark)}/units-{uuid.uuid4().hex}", {"documents": names("vault_id", "relative_path", "text")})
    docs = table(spark, d, "documents").select("source", F.col("lang").alias("vault_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("relative_path"), F.lit("first").alias("text"))
    first = log.commit(0, documents=docs)
    log.commit(first, documents=docs.where("source = 'src1'").withColumn("text", F.lit("second")), invalidations=docs.where("source IN ('src1', 'src2')").withColumn("reason", F.lit("moved")))
    out = log.documents().join(log.generations(), "vault_id")
    return out.select("vault_id", "relative_path", "text", "is_current", "stale_reason", F.col("generation").cast("int").alias("generation"))


@query("""
SELECT doc_id AS document_id, CASE WHEN n_chars % 4 > 0 THEN CASE lang WHEN 'en' THEN '英语' WHEN 'de' THEN '数学' END END AS subject, CASE WHEN n_chars % 4 > 0 AND n_chars % 3 = 0 THEN '七年级上册' END AS grade_volume, CASE WHEN n_chars % 4 > 0 THEN 3 ELSE -1 END AS unit_no, CASE WHEN n_chars % 4 > 0 THEN 'textbook' END AS material_type,
  CASE WHEN n_chars % 4 > 0 AND lang IN ('en', 'de') AND n_chars % 3 = 0 THEN 0.95::DOUBLE END AS meta_confidence, CASE WHEN n_chars % 4 > 0 AND lang IN ('en', 'de') AND n_chars % 3 = 0 THEN 'accepted' ELSE 'required-check' END AS meta_status
FROM documents
""")
def rule_metadata(spark, d):
    path = "CASE lang WHEN 'en' THEN '英语' WHEN 'de' THEN '数学' ELSE 'other' END || CASE WHEN n_chars % 3 = 0 THEN '/7年级上册' ELSE '' END || '/第三单元/教材/' || doc_id || '.md'"
    heads = F.expr("CASE n_chars % 4 WHEN 0 THEN array('Unit 5') WHEN 1 THEN array('x', 'unit 3') ELSE array('第3单元') END")
    blocks = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("sequence"), F.expr(path).alias("relative_path"), heads.alias("heading_path"))
    return M.rule_metadata(blocks).drop("sequence", "meta_origin").na.fill(-1, ["unit_no"])


@query("SELECT vec_id % 2 AS query_id, vec_id AS candidate_id, row_number() OVER (PARTITION BY vec_id % 2 ORDER BY label DESC, vec_id DESC)::INTEGER AS rank FROM embeddings")
def live_reranked(spark, d):
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 2).alias("query_id"), F.col("vec_id").alias("candidate_id"), (-F.col("vec_id")).alias("fused_rank"), F.col("label").cast("double").alias("relevance"))
    return V.live_rerank(rows.drop("relevance"), rows.drop("fused_rank"))


@query("""
WITH m AS (SELECT avg((label % 2)::DOUBLE - 0.25) AS recall_gain, avg((label % 5) / 8.0 - 0.125) AS precision_gain, avg(0.5 - (label % 3) / 4.0) AS reciprocal_rank_gain, count(*) AS queries FROM embeddings),
o AS (SELECT o_totalprice AS ms, row_number() OVER (ORDER BY o_totalprice) AS k, count(*) OVER () AS n FROM orders)
SELECT queries, round(recall_gain, 9) AS recall_gain, round(precision_gain, 9) AS precision_gain, round(reciprocal_rank_gain, 9) AS reciprocal_rank_gain, (SELECT min(ms) FROM o WHERE k >= ceil(n * 0.5)) AS p50_ms, (SELECT min(ms) FROM o WHERE k >= ceil(n * 0.95)) AS p95_ms,
  recall_gain >= 0.1 AND precision_gain >= 0.1 AND reciprocal_rank_gain >= 0.1 AS quality_passes, (SELECT min(ms) FROM o WHERE k >= ceil(n * 0.95)) <= 1000 AS latency_passes, FALSE AS enabled FROM m
""")
def rerank_report(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    before = rows.select("query_id", F.lit(0.25).alias("recall"), F.lit(0.125).alias("precision"), (F.col("label") % 3 / 4).alias("reciprocal_rank"))
    after = rows.select("query_id", (F.col("label") % 2).cast("double").alias("recall"), (F.col("label") % 5 / 8).alias("precision"), F.lit(0.5).alias("reciprocal_rank"))
    took = table(spark, d, "orders").select(F.col("o_totalprice").alias("latency_ms"))
    out = V.rerank_report(before, after, took, {"recall": 0.1, "precision": 0.1, "reciprocal_rank": 0.1, "p95_ms": 1000.0})
    return out.withColumns({f"{m}_gain": F.round(f"{m}_gain", 9) for m in ("recall", "precision", "reciprocal_rank")})


@query("""
WITH e AS (SELECT lang AS plan_id, source || '/' || doc_id || '.md' AS relative_path, source AS folder FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY relative_path) AS place FROM e),
s AS (SELECT plan_id, folder AS section, count(*) AS evidence, count(DISTINCT relative_path) AS sources FROM r WHERE place <= 128 GROUP BY ALL),
l AS (SELECT plan_id, count(*) > 128 AS exceeded FROM e GROUP BY 1)
SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY section)::INTEGER AS ordinal, section, evidence, sources, '根据请求进行深度创作：write of ' || plan_id AS objective, exceeded FROM s JOIN l USING (plan_id)
""")
def deep_creation_sections(spark, d):
    rows = table(spark, d, "documents").select(F.col("lang").alias("plan_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("relative_path"), F.lit(1).alias("sequence"))
    asked = rows.select("plan_id").distinct().withColumn("content", F.concat(F.lit("write of "), "plan_id"))
    sections, limits = E.deep_creation_sections(rows, asked)
    return sections.join(limits.select("plan_id", "exceeded"), "plan_id")


@query("""
WITH b AS (SELECT conv_id AS document_id, turn AS sequence, role FROM conversations WHERE trim(text) <> '' AND conv_id % 5 < 4)
SELECT document_id, sequence, CASE WHEN role = 'user' AND sequence % 2 = 0 THEN 'same' WHEN role = 'user' THEN 'kept' ELSE 'bound' END AS state, round(3 / sqrt(9 + (sequence + 1) * (sequence + 1)), 5)::DOUBLE AS first FROM b
""")
def bound_vectors(spark, d):
    """Vectors of users' turns are there already, and half of them come again with those of the other turns."""
    turn = table(spark, d, "conversations").where("trim(text) <> ''").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("sequence"), "role", "text", F.sha2("text", 256).alias("block_content_sha256"), F.lit("").alias("contextual_prefix"), F.lit("").alias("retrieval_text"))
    docs = turn.select("document_id").distinct().select("document_id", (F.col("document_id") % 5 < 4).alias("is_current"), F.lit(True).alias("verifiable"), F.lit(None).cast("string").alias("stale_reason"), F.lit(False).alias("pending_association"))
    text = X.embedding_input(F.col("contextual_prefix"), F.col("retrieval_text"), F.col("text"))
    rows = turn.where("document_id % 5 < 4").select("document_id", "sequence", F.lit("p").alias("profile_fp"), F.lit(2).alias("dimension"), "block_content_sha256", X.cache_key(F.lit("p"), text).alias("input_sha256"), F.array(F.lit(3.0), (F.col("sequence") + 1).cast("double")).alias("vector"), "role")
    kept = rows.where("role = 'user'").withColumn("vector", l2_normal(F.col("vector")).cast("array<float>"))
    out = B.bind_vectors(kept, rows.where("role <> 'user' OR sequence % 2 = 0"), docs, turn)
    return out.select("document_id", "sequence", "state", F.round(F.get("vector", 0).cast("double"), 5).alias("first"))


@query("""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS m FROM v),
q AS (SELECT label AS query_id, min_by(e, vec_id) AS e, min_by(m, vec_id) AS m FROM u GROUP BY label),
s AS (SELECT query_id, u.vec_id AS key, round(list_sum(list_transform(list_zip(u.e, q.e), lambda p: p[1] * p[2])) / (u.m * q.m), 6) AS score FROM u, q)
SELECT query_id, rank, key FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key)::INTEGER AS rank FROM s) WHERE rank <= 8
""")
def nearest_to_labels(spark, d):
    """The vectors nearest to the first one of each label, from blocks kept in single precision."""
    rows = table(spark, d, "embeddings")
    asked = rows.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    return nearest_in_blocks(vector_blocks(rows, "vec_id", "embedding"), asked, 8).select("query_id", "rank", "key")


@query("""
SELECT c_custkey AS path, 1 AS page, 'Customer (' || c_name || ')' || chr(10) || c_mktsegment AS text, NULL AS issue FROM customer
UNION ALL SELECT c_custkey, 2, CASE WHEN c_nationkey % 5 > 0 THEN 'nation ' || c_nationkey ELSE '' END, CASE WHEN c_nationkey % 5 = 0 THEN 'empty-page' END FROM customer
""")
def pdf_pages(spark, d):
    """A file of two pages for each customer; the second one is empty for some nations."""
    part = lambda n, body: f"'{n} 0 obj << /Length ' || length({body}) || ' >> stream\\n' || {body} || '\\nendstream endobj\\n'"
    one = "'BT /F1 9 Tf 9 9 Td (Customer \\\\(' || c_name || '\\\\)) Tj 0 -9 Td (' || c_mktsegment || ') Tj ET'"
    two = "CASE WHEN c_nationkey % 5 > 0 THEN 'BT [(nat) (ion) -500 (' || c_nationkey || ')] TJ ET' ELSE 'q Q' END"
    head = "'%PDF-1.4\\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\\n2 0 obj << /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 >> endobj\\n3 0 obj << /Type /Page /Contents 5 0 R >> endobj\\n4 0 obj << /Type /Page /Contents 6 0 R >> endobj\\n'"
    files = dealt(table(spark, d, "customer"), "c_custkey").select(F.col("c_custkey").cast("string").alias("path"), F.expr(f"encode({head} || {part(5, one)} || {part(6, two)} || 'trailer << /Root 1 0 R >>', 'ISO-8859-1')").alias("content"))
    return read_pdf(files).select(F.col("path").cast("long").alias("path"), "page", "text", "issue")
