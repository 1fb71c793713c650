"""All queries of the engine by name, each over whole tables, with the SQL that states it where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions import paths as P
from lodestrata.functions import text as X
from lodestrata.operators import aggregates as A
from lodestrata.operators import enumeration as N
from lodestrata.operators import evaluation as V
from lodestrata.operators import filters as L
from lodestrata.operators import joins as J
from lodestrata.operators import lifecycle as C
from lodestrata.operators import ranking as R
from lodestrata.operators.chunking import chunk_markdown
from lodestrata.operators.lineage import cut
from lodestrata.plans import answering
from lodestrata.plans.catalog import ORACLE_SQL, QUERIES, query, table
from lodestrata.streaming import events as E

QUESTIONS = [(1, "Which license does the text name?"), (2, "the stone that was in the order")]


@query()
def answer_question(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return answering.answer(docs, answering.questions_of(spark, QUESTIONS))


@query()
def markdown_chunks(spark, d):
    return chunk_markdown(table(spark, d, "documents").select("doc_id", "text"))


@query("""
SELECT sha256(text) AS content_sha256, min(doc_id) AS first_id, count(*) AS copies, max(n_chars) AS token_estimate
FROM documents GROUP BY 1
""")
def content_groups(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("content_sha256")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.max("n_chars").alias("token_estimate"))


@query("""
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf
FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY term
""")
def term_statistics(spark, d):
    posts = R.postings(table(spark, d, "documents"), ["doc_id"], {"en": X.all_matches(F.lower("text"), "[a-z0-9]+")})
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


LEXICAL = """
t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
len AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS l FROM documents),
wanted AS (SELECT unnest(['license', 'the', 'stupid', 'that']) AS term),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t JOIN wanted USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT (SELECT count(*) FROM len) AS n, (SELECT avg(l) FROM len) AS avgl),
lex AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (
  SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avgl))), 6) AS score
  FROM tf JOIN df USING (term) JOIN len USING (doc_id) CROSS JOIN s GROUP BY doc_id))
"""


def _lexical(spark, d, k: int) -> DataFrame:
    asked = ["license", "the", "stupid", "that"]
    rows = cut(table(spark, d, "documents").select("doc_id", *_counted_terms(asked)))
    posts, lengths = R.postings(rows, ["doc_id"], {"en": F.col("hits")}), rows.select("doc_id", "length")
    terms = spark.createDataFrame([(1, t, "en") for t in asked], "query_id int, term string, field string")
    return R.top_k(R.bm25(posts, lengths, terms, ["doc_id"]), k, ["doc_id"])


@query(f"WITH {LEXICAL} SELECT 1 AS query_id, doc_id, score, r::INTEGER AS rank FROM lex WHERE r <= 8")
def lexical_top8(spark, d):
    return _lexical(spark, d, 8)


def _counted_terms(asked: list[str]):
    """Of a text's terms those that are asked, and the number of all: one pass over the text, and no other term is grouped."""
    terms = X.all_matches(F.lower("text"), "[a-z0-9]+")
    return F.filter(terms, lambda t: t.isin(asked)).alias("hits"), F.size(terms).alias("length")


def _query_vector(vectors: DataFrame) -> list[float]:
    return vectors.orderBy("vec_id").select("embedding").first()[0]


KNN = """
v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS m FROM v),
q AS (SELECT e, m FROM u ORDER BY vec_id LIMIT 1),
k AS (SELECT u.vec_id, round(list_sum(list_transform(list_zip(u.e, q.e), lambda p: p[1] * p[2])) / (u.m * q.m), 6) AS score FROM u CROSS JOIN q)
"""


@query(f"WITH {KNN} SELECT vec_id, score FROM k ORDER BY score DESC, vec_id LIMIT 50")
def vector_top50(spark, d):
    vectors = table(spark, d, "embeddings")
    return R.nearest(vectors, _query_vector(vectors), 50, ["vec_id"], "embedding").select("vec_id", "score")


@query(f"""
WITH {LEXICAL}, {KNN}, near AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM k),
head AS (SELECT doc_id, row_number() OVER (ORDER BY (source = 'src12') DESC, doc_id) AS r FROM documents WHERE starts_with(source, 'src1')),
f AS (SELECT doc_id, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0) + coalesce(1.0 / (60 + c.r), 0), 9) AS score
      FROM (FROM lex WHERE r <= 50) a FULL JOIN (FROM near WHERE r <= 50) b USING (doc_id) FULL JOIN (FROM head WHERE r <= 50) c USING (doc_id))
SELECT doc_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 8
""")
def fused_top8(spark, d):
    """Full text, nearest vectors and headings, 50 candidates each, fused."""
    one = lambda df: R.top_k(df.withColumn("query_id", F.lit(1)), 50, ["doc_id"]).select("query_id", "doc_id", "rank")
    vectors = table(spark, d, "embeddings")
    near = R.nearest(vectors.withColumn("doc_id", F.col("vec_id")), _query_vector(vectors), 50, ["doc_id"], "embedding")
    heads = table(spark, d, "documents").select("doc_id", F.array("source").alias("heading_path"))
    found = R.heading_matches(heads, ["src1", "SRC12"], 50, ["doc_id"])
    return answering.hybrid(_lexical(spark, d, 50).select("query_id", "doc_id", "rank"), one(near), one(found), 8, ["doc_id"]).select("doc_id", "score", "rank")


@query("SELECT coalesce(lang, 'unlabelled') AS material_type, count(DISTINCT doc_id) AS documents, count(*) AS blocks FROM documents GROUP BY 1")
def scope_preview(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("material_type"))
    return A.scope_preview(rows)


@query("""
SELECT o_custkey AS vault_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS running, count(*) FILTER (o_orderstatus = 'P') AS attention,
       count(*) FILTER (o_orderstatus = 'F') AS completed, max(o_orderdate) AS last_change FROM orders GROUP BY 1
""")
def task_overview(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "blocked").otherwise("completed")
    return A.workbench(table(spark, d, "orders").select(F.col("o_custkey").alias("vault_id"), status.alias("status"), F.col("o_orderdate").alias("updated_at")))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_quantity DESC) = 1
""")
def latest_revision(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return J.latest(rows.withColumn("__order", F.struct("l_linenumber", "l_partkey", "l_quantity")), ["l_orderkey"], "__order").drop("__order")


@query("""
SELECT c_custkey AS source_id, (SELECT min_by(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey = c_custkey) AS first_task_id FROM customer
""")
def first_reference(spark, d):
    sources = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"))
    refs = table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("task_id"))
    return J.first_reference(sources, refs)


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def orphan_sources(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return J.without(table(spark, d, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"])


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS messages FROM customer")
def message_counts(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return J.with_count(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey", "messages")


@query("""
SELECT user_id, a.n AS old, b.n AS new, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) a
FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1) b USING (user_id) WHERE a.n IS DISTINCT FROM b.n
""")
def snapshot_difference(spark, d):
    events = table(spark, d, "events")
    part = lambda c: events.where(c).groupBy("user_id").agg(F.count("*").alias("n"))
    return J.diff(part("event_type = 'click'"), part("event_type <> 'click'"), "user_id", "n")


@query("SELECT event_id, event_type, user_id FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events)")
def event_cursor(spark, d):
    events = table(spark, d, "events")
    cursor = A.latest_event(events).first().event_id // 2
    return E.after_cursor(events.select("event_id", "event_type", "user_id"), cursor)


@query("""
SELECT conv_id, string_agg(trim(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 160)), ' ' ORDER BY turn) AS query FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user') WHERE r <= 3 GROUP BY conv_id
""")
def conversation_query(spark, d):
    return X.conversation_queries(table(spark, d, "conversations"), "conv_id")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def daily_events(spark, d):
    return E.daily_counts(table(spark, d, "events")).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("""
SELECT l_returnflag, l_extendedprice FROM (
  SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
WHERE r = greatest(ceil(n * 0.95), 1)
""")
def nearest_rank_p95(spark, d):
    return A.percentile_nearest(table(spark, d, "lineitem"), "l_extendedprice", 0.95, ["l_returnflag"])


@query("SELECT l_returnflag, median(l_quantity) AS l_quantity FROM lineitem GROUP BY 1")
def median_quantity(spark, d):
    return A.median(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"])


RANKED = """
WITH r AS (SELECT d.source AS query_id, d.doc_id AS item_id, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS rank FROM documents d JOIN labels USING (doc_id)),
g AS (SELECT d.source AS query_id, d.doc_id AS item_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1),
h AS (SELECT query_id, count(*) AS hits, min(rank) AS first FROM r JOIN g USING (query_id, item_id) WHERE rank <= 8 GROUP BY 1),
s AS (SELECT query_id, count(*) AS shown FROM r WHERE rank <= 8 GROUP BY 1),
b AS (SELECT query_id, count(*) AS relevant FROM g GROUP BY 1)
"""


def _ranked(spark, d):
    w = W.partitionBy("query_id").orderBy(F.desc("n_chars"), "item_id")
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").alias("item_id"), "n_chars", "quality")
    return rows.withColumn("rank", F.row_number().over(w)), rows.where("quality = 1").select("query_id", "item_id")


@query(RANKED + "SELECT query_id, coalesce(hits, 0) / relevant AS recall, coalesce(hits, 0) / shown AS precision, coalesce(1.0 / first, 0) AS reciprocal_rank FROM b JOIN s USING (query_id) LEFT JOIN h USING (query_id)")
def recall_at_8(spark, d):
    ranked, relevant = _ranked(spark, d)
    return V.recall_at(ranked, relevant, 8)


@query(RANKED + "SELECT round(avg(coalesce(hits, 0) / relevant), 9) AS recall, round(avg(coalesce(hits, 0) / shown), 9) AS precision FROM b JOIN s USING (query_id) LEFT JOIN h USING (query_id)")
def macro_metrics(spark, d):
    ranked, relevant = _ranked(spark, d)
    return A.macro_average(V.recall_at(ranked, relevant, 8), "recall", "precision").select(F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


RULES = [("r1", "completely-ignore", "en"), ("r2", "do-not-index", "de"), ("r3", "never-send-cloud", "fr")]


@query("""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)) AS path FROM pages)
SELECT page_id, NOT (path = 'en' OR path LIKE 'en/%' OR path = 'de' OR path LIKE 'de/%') AS allowed,
  CASE WHEN path = 'en' OR path LIKE 'en/%' THEN 'ignored at every stage' WHEN path = 'de' OR path LIKE 'de/%' THEN 'not to be indexed or retrieved' ELSE 'no rule blocks this stage' END AS reason
FROM p
""")
def policy_decisions(spark, d):
    items = table(spark, d, "pages").select(F.col("page_id").alias("item_id"), F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1).alias("source_path"), F.lit(None).cast("string").alias("derived_path"))
    rules = spark.createDataFrame(RULES, "rule_id string, kind string, relative_path string")
    return L.evaluate_policy(items, rules, "index").select(F.col("item_id").alias("page_id"), "allowed", "reason")


@query("SELECT page_id, url FROM pages WHERE regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) = 'en' OR starts_with(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), 'en/')")
def directory_scope(spark, d):
    rows = table(spark, d, "pages").withColumn("relative_path", F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1))
    return L.in_scope(rows, "en").select("page_id", "url")


@query("""
SELECT doc_id, source, (SELECT count(*) FROM documents) AS total_rows, (SELECT greatest(ceil(count(*) / 25), 1)::BIGINT FROM documents) AS pages
FROM documents ORDER BY source, doc_id LIMIT 25 OFFSET 50
""")
def listing_page(spark, d):
    return R.page(table(spark, d, "documents").select("doc_id", "source"), ["source", "doc_id"], 3, 25).withColumn("pages", F.col("pages").cast("long"))


@query("SELECT doc_id, sha256(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\\s+|\\s+$', '', 'g')) AS block_content_sha256 FROM documents")
def block_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", X.block_hash(F.col("text")).alias("block_content_sha256"))


@query("""
SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]|[^\\s]'), lambda t: 1)), 0)::BIGINT AS signs,
  coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+|[^\\s]'), lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z0-9_]+$') THEN ceil(length(t) / 3) ELSE 1 END)), 0)::BIGINT AS tokens
FROM documents
""")
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.all_matches(F.col("text"), r"[A-Za-z0-9_]|[^\s]")).cast("long").alias("signs"), X.provider_token_estimate(F.col("text")).cast("long").alias("tokens"))


@query("""
SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'algebra|equation|geometry|calculus|math|数学|代数') THEN 'mathematics' WHEN regexp_matches(lower(text), 'english|vocabulary|grammar|language|英语|词汇|语法') THEN 'language'
  WHEN regexp_matches(lower(text), 'physics|chemistry|biology|science|物理|化学|生物') THEN 'science' WHEN regexp_matches(lower(text), 'history|historical|历史') THEN 'history'
  WHEN regexp_matches(lower(text), 'programming|software|code|技术|编程') THEN 'technology' ELSE 'unclassified' END AS domain FROM documents
""")
def domain_classes(spark, d):
    return table(spark, d, "documents").select("doc_id", X.domain_of(F.col("text"))["domain"].alias("domain"))


@query("""
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '全部|所有|整章|整册|完整|清单|列出|every ') OR regexp_matches(lower(text), '\\ball\\b') THEN 'completeness'
  WHEN regexp_matches(lower(text), '深度创作|创作|写文章|撰写|draft|write an') THEN 'deep-creation' WHEN regexp_matches(lower(text), '知识整理|整理|总结|归纳|知识点|默写|复习') THEN 'knowledge-organization'
  WHEN regexp_matches(lower(text), '重点|核心|要点|关键|概念与方法|概念和方法|知识框架|主题概览|key concepts|core concepts|key decisions|key points|overview')
    AND NOT regexp_matches(lower(text), '什么|怎么|如何|为何|为什么|\\?|？|\\b(what|how|why|where|when|which)\\b') THEN 'knowledge-organization' ELSE 'source-lookup' END AS intent
FROM conversations
""")
def query_intents(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.query_intent(F.col("text")).alias("intent"))


@query("SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) AS ordinal, CASE WHEN row_number() OVER (ORDER BY source, doc_id) > 500 THEN 'uncovered' ELSE 'planned' END AS disposition FROM documents")
def coverage_plan(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source")
    docs = rows.select(F.col("doc_id").alias("document_id"), F.col("source").alias("relative_path"), F.lit(False).alias("excluded"))
    blocks = rows.select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("sequence"), F.array().cast("array<string>").alias("heading_path"))
    return N.coverage(docs, blocks, 500).select(F.col("document_id").alias("doc_id"), F.col("relative_path").alias("source"), "ordinal", "disposition")


@query()
def duplicate_clusters(spark, d):
    """Pages whose headings share a term, host by host."""
    heading = F.array_join(F.transform(F.regexp_extract_all("html", F.lit("(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1)), lambda h: F.regexp_replace(h, "<[^>]*>", " ")), " ")
    rows = table(spark, d, "pages").select(F.col("page_id").alias("ordinal"), F.coalesce(F.regexp_extract("url", "//([^/?#]*)", 1), F.lit("")).alias("knowledge_kind"), X.concept_terms(F.coalesce(heading, F.lit(""))).alias("concept_terms"))
    return N.candidate_clusters(rows)


@query(f"""
WITH RECURSIVE t AS (SELECT coalesce(source, '') AS source, doc_id, sha256(text) AS hash, CASE WHEN contains(lower(text), 'license') THEN 5 ELSE 6 END AS kind,
  list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+|[^\\s]'), lambda x: CASE WHEN regexp_full_match(x, '[A-Za-z0-9_]+') THEN (length(x) + 2) // 3 ELSE 1 END)) AS tokens FROM documents),
i AS (SELECT source, min(doc_id) AS ordinal, min_by(kind, doc_id) AS kind, greatest(coalesce(max(tokens), 0), 1)::BIGINT AS cost FROM t GROUP BY source, hash),
f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY kind, ordinal) AS k FROM i WHERE cost <= 4000),
walk AS (
  SELECT source, k, kind, 1 AS batch, cost AS held FROM f WHERE k = 1
  UNION ALL
  SELECT f.source, f.k, f.kind, CASE WHEN f.kind <> w.kind OR held + f.cost > 4000 THEN batch + 1 ELSE batch END, CASE WHEN f.kind <> w.kind OR held + f.cost > 4000 THEN f.cost ELSE held + f.cost END FROM walk w JOIN f ON f.source = w.source AND f.k = w.k + 1
)
SELECT i.source, i.ordinal, CASE WHEN batch <= 12 THEN batch ELSE 0 END::INTEGER AS batch FROM i LEFT JOIN f ON f.source = i.source AND f.ordinal = i.ordinal LEFT JOIN walk w ON w.source = f.source AND w.k = f.k
""")
def map_reduce_plan(spark, d):
    kind = F.when(F.contains(F.lower("text"), F.lit("license")), "exercise").otherwise("other")
    rows = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").alias("ordinal"), kind.alias("knowledge_kind"), F.sha2("text", 256).alias("block_content_sha256"), X.provider_token_estimate(F.col("text")).alias("token_estimate"))
    return N.map_reduce_batches(N.first_of_content(rows, "source"), 4000, 12, "source")


@query("""
SELECT c.conv_id, c.turn, n.turn AS near_turn, n.role AS near_role FROM conversations c JOIN conversations n ON c.conv_id = n.conv_id AND n.turn IN (c.turn - 1, c.turn + 1) WHERE c.role = 'user'
""")
def neighbour_turns(spark, d):
    turns = table(spark, d, "conversations")
    hits = turns.where("role = 'user'").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("sequence"), F.col("turn").alias("rank"), F.lit(1.0).alias("score"))
    near = J.neighbours(hits, turns.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("sequence"), "role"))
    return near.select(F.col("document_id").alias("conv_id"), F.col("hit_rank").alias("turn"), F.col("sequence").alias("near_turn"), F.col("role").alias("near_role"))


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'apache license') OR contains(lower(source), 'apache license')")
def text_search(spark, d):
    return L.search(table(spark, d, "documents"), "Apache License", "text", "source").select("doc_id", "source")


@query("SELECT doc_id, text LIKE '%/%' AND regexp_matches(text, 'file://[^\\s\"''`]+|(^|[^a-zA-Z0-9_:/])/[^\\s/\"''`]+|(^|[^a-zA-Z0-9_])[a-zA-Z]:[\\\\/]') AS leaks FROM documents")
def path_leaks(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.contains("text", F.lit("/")) & P.holds_absolute_path(F.col("text"))).alias("leaks"))


@query("""
SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id IS NOT DISTINCT FROM d.doc_id AND l.quality IS NOT DISTINCT FROM CASE WHEN d.n_chars > 100 THEN 1 END)
""")
def manifest_members(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 100, 1).alias("quality"))
    return L.in_manifest(docs, table(spark, d, "labels"), ["doc_id", "quality"]).select("doc_id")


@query("""
SELECT n_nationkey AS key, coalesce(s_name, n_name) AS name FROM nation FULL JOIN (SELECT s_nationkey AS n_nationkey, max(s_name) AS s_name FROM supplier GROUP BY 1) USING (n_nationkey)
""")
def merged_names(spark, d):
    base = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    changes = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.max("s_name").alias("name"))
    return C.merge(base, changes, ["key"])


@query("""
SELECT a.page_id, a.url, coalesce(b.n, 0) AS notes FROM pages a LEFT JOIN (SELECT lower(url) AS k, count(*) AS n FROM pages GROUP BY 1) b ON lower(a.url) = b.k
""")
def files_with_notes(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    docs = pages.select(F.col("url").alias("source_path"), F.col("page_id").alias("document_id"), F.lit("").alias("indexed_at"))
    return J.along_path(pages.withColumn("relative_path", F.col("url")), docs).select("page_id", "url", "notes")


@query("""
SELECT source, sha256('[' || string_agg('{"k":' || doc_id || ',"v":' || n_chars || '}', ',' ORDER BY doc_id, n_chars) || ']') AS digest FROM documents GROUP BY source
""")
def snapshot_digests(spark, d):
    return C.snapshot_digest(table(spark, d, "documents"), "doc_id", "n_chars", "source")


from lodestrata.plans import document_queries, operator_queries, text_queries  # noqa: E402, F401  register their queries too

__all__ = ["ORACLE_SQL", "QUERIES"]
