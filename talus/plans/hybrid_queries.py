"""Searches with a vector and a word leg, as they are asked for; recall of memories and what it changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import tables
from talus.operators import memories as mem, recall

from . import bindings as b
from .registry import ORACLE, query
from .search_queries import ACL, ME, NAMED, NAMES, PAIRS_SQL, cover_sql, places_sql, toks, word_sim_sql

MINE = "tenant_id = 't1' AND owner_user_id = 'u1'"
SCORE = "round(s, 6) AS score"


def _fuse(key: str, k: int) -> str:
    return f"top AS (SELECT {key}, sum(1.0::DOUBLE / (60 + rnk)) AS s FROM (SELECT * FROM dense UNION ALL SELECT * FROM lex) GROUP BY {key} ORDER BY s DESC, {key} LIMIT {k})"


def _cover(rows: str, key: str, text: str, words: tuple[str, str], limit: int) -> str:
    """Ranks by cover density of both words."""
    return f"""{places_sql(rows, key, text, list(words))}, {cover_sql(2)},
lex AS (SELECT key AS {key}, row_number() OVER (ORDER BY r DESC, key) AS rnk FROM (SELECT * FROM cover ORDER BY r DESC, key LIMIT {limit}))"""


@query(b.sql(f"""WITH {word_sim_sql('messages', ['para', 'avec'], f"{NAMED} AND {MINE}")},
dense AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS rnk FROM (SELECT m.id, list_dot_product(m.dense, qv) AS s FROM message_vectors m JOIN threads c USING (conv_id), qvec WHERE m.dense IS NOT NULL AND {ACL} ORDER BY s DESC, id LIMIT 40)),
lex AS (SELECT id, row_number() OVER (ORDER BY sim DESC, id) AS rnk FROM (SELECT conv_id * 1000 + seq AS id, sim FROM ws ORDER BY sim DESC, id LIMIT 40)), {_fuse('id', 10)}
SELECT id, m.conv_id, m.role, platform, title, nullif(dominant_topic, '') AS topic, cluster_label, {SCORE} FROM top JOIN message_vectors m USING (id) JOIN threads t ON t.conv_id = m.conv_id LEFT JOIN clusters ON cluster_id = t.conv_id % 13""", "message_vectors", "threads", "clusters", "qvec"))
def message_hybrid_search(spark, d):
    t = b.threads(spark, d).withColumn("topic_cluster_id", F.col("conv_id") % 13)
    return recall.search_messages(b.message_vectors(spark, d), t, b.clusters(spark, d), b.query_vector(spark, d), NAMES, ME).withColumn("score", F.round("score", 6))


@query(b.sql(f"""SELECT id, m.conv_id, m.role, platform, title, nullif(dominant_topic, '') AS topic, cluster_label, {SCORE}
FROM (SELECT m.*, c.platform, c.title, c.dominant_topic, list_dot_product(m.dense, qv) AS s FROM message_vectors m JOIN threads c USING (conv_id), qvec WHERE m.dense IS NOT NULL AND {ACL}) m
LEFT JOIN clusters ON cluster_id = conv_id % 13 ORDER BY s DESC, id LIMIT 10""", "message_vectors", "threads", "clusters", "qvec"))
def message_dense_search(spark, d):
    """A blank query."""
    t = b.threads(spark, d).withColumn("topic_cluster_id", F.col("conv_id") % 13)
    return recall.search_messages(b.message_vectors(spark, d), t, b.clusters(spark, d), b.query_vector(spark, d), " ", ME).withColumn("score", F.round("score", 6))


@query(b.sql(f"""WITH mine AS MATERIALIZED (SELECT f.*, c.platform FROM facts f JOIN threads c USING (conv_id) WHERE {ACL}),
dense AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS rnk FROM (SELECT id, list_dot_product(dense, qv) AS s FROM mine, qvec WHERE dense IS NOT NULL ORDER BY s DESC, id LIMIT 40)),
{_cover('mine', 'id', 'fact_text', ('the', 'of'), 40)}, {_fuse('id', 10)}
SELECT id, conv_id, fact_text, platform, {SCORE} FROM top JOIN mine USING (id)""", "facts", "threads", "qvec"))
def fact_hybrid_search(spark, d):
    return recall.search_facts(b.facts(spark, d), b.threads(spark, d), b.query_vector(spark, d), "the of", ME).withColumn("score", F.round("score", 6))


@query(b.sql(f"""WITH {word_sim_sql("(SELECT entry_date AS conv_id, 0 AS seq, body AS content FROM diary_entries)", ['para', 'avec'], NAMED)},
dense AS (SELECT entry_date, row_number() OVER (ORDER BY s DESC, entry_date) AS rnk FROM (SELECT entry_date, list_dot_product(dense, qv) AS s FROM diary_entries, qvec WHERE dense IS NOT NULL ORDER BY s DESC, entry_date LIMIT 20)),
lex AS (SELECT entry_date, row_number() OVER (ORDER BY sim DESC, entry_date) AS rnk FROM (SELECT conv_id AS entry_date, sim FROM ws ORDER BY sim DESC, entry_date LIMIT 20)), {_fuse('entry_date', 5)}
SELECT CAST(entry_date AS VARCHAR) AS entry_date, CASE WHEN length(body) > 500 THEN substr(body, 1, 500) || '…' ELSE coalesce(body, '') END AS excerpt, {SCORE} FROM top JOIN diary_entries USING (entry_date)""", "diary_entries", "qvec"))
def diary_hybrid_search(spark, d):
    out = recall.search_diary(b.diary_entries(spark, d), b.query_vector(spark, d), NAMES)
    return out.select(F.col("entry_date").cast("string").alias("entry_date"), "excerpt", F.round("score", 6).alias("score"))


@query(b.sql(f"""WITH shelf AS (SELECT 'book' AS kind, doc_id AS id, list_dot_product(dense, qv) AS s FROM corpus, qvec WHERE lang = 'en' AND dense IS NOT NULL ORDER BY s DESC, id LIMIT 8),
media AS MATERIALIZED (SELECT * FROM corpus WHERE lang <> 'en'),
dense AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS rnk FROM (SELECT doc_id, list_dot_product(dense, qv) AS s FROM media, qvec WHERE dense IS NOT NULL ORDER BY s DESC, doc_id LIMIT 100)),
{_cover('media', 'doc_id', 'text', ('que', 'de'), 100)},
fused AS (SELECT 'media' AS kind, doc_id AS id, 1.0::DOUBLE / (20 + coalesce(a.rnk, 101)) + 1.0::DOUBLE / (20 + coalesce(b.rnk, 101)) AS s FROM dense a FULL JOIN lex b USING (doc_id) ORDER BY s DESC, id LIMIT 8)
SELECT kind, id, {SCORE} FROM (SELECT * FROM shelf UNION ALL SELECT * FROM fused) ORDER BY s DESC, kind, id LIMIT 8""", "corpus", "qvec"))
def library_hybrid_search(spark, d):
    c = b.corpus(spark, d)
    return recall.search_library(c.where("lang = 'en'"), c.where("lang <> 'en'"), b.query_vector(spark, d), "que de").withColumn("score", F.round("score", 6))


@query(b.sql(f"""SELECT title, platform, seq, role, content FROM (SELECT * FROM threads c WHERE (platform || ':' || conv_id) LIKE '%:7' AND {ACL}) JOIN messages USING (conv_id)""", "threads"))
def thread_by_bare_id(spark, d):
    t = b.threads(spark, d).withColumn("key", F.col("conv_id")).withColumn("conv_id", F.concat_ws(":", "platform", F.col("key").cast("string")))
    return recall.thread_of(t, b.messages(spark, d), "7", ME)


@query(b.sql(f"""SELECT count(*) AS n_messages FROM (SELECT * FROM threads c WHERE (platform || ':' || conv_id) LIKE '%:10' AND {ACL}) JOIN messages USING (conv_id)""", "threads"))
def thread_out_of_reach(spark, d):
    """A thread of another tenant: nothing, as if there were none."""
    t = b.threads(spark, d).withColumn("key", F.col("conv_id")).withColumn("conv_id", F.concat_ws(":", "platform", F.col("key").cast("string")))
    return recall.thread_of(t, b.messages(spark, d), "10", ME).agg(F.count(F.lit(1)).alias("n_messages"))


@query(b.sql(f"""WITH hit AS (SELECT *, {toks('body')} AS t FROM enriched)
SELECT id, round(base_score * recency_factor + semantic_sim * 0.5, 6) AS rank_score FROM hit
WHERE (list_contains(t, 'with') AND list_contains(t, 'from')) OR (list_contains(t, 'para') AND NOT list_contains(t, 'los')) ORDER BY base_score * recency_factor + semantic_sim * 0.5 DESC, last_dubbed_at DESC, id LIMIT 20""", "enriched"))
def memory_linear_text_rank(spark, d):
    rows = mem.enriched(b.memories(spark, d), b.telemetry(spark, d), b.allowlist(spark, d), b.as_of(), "src1", True, b.query_vector(spark, d))
    return mem.rank_linear(rows, 20, "with from or para -los").select("id", F.round("rank_score", 6).alias("rank_score"))


_RECALL = f"""dense AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS rnk FROM (SELECT id, list_cosine_similarity(dense, qv) AS s FROM enriched WHERE dense IS NOT NULL ORDER BY s DESC, id LIMIT 100)),
{places_sql('enriched', 'id', 'body', ['that', 'with'])}, {PAIRS_SQL}, lex AS (SELECT key AS id, row_number() OVER (ORDER BY r DESC, key) AS rnk FROM (SELECT * FROM pairs ORDER BY r DESC, key LIMIT 100)),
sums AS (SELECT id, sum(1.0::DOUBLE / (60 + rnk)) AS s FROM (SELECT * FROM dense UNION ALL SELECT * FROM lex) GROUP BY id),
hits AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY s DESC, base_score * recency_factor DESC, last_dubbed_at DESC, id) AS r FROM sums JOIN enriched USING (id) ORDER BY r LIMIT 10),
near AS (SELECT target_memory_pk AS id, min(r) AS r FROM edges JOIN hits h ON h.id = source_memory_pk WHERE target_memory_pk NOT IN (SELECT id FROM hits) AND target_memory_pk IN (SELECT id FROM visible) GROUP BY 1 ORDER BY r, 1 LIMIT 5)"""


@query(b.sql(f"""WITH {_RECALL} SELECT 'hit' AS kind, id, CAST(r AS INT) AS r, CAST(coalesce(activation_count, 0) + 1 AS INT) AS activation_count FROM hits LEFT JOIN telemetry ON memory_pk = id
UNION ALL SELECT 'linked', id, CAST(r AS INT), CAST(coalesce(activation_count, 0) AS INT) FROM near LEFT JOIN telemetry ON memory_pk = id
UNION ALL SELECT 'audit', NULL, (SELECT CAST(count(*) AS INT) FROM hits), NULL""", "enriched", "edges"))
def memory_recall(spark, d):
    """Rank, audit, bump and expand in one: hits with their new counts, the audit row's number of ids, and linked memories."""
    m, t, a = b.memories(spark, d), b.telemetry(spark, d), b.allowlist(spark, d)
    rows = mem.enriched(m, t, a, b.as_of(), "src1", True, b.query_vector(spark, d))
    hits, audit, after, near = recall.recall(rows, m, t, a, b.edges(spark, d), b.as_of(), "src1", "that with", 10)
    count = after.select(F.col("memory_pk").alias("id"), F.col("activation_count").cast("int").alias("activation_count"))
    one = hits.select(F.lit("hit").alias("kind"), "id", F.col("hit_rank").alias("r")).join(count, "id", "left")
    two = near.select(F.lit("linked").alias("kind"), "id", F.col("src_rank").cast("int").alias("r")).join(count, "id", "left").withColumn("activation_count", F.coalesce("activation_count", F.lit(0)))
    log = audit.select(F.lit("audit").alias("kind"), F.lit(None).cast("long").alias("id"), F.size("returned_ids").alias("r"), F.lit(None).cast("int").alias("activation_count"))
    return one.unionByName(two).unionByName(log)


def _table_functions(spark, d):
    tables.register(spark, b.memories(spark, d), b.telemetry(spark, d), b.allowlist(spark, d), b.edges(spark, d))
    vector = ", ".join(f"{float(x)!r}D" for x in b.query_vector(spark, d).first().qv)  # one vector, written into the query
    return f"array({vector})", f"TIMESTAMP'{b.AS_OF}'"


@query(ORACLE["memory_rrf_rank"])
def memory_rank_function(spark, d):
    """The fused rank as a table function of SQL."""
    vector, as_of = _table_functions(spark, d)
    return spark.sql(f"SELECT id, round(rank_score, 6) AS rank_score FROM talus_ranked_memories('that with', {vector}, 'src1', true, 20, {as_of})")


@query(ORACLE["memory_list_mode"])
def memory_list_function(spark, d):
    """Without a query: by importance."""
    _, as_of = _table_functions(spark, d)
    return spark.sql(f"SELECT id, round(rank_score, 6) AS rank_score FROM talus_ranked_memories('', NULL, 'src1', true, 500, {as_of})")


@query(b.sql("""WITH n AS (SELECT p.doc_id AS seed, target_memory_pk AS id, min(CASE source_memory_pk WHEN p.doc_id THEN 1 ELSE 2 END) AS r FROM documents p JOIN edges e ON e.source_memory_pk IN (p.doc_id, p.doc_id + 1)
WHERE target_memory_pk NOT IN (p.doc_id, p.doc_id + 1) AND target_memory_pk IN (SELECT id FROM visible) AND source_memory_pk IN (SELECT id FROM memories WHERE deleted_at IS NULL) GROUP BY ALL)
SELECT seed, id, CAST(row_number() OVER (PARTITION BY seed ORDER BY r, id) AS INT) AS place FROM n QUALIFY place <= 2""", "enriched", "edges"))
def memory_neighbour_function(spark, d):
    """The neighbours of each memory and the next, joined laterally."""
    _table_functions(spark, d)
    return spark.sql("SELECT d.id AS seed, n.id, n.place FROM talus_memories d, LATERAL talus_memory_neighbours(array(d.id, d.id + 1), 'src1', true, 2) n")


@query(b.sql("SELECT CAST(entry_date AS VARCHAR) AS entry_date, conv_count, body FROM diary_entries WHERE entry_date = DATE '2024-01-15'", "diary_entries"))
def diary_on_date(spark, d):
    e = b.diary_entries(spark, d).where(F.col("entry_date") == F.lit("2024-01-15").cast("date"))
    return e.select(F.col("entry_date").cast("string").alias("entry_date"), "conv_count", "body")
