"""Search over the corpus: vector and lexical legs, fusion, access, batch lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import lexical, vectors
from talus.operators import access, fusion, memories as mem
from talus.operators.nearest import nearest_to_queries
from talus.session import bound_batches

from . import bindings as b
from .registry import query

TEXT, WORDS, PHRASE = "that with from", "thing nding", '"of the" with or inor -from'
#: Words of few messages, for the ranks by word similarity.
NAMES, NAMED = "para avec", "regexp_matches(content, '(?i)para|avec')"
ME = access.Principal("t1", "u1", ("team1", "team3"))
ACL = "c.tenant_id = 't1' AND (c.owner_user_id = 'u1' OR c.visibility = 'org' OR (c.visibility = 'team' AND c.team_id IN ('team1', 'team3')))"
TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+')"


def toks(x: str) -> str:
    return TOKENS.format(x)


def places_sql(rows: str, key: str, text: str, words: list[str]) -> str:
    """ctes occ(key, pos, w, j): places of the words in texts that hold all of them."""
    listed = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    return f"""occ AS MATERIALIZED (SELECT {key} AS key, i AS pos, t[i] AS w, row_number() OVER (PARTITION BY {key} ORDER BY i) AS j
FROM (SELECT {key}, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT {key}, {toks(text)} AS t FROM {rows}) WHERE list_has_all(t, {listed})) WHERE list_contains({listed}, t[i]))"""


def cover_sql(n: int) -> str:
    """cte cover(key, r): all extents that hold n words, and whose first and last word stand nowhere else within."""
    return f"""cover AS MATERIALIZED (SELECT key, round(sum(0.1::DOUBLE / (1 + (q - p) - (m - 1))), 9) AS r FROM (
SELECT a.key, a.pos AS p, b.pos AS q, count(*) AS m FROM occ a JOIN occ b ON a.key = b.key AND a.j <= b.j AND (a.j = b.j) = ({n} = 1) JOIN occ m ON m.key = a.key AND m.j BETWEEN a.j AND b.j
GROUP BY a.key, a.pos, b.pos, a.w, b.w HAVING count(DISTINCT m.w) = {n} AND count(*) FILTER (m.w = a.w) = 1 AND count(*) FILTER (m.w = b.w) = 1) GROUP BY key)"""


#: cte pairs(key, r): the weights of all pairs of places of different words.
PAIRS_SQL = """pairs AS MATERIALIZED (SELECT key, round(1 - product(1 - sqrt(0.01::DOUBLE * CASE WHEN d > 100 THEN 1e-30 ELSE 1.0::DOUBLE / (1.005 + 0.05 * exp(d / 1.5::DOUBLE - 2)) END)), 9) AS r
FROM (SELECT a.key, b.pos - a.pos AS d FROM occ a JOIN occ b ON a.key = b.key AND a.pos < b.pos AND a.w <> b.w) GROUP BY key)"""


def _q(spark, d):
    return F.broadcast(b.query_vector(spark, d))  # one row


@query(b.sql("SELECT doc_id, round(list_dot_product(dense, qv), 6) AS score FROM corpus, qvec WHERE dense IS NOT NULL ORDER BY list_dot_product(dense, qv) DESC, doc_id LIMIT 10", "corpus", "qvec"))
def dense_topk(spark, d):
    top = fusion.topk_by_vector(b.corpus(spark, d).crossJoin(_q(spark, d)), "dense", F.col("qv"), "doc_id", 10)
    return top.select("doc_id", F.round("score", 6).alias("score"))


@query(b.sql("SELECT doc_id, round(1 - list_cosine_similarity(dense, qv), 6) AS distance FROM corpus, qvec WHERE dense IS NOT NULL ORDER BY 1 - list_cosine_similarity(dense, qv), doc_id LIMIT 20", "corpus", "qvec"))
def dense_topk_cosine(spark, d):
    c = b.corpus(spark, d).where("dense is not null").crossJoin(_q(spark, d)).withColumn("distance", vectors.cosine_distance("dense", "qv"))
    return c.orderBy("distance", "doc_id").limit(20).select("doc_id", F.round("distance", 6).alias("distance"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)thing|nding')")
def lexical_regex_match(spark, d):
    return b.read(spark, d, "documents").where(lexical.matches_any_word("text", WORDS)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE list_has_all({toks('text')}, ['that', 'with', 'from'])")
def fts_and_match(spark, d):
    return b.read(spark, d, "documents").where(lexical.matches_all("text", TEXT)).select("doc_id")


@query(rf"""SELECT doc_id FROM (SELECT doc_id, {toks('text')} AS t FROM documents)
WHERE (contains(' ' || array_to_string(t, ' ') || ' ', ' of the ') AND list_contains(t, 'with')) OR (list_contains(t, 'inor') AND NOT list_contains(t, 'from'))""")
def websearch_match(spark, d):
    return b.read(spark, d, "documents").where(lexical.websearch("text", PHRASE)).select("doc_id")


@query(f"""WITH {places_sql('documents', 'doc_id', 'text', TEXT.split())}, {PAIRS_SQL} SELECT key AS doc_id, round(greatest(r, 1e-20), 6) AS rank FROM pairs ORDER BY r DESC, doc_id LIMIT 20""")
def ts_rank_topk(spark, d):
    c = b.read(spark, d, "documents").where(lexical.matches_all("text", TEXT)).select("doc_id", lexical.rank_text("text", TEXT).alias("r"))
    return c.orderBy(F.desc("r"), "doc_id").limit(20).select("doc_id", F.round("r", 6).alias("rank"))


@query(f"""WITH {places_sql('documents', 'doc_id', 'text', TEXT.split())}, {cover_sql(3)} SELECT doc_id, round(coalesce(r, 0), 6) AS cover FROM documents LEFT JOIN cover ON key = doc_id""")
def ts_rank_cover(spark, d):
    return b.read(spark, d, "documents").select("doc_id", F.round(lexical.rank_cover("text", TEXT), 6).alias("cover"))


@query(f"""WITH t AS (SELECT doc_id, {toks('text')} AS t FROM documents), n AS (SELECT doc_id, len(list_filter(t, lambda x: x = 'para')) AS a, len(list_filter(t, lambda x: x = 'avec')) AS b FROM t),
r AS (SELECT doc_id, round(0.1::DOUBLE * (coalesce(list_sum(list_transform(range(1, a + 1), lambda i: 1.0::DOUBLE / (i * i))), 0) + coalesce(list_sum(list_transform(range(1, b + 1), lambda i: 1.0::DOUBLE / (i * i))), 0)) / (2 * 1.64493406685::DOUBLE), 9) AS r FROM n WHERE a + b > 0)
SELECT doc_id, round(r, 6) AS rank FROM r ORDER BY r DESC, doc_id LIMIT 50""")
def ts_rank_either(spark, d):
    """A query one of whose words is enough."""
    c = b.read(spark, d, "documents").where(lexical.websearch("text", "para or avec")).select("doc_id", lexical.rank_text("text", "para or avec").alias("r"))
    return c.orderBy(F.desc("r"), "doc_id").limit(50).select("doc_id", F.round("r", 6).alias("rank"))


@query(rf"""WITH g AS (SELECT doc_id, list_distinct(flatten(list_transform(list_distinct({toks('text')}), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS x FROM documents),
q AS (SELECT list_distinct(flatten(list_transform(['that', 'with', 'from'], lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS y),
s AS (SELECT doc_id, len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) AS s FROM g, q)
SELECT doc_id, round(s, 6) AS sim FROM s ORDER BY s DESC, doc_id LIMIT 10""")
def trigram_similarity_topk(spark, d):
    bound_batches(spark)
    c = b.read(spark, d, "documents").select("doc_id", lexical.trigram_similarity("text", TEXT).alias("s"))
    return c.orderBy(F.desc("s"), "doc_id").limit(10).select("doc_id", F.round("s", 6).alias("sim"))


def word_sim_sql(rows: str, words: list[str], where: str) -> str:
    """ctes ws(conv_id, seq, sim): the greatest similarity of an extent of a message's trigrams; the best one begins and ends with a wanted trigram."""
    wanted = sorted({f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)})
    listed = "[" + ", ".join(f"'{g}'" for g in wanted) + "]"
    return f"""wg AS MATERIALIZED (SELECT conv_id, seq, flatten(list_transform({toks('content')}, lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))) AS g FROM {rows} WHERE {where}),
wp AS MATERIALIZED (SELECT conv_id, seq, g, list_filter(range(1, len(g) + 1), lambda i: list_contains({listed}, g[i])) AS p FROM wg),
ws AS MATERIALIZED (SELECT conv_id, seq, coalesce(max(len(list_filter(x, lambda t: list_contains({listed}, t)))::DOUBLE / ({len(wanted)} + len(list_filter(x, lambda t: NOT list_contains({listed}, t))))), 0.0) AS sim
FROM (SELECT a.conv_id, a.seq, list_distinct(a.g[a.i:b.j]) AS x FROM (SELECT *, unnest(p) AS i FROM wp) a LEFT JOIN (SELECT conv_id, seq, unnest(p) AS j FROM wp) b ON a.conv_id = b.conv_id AND a.seq = b.seq AND b.j >= a.i) GROUP BY ALL)"""


@query(b.sql(f"WITH {word_sim_sql('messages', ['para', 'avec'], NAMED)} SELECT conv_id, seq, round(sim, 6) AS sim FROM ws ORDER BY sim DESC, conv_id, seq LIMIT 20", "messages"))
def word_similarity_topk(spark, d):
    m = b.messages(spark, d).where(lexical.matches_any_word("content", NAMES)).select("conv_id", "seq", lexical.word_similarity("content", NAMES).alias("s"))
    return m.orderBy(F.desc("s"), "conv_id", "seq").limit(20).select("conv_id", "seq", F.round("s", 6).alias("sim"))


def _legs_sql(dense_where: str, lex_where: str, k: int) -> str:
    return f"""{places_sql(f'(SELECT c.doc_id, c.text FROM corpus c WHERE true{lex_where})', 'doc_id', 'text', TEXT.split())}, {cover_sql(3)},
dense AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS rnk FROM (SELECT c.doc_id, list_dot_product(dense, qv) AS s FROM corpus c, qvec WHERE dense IS NOT NULL{dense_where} ORDER BY s DESC, doc_id LIMIT {k})),
lex AS (SELECT key AS doc_id, row_number() OVER (ORDER BY r DESC, key) AS rnk FROM (SELECT * FROM cover ORDER BY r DESC, key LIMIT {k})) """


_RRF = "SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rnk)), 6) AS score FROM (SELECT * FROM dense UNION ALL SELECT * FROM lex) GROUP BY doc_id ORDER BY sum(1.0::DOUBLE / (60 + rnk)) DESC, doc_id LIMIT {0}"


def _legs(spark, d, pool, dense_where=None, lex_where=None):
    c = b.corpus(spark, d)
    near = fusion.topk_by_vector(c.crossJoin(_q(spark, d)), "dense", F.col("qv"), "doc_id", pool, "s", dense_where)
    near = fusion.ranked(near.select("doc_id", "s"), [F.desc("s"), F.col("doc_id")], pool, "rnk")
    lex = c.where(lexical.matches_all("text", TEXT))
    lex = (lex if lex_where is None else lex.where(lex_where)).select("doc_id", lexical.rank_cover("text", TEXT).alias("r"))
    return near, fusion.ranked(lex, [F.desc("r"), F.col("doc_id")], pool, "rnk")


@query(b.sql("WITH " + _legs_sql("", "", 40) + _RRF.format(10), "corpus", "qvec"))
def rrf_fusion(spark, d):
    near, lex = _legs(spark, d, fusion.pool_of(10))
    top = fusion.rrf_fuse([(near, "rnk"), (lex, "rnk")], "doc_id", score="s").orderBy(F.desc("s"), "doc_id").limit(10)
    return top.select("doc_id", F.round("s", 6).alias("score"))


@query(b.sql("WITH " + _legs_sql(f" AND {ACL}", " AND c.tenant_id = 't1' AND c.owner_user_id = 'u1'", 40) + _RRF.format(10), "corpus", "qvec"))
def acl_scoped_hybrid(spark, d):
    """Access is applied in each leg before its limit, so hidden rows never take a place."""
    near, lex = _legs(spark, d, 40, access.can_read(ME), access.owns(ME))
    top = fusion.rrf_fuse([(near, "rnk"), (lex, "rnk")], "doc_id", score="s").orderBy(F.desc("s"), "doc_id").limit(10)
    return top.select("doc_id", F.round("s", 6).alias("score"))


@query(b.sql(f"SELECT doc_id, round(list_dot_product(dense, qv), 6) AS score FROM corpus c, qvec WHERE dense IS NOT NULL AND {ACL} ORDER BY list_dot_product(dense, qv) DESC, doc_id LIMIT 15", "corpus", "qvec"))
def acl_scoped_topk(spark, d):
    top = fusion.topk_by_vector(b.corpus(spark, d).crossJoin(_q(spark, d)), "dense", F.col("qv"), "doc_id", 15, where=access.can_read(ME))
    return top.select("doc_id", F.round("score", 6).alias("score"))


@query(b.sql("SELECT conv_id, seq FROM messages WHERE tenant_id = 't1' AND owner_user_id = 'u1'", "messages"))
def acl_owner_only(spark, d):
    return b.messages(spark, d).where(access.owns(ME)).select("conv_id", "seq")


@query(b.sql("WITH " + _legs_sql("", "", 100) + """SELECT doc_id, round(1.0::DOUBLE / (20 + coalesce(a.rnk, 101)) + 1.0::DOUBLE / (20 + coalesce(b.rnk, 101)), 6) AS score
FROM dense a FULL JOIN lex b USING (doc_id) ORDER BY 1.0::DOUBLE / (20 + coalesce(a.rnk, 101)) + 1.0::DOUBLE / (20 + coalesce(b.rnk, 101)) DESC, doc_id LIMIT 10""", "corpus", "qvec"))
def rrf_full_outer(spark, d):
    near, lex = _legs(spark, d, 100)
    both = fusion.full_outer_fuse(near.select("doc_id", F.col("rnk").alias("ra")), lex.select("doc_id", F.col("rnk").alias("rb")), "doc_id", "ra", "rb", score="s")
    return both.orderBy(F.desc("s"), "doc_id").limit(10).select("doc_id", F.round("s", 6).alias("score"))


@query(b.sql("""WITH books AS (SELECT 'book' AS kind, doc_id AS id, list_dot_product(dense, qv) AS s FROM corpus, qvec WHERE dense IS NOT NULL AND lang = 'en' ORDER BY s DESC, id LIMIT 8),
media AS (SELECT 'media' AS kind, doc_id AS id, list_dot_product(dense, qv) AS s FROM corpus, qvec WHERE dense IS NOT NULL AND lang <> 'en' ORDER BY s DESC, id LIMIT 8)
SELECT kind, id, round(s, 6) AS score FROM (SELECT * FROM books UNION ALL SELECT * FROM media) ORDER BY s DESC, kind, id LIMIT 8""", "corpus", "qvec"))
def library_union_search(spark, d):
    c = b.corpus(spark, d).crossJoin(_q(spark, d))
    legs = [fusion.topk_by_vector(c.where(w), "dense", F.col("qv"), "doc_id", 8, "s").select(F.lit(kind).alias("kind"), F.col("doc_id").alias("id"), "s") for kind, w in (("book", "lang = 'en'"), ("media", "lang <> 'en'"))]
    return legs[0].unionByName(legs[1]).orderBy(F.desc("s"), "kind", "id").limit(8).select("kind", "id", F.round("s", 6).alias("score"))


@query(b.sql("""WITH conv AS (SELECT source AS conv_id, CAST(NULL AS BIGINT) AS seg, list_dot_product(dense, qv) AS s, doc_id FROM corpus, qvec WHERE dense IS NOT NULL AND doc_id % 2 = 0 ORDER BY s DESC, doc_id LIMIT 30),
seg AS (SELECT source AS conv_id, doc_id AS seg, list_dot_product(dense, qv) AS s, doc_id FROM corpus, qvec WHERE dense IS NOT NULL AND doc_id % 2 = 1 ORDER BY s DESC, doc_id LIMIT 30),
total AS (SELECT source AS conv_id, count(*) AS seg_total FROM corpus WHERE doc_id % 2 = 1 GROUP BY source),
best AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, doc_id) AS rn FROM (SELECT * FROM conv UNION ALL SELECT * FROM seg))
SELECT conv_id, seg, CASE WHEN seg IS NOT NULL THEN seg_total END AS seg_total, round(s, 6) AS score FROM best LEFT JOIN total USING (conv_id) WHERE rn = 1 ORDER BY s DESC, conv_id LIMIT 10""", "corpus", "qvec"))
def conversation_search_best_per_key(spark, d):
    """Whole-thread and segment hits; the best of each thread."""
    c = b.corpus(spark, d).crossJoin(_q(spark, d)).withColumnRenamed("source", "conv_id")
    conv = fusion.topk_by_vector(c.where("doc_id % 2 = 0"), "dense", F.col("qv"), "doc_id", 30, "s").select("conv_id", F.lit(None).cast("long").alias("seg"), "s", "doc_id")
    seg = fusion.topk_by_vector(c.where("doc_id % 2 = 1"), "dense", F.col("qv"), "doc_id", 30, "s").select("conv_id", F.col("doc_id").alias("seg"), "s", "doc_id")
    total = b.corpus(spark, d).where("doc_id % 2 = 1").groupBy(F.col("source").alias("conv_id")).agg(F.count(F.lit(1)).alias("seg_total"))
    best = fusion.best_per_key(conv.unionByName(seg), ["conv_id"], [F.desc("s"), F.col("doc_id")]).join(total, "conv_id", "left")
    return best.orderBy(F.desc("s"), "conv_id").limit(10).select("conv_id", "seg", F.when(F.col("seg").isNotNull(), F.col("seg_total")).alias("seg_total"), F.round("s", 6).alias("score"))


@query(b.sql("""WITH q AS (SELECT doc_id AS qid, source AS qsource, dense AS qv FROM corpus WHERE doc_id % 100 = 0 AND dense IS NOT NULL),
r AS (SELECT qid, doc_id, list_dot_product(dense, qv) AS s, row_number() OVER (PARTITION BY qid ORDER BY list_dot_product(dense, qv) DESC, doc_id) AS rank FROM corpus, q WHERE source <> qsource AND dense IS NOT NULL)
SELECT qid, doc_id, rank, round(s, 6) AS sim FROM r WHERE rank <= 3""", "corpus"))
def code_knn_lateral(spark, d):
    """k nearest of each query vector outside of its own source."""
    c = b.corpus(spark, d)
    q = c.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col("source").alias("qsource"), F.col("dense").alias("qv"))
    hits = nearest_to_queries(q, c, "qid", "qv", "doc_id", "dense", 3, ("qsource", "source"))
    return hits.select("qid", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("sim", 6).alias("sim"))


@query(b.sql("SELECT id, round(base_score, 6) AS base_score, round(recency_factor, 6) AS recency_factor, round(semantic_sim, 6) AS semantic_sim, round(base_score * recency_factor + semantic_sim * 0.5, 6) AS rank_score FROM enriched ORDER BY base_score * recency_factor + semantic_sim * 0.5 DESC, last_dubbed_at DESC, id LIMIT 20", "enriched"))
def memory_linear_rank(spark, d):
    rows = mem.enriched(b.memories(spark, d), b.telemetry(spark, d), b.allowlist(spark, d), b.as_of(), "src1", True, b.query_vector(spark, d))
    r = lambda c: F.round(c, 6).alias(c)
    return mem.rank_linear(rows, 20).select("id", r("base_score"), r("recency_factor"), r("semantic_sim"), r("rank_score"))


@query(b.sql(f"""WITH dense AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS rnk FROM (SELECT id, list_cosine_similarity(dense, qv) AS s FROM enriched WHERE dense IS NOT NULL ORDER BY s DESC, id LIMIT 100)),
{places_sql('enriched', 'id', 'body', ['that', 'with'])}, {PAIRS_SQL}, lex AS (SELECT key AS id, row_number() OVER (ORDER BY r DESC, key) AS rnk FROM (SELECT * FROM pairs ORDER BY r DESC, key LIMIT 100)),
s AS (SELECT id, sum(1.0::DOUBLE / (60 + rnk)) AS s FROM (SELECT * FROM dense UNION ALL SELECT * FROM lex) GROUP BY id)
SELECT id, round(s, 6) AS rank_score FROM s JOIN enriched USING (id) ORDER BY s DESC, base_score * recency_factor DESC, last_dubbed_at DESC, id LIMIT 20""", "enriched"))
def memory_rrf_rank(spark, d):
    rows = mem.enriched(b.memories(spark, d), b.telemetry(spark, d), b.allowlist(spark, d), b.as_of(), "src1", True, b.query_vector(spark, d))
    return mem.rank_rrf(rows, 20, "that with", True).select("id", F.round("rank_score", 6).alias("rank_score"))


@query(b.sql("SELECT id, round(base_score * recency_factor, 6) AS rank_score FROM enriched ORDER BY base_score * recency_factor DESC, last_dubbed_at DESC, id LIMIT 50", "enriched"))
def memory_list_mode(spark, d):
    rows = mem.enriched(b.memories(spark, d), b.telemetry(spark, d), b.allowlist(spark, d), b.as_of(), "src1", True)
    return mem.rank_rrf(rows, 50).select("id", F.round("rank_score", 6).alias("rank_score"))


@query(b.sql("SELECT doc_id FROM (SELECT doc_id, sqrt(list_dot_product(dense, dense)) AS n, len(dense) AS k FROM corpus) WHERE NOT (abs(n - 1) <= 1e-8 AND k = 64)", "corpus"))
def norm_violations(spark, d):
    return b.corpus(spark, d).where(~vectors.is_unit("dense", 1e-8, 64)).select("doc_id")


_HALF = "CASE WHEN x = 0 THEN x ELSE round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) END"


@query(f"SELECT vec_id, round(sqrt(list_dot_product(h, h)) - sqrt(list_dot_product(v, v)), 9) AS shift, max_err FROM (SELECT vec_id, v, list_transform(v, lambda x: {_HALF}) AS h, round(list_max(list_transform(v, lambda x: abs(x - ({_HALF})))), 9) AS max_err FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))")
def half_precision_norms(spark, d):
    """How far 16-bit storage moves each norm and each component."""
    e = b.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), vectors.half_precision("embedding").alias("h"))
    worst = F.array_max(F.zip_with("v", "h", lambda x, y: F.abs(x - y)))
    return e.select("vec_id", F.round(vectors.norm("h") - vectors.norm("v"), 9).alias("shift"), F.round(worst, 9).alias("max_err"))
