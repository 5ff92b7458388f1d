"""SQL table functions: ranked memories, their neighbours, and recall, which joins the two laterally.

They are bodies of SQL over views, so Spark plans a call as part of the query that makes it: filters and joins around it are optimised with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talus.functions.lexical import DISTANCE, FAINT, FAR, PLACES, SQUARES, TOKEN, WEIGHT
from talus.operators.memories import WEIGHTS

_A, _B, _C, _D = DISTANCE
_WORDS = TOKEN.replace("\\", "\\\\")
_BASE = " + ".join(f"coalesce(cast(t.{c} AS DOUBLE), 0D) * {w}D" for c, w in WEIGHTS.items())

#: Scalar functions: the words of a text, and ranks of texts by words (both as arrays).
SCALARS = (
    f"words_of(t STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(lower(coalesce(t, '')), '({_WORDS})', 1)",
    f"""word_rank(held ARRAY<STRING>, word STRING) RETURNS DOUBLE RETURN round(coalesce(aggregate(
filter(transform(held, (x, i) -> IF(x = word, 1, 0)), x -> x > 0), named_struct('n', 0D, 's', 0D), (a, x) -> named_struct('n', a.n + 1, 's', a.s + {WEIGHT}D / ((a.n + 1) * (a.n + 1))), a -> a.s), 0D) / {SQUARES}D, {PLACES})""",
    f"""pair_rank(held ARRAY<STRING>, words ARRAY<STRING>) RETURNS DOUBLE RETURN aggregate(
filter(transform(held, (x, i) -> named_struct('pos', i + 1, 'word', array_position(words, x))), o -> o.word > 0),
named_struct('recent', cast(array() AS ARRAY<STRUCT<pos: INT, word: BIGINT>>), 'rest', 1D),
(a, o) -> named_struct('recent', concat(filter(a.recent, r -> o.pos - r.pos <= {FAR}), array(o)), 'rest', aggregate(filter(a.recent, r -> o.pos - r.pos <= {FAR} AND r.word <> o.word), a.rest,
  (x, r) -> x * (1 - {WEIGHT}D * sqrt(1 / ({_A}D + {_B}D * exp(cast(o.pos - r.pos AS DOUBLE) / {_C}D - {_D}D)))))),
a -> greatest(round(1 - a.rest, {PLACES}), {FAINT}D))""",
    """cosine_of(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)
/ nullif(sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v)), 0D)""",
)

_ALLOWED = "LEFT JOIN (SELECT DISTINCT memory_pk, allowed_project FROM {p}allowlist) a ON a.memory_pk = m.id AND a.allowed_project = project"
_VISIBLE = "m.deleted_at IS NULL AND (m.scope = 'shared' OR restricted AND m.scope = 'shared-restricted' AND a.memory_pk IS NOT NULL)"

TABLES = (
    f"""ranked_memories(query_text STRING, query_vec ARRAY<DOUBLE>, project STRING, restricted BOOLEAN, n INT, as_of TIMESTAMP)
RETURNS TABLE (id BIGINT, scope STRING, base_score DOUBLE, recency_factor DOUBLE, semantic_sim DOUBLE, rank_score DOUBLE, place INT)
RETURN WITH enriched AS (SELECT m.id, m.scope, m.dense, m.last_dubbed_at, {{p}}words_of(m.body) AS held, {{p}}words_of(query_text) AS words,
  {_BASE} + IF(m.scope IN ('shared', 'shared-restricted'), 0.1D, 0D) AS base_score,
  exp(-((unix_micros(as_of) - unix_micros(cast(coalesce(t.last_activated_at, m.first_dubbed_at) AS TIMESTAMP))) / 1e6D) / (30 * 86400)) AS recency_factor,
  greatest(coalesce(nanvl({{p}}cosine_of(cast(m.dense AS ARRAY<DOUBLE>), query_vec), 0D), 0D), 0D) AS semantic_sim, {{p}}cosine_of(cast(m.dense AS ARRAY<DOUBLE>), query_vec) AS near
  FROM {{p}}memories m LEFT JOIN {{p}}telemetry t ON t.memory_pk = m.id {_ALLOWED} WHERE {_VISIBLE}),
dense_leg AS (SELECT id, row_number() OVER (ORDER BY near DESC NULLS LAST, id) AS rnk FROM (SELECT id, near FROM enriched WHERE query_vec IS NOT NULL AND dense IS NOT NULL ORDER BY near DESC NULLS LAST, id LIMIT 100)),
text_leg AS (SELECT id, row_number() OVER (ORDER BY r DESC, id) AS rnk FROM (SELECT id, IF(size(array_distinct(words)) = 1, {{p}}word_rank(held, words[0]), {{p}}pair_rank(held, array_distinct(words))) AS r
  FROM enriched WHERE size(words) > 0 AND size(array_except(words, held)) = 0 ORDER BY r DESC, id LIMIT 100)),
list_leg AS (SELECT id, base_score * recency_factor AS s FROM enriched WHERE query_vec IS NULL AND coalesce(query_text, '') = '' ORDER BY s DESC, last_dubbed_at DESC, id LIMIT 50),
scored AS (SELECT id, sum(s) AS rank_score FROM (SELECT id, 1D / (60 + rnk) AS s FROM dense_leg UNION ALL SELECT id, 1D / (60 + rnk) FROM text_leg UNION ALL SELECT id, s FROM list_leg) GROUP BY id)
SELECT id, scope, base_score, recency_factor, semantic_sim, rank_score, place FROM (
  SELECT e.*, rank_score, row_number() OVER (ORDER BY rank_score DESC, base_score * recency_factor DESC, last_dubbed_at DESC, e.id) AS place FROM enriched e JOIN scored s ON s.id = e.id) WHERE place <= greatest(1, least(n, 50))""",
    f"""memory_neighbours(sources ARRAY<BIGINT>, project STRING, restricted BOOLEAN, most INT)
RETURNS TABLE (id BIGINT, via_source_pk BIGINT, src_rank INT, place INT)
RETURN SELECT id, via_source_pk, cast(src_rank AS INT), place FROM (SELECT id, best.via AS via_source_pk, best.r AS src_rank, row_number() OVER (ORDER BY best.r, id) AS place FROM (
  SELECT id, min(best) AS best FROM (SELECT m.id, named_struct('r', array_position(sources, e.source_memory_pk), 'via', e.source_memory_pk) AS best
  FROM (SELECT explode(array_distinct(sources)) AS source) w JOIN {{p}}memory_edges e ON e.source_memory_pk = w.source
  JOIN {{p}}memories m ON m.id = e.target_memory_pk JOIN {{p}}memories s ON s.id = e.source_memory_pk AND s.deleted_at IS NULL {_ALLOWED}
  WHERE NOT array_contains(sources, m.id) AND {_VISIBLE}) GROUP BY id)) WHERE place <= greatest(0, least(most, 10))""",
)


def register(spark: SparkSession, memories: DataFrame, telemetry: DataFrame, allowlist: DataFrame, edges: DataFrame, prefix: str = "talus_") -> None:
    """Create the functions `<prefix>ranked_memories` and `<prefix>memory_neighbours` over views of these tables, for this session.

    ranked_memories: with a vector, a text or both, memories by fused ranks (up to 100 a leg), importance breaking ties; with neither, by
    importance. All words of the text must occur. n is clamped to 1 to 50. memory_neighbours: visible targets of links from the sources, which
    come in rank order, each by its best source; most is clamped to 0 to 10. Null sources and empty ones give no row."""
    for name, rows in (("memories", memories), ("telemetry", telemetry), ("allowlist", allowlist), ("memory_edges", edges)):
        rows.createOrReplaceTempView(f"{prefix}{name}")
    for body in SCALARS + TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}" + body.replace("{p}", prefix))
